import random

import pytest

CLASHING = ("size", "shard", "key", "fp", "row", "words", "kept", "status", "start", "hits", "rank")


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))


def sample_documents() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): copies, near copies, nulls, empties, repeated rows, a very long text."""
    long = words(1, 30_000)
    base = [words(s, 120) for s in range(10, 30)]
    shared = words(99, 90)
    texts = [*base, base[0], base[0], base[1].replace(base[1].split()[60], "changed", 1), "", None, " \n\t ", "two words", long, long + " end"]
    texts += [words(40 + k, 30) + "\n" + shared + "\n" + words(60 + k, 30) for k in range(4)]
    texts += [f"write to {w}{k}@mail.example.org or +1 (555) 010-{1000 + k} now" for k, w in enumerate(("ann", "bob", "eve"))]
    rows = [(k, t, "en", None if k % 7 == 3 else f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    return [*rows, (None, base[2], None, None, None), (None, None, None, None, None), rows[5], rows[5]]


@pytest.fixture(scope="session")
def documents(spark):
    """The sample with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(sample_documents(), "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumns({c: F.lit(7) for c in CLASHING}).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)


@pytest.fixture()
def scratch(spark):
    from loculus.llm.common import Scratch

    return Scratch(spark, "test")
