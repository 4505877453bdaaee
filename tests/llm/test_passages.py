"""Passages of more than 50 words that documents share, against plain Python."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from loculus.llm.common import Scratch
from loculus.llm.passages import WORDS
from loculus.llm.queries import op4_suffix_refinement
from loculus.llm.substrings import remove_repeats
from tests.llm.conftest import sample_documents, words


def shared_words(rows):
    """(doc_id, shared words, shared runs): words in runs of ``WORDS`` words that another row has too."""
    rows = [(d, (t or "").encode().split()) for d, t in rows]
    having = defaultdict(set)
    for row, (_, w) in enumerate(rows):
        for i in range(len(w) - WORDS + 1):
            having[hash(tuple(w[i : i + WORDS]))].add(row)
    out = []
    for doc_id, w in rows:
        inside = np.zeros(len(w) + 1, np.int8)
        for i in range(len(w) - WORDS + 1):
            if len(having[hash(tuple(w[i : i + WORDS]))]) > 1:
                inside[i : i + WORDS] = 1
        out.append((doc_id, int(inside.sum()), int((np.diff(inside, prepend=0) == 1).sum())))
    return Counter(out)


def found(frame):
    return Counter((r.doc_id, r.n_shared_words, r.n_shared_runs) for r in frame.collect())


def test_short_passages(spark, scratch):
    """Passages of 51 words and fewer than 400 bytes, one of 50, one that only one document repeats, a very common one."""
    fits, short, own, common = (words(s, n) for s, n in ((7, 51), (8, 50), (9, 60), (11, 55)))
    assert len(fits) < 400
    texts = [words(200 + k, 40) + "\n" + x + "\t" + words(300 + k, 40) for k, x in enumerate((fits, fits, short, short, f"{own} x {own}"))]
    texts += [words(400 + k, 20) + " " + common + " " + words(500 + k, 20) for k in range(30)] + [words(400, 20) + " " + common + " y"]
    rows = list(enumerate(texts))
    got = found(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), scratch))
    assert got == shared_words(rows)
    assert got[0, 51, 1] == 1 and got[2, 0, 0] == 1 and got[4, 0, 0] == 1


def test_sample(documents, scratch):
    """Copies, near copies, nulls, equal rows and texts of 30,000 words."""
    assert found(remove_repeats(documents, scratch)) == shared_words((d, t) for d, t, *_ in sample_documents())


def test_very_many_equal_rows(spark, scratch):
    text, other = words(1, 80), words(2, 10) + " " + words(1, 80) + " " + words(3, 10)
    rows = [(1, text)] * 1_200 + [(2, other), (3, words(4, 80)), (3, words(5, 20)), (3, words(5, 20))]
    assert found(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), scratch)) == shared_words(rows)


@pytest.mark.parametrize("table", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_tables(spark, table):
    from loculus.llm.common import read_table

    docs = read_table(spark, table, "documents")
    want = shared_words(map(tuple, docs.select("doc_id", "text").collect()))
    assert found(remove_repeats(docs, Scratch(spark, "test"))) == want
    rows = op4_suffix_refinement(spark, table).collect()
    assert Counter((r.doc_id, r.n_shared_words) for r in rows) == Counter({(d, n): k for (d, n, _), k in want.items()})
