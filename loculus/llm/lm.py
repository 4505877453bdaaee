"""Scoring texts with a hashed maximum-entropy language model.

A token is a lower-cased word or the end of its text.  The model predicts it in
factors, ``P(class | context) * P(head word or tail | class, context) * P(word |
tail)``: the first two are softmaxes over hashed features of the context (the
word before, the two words before, and the second and third word before with
what lies between skipped), the last is the word's share of its tail's count.
The most frequent words are told apart; all others form one class, inside which
a word has its smoothed share, and the unknown word the share of a count of 0.

Training goes through all training texts once, in ``BATCHES`` rounds.  In each,
tasks sum what their tokens show and what the model expected of every (feature,
class), Spark adds these sums up, and the weights move along the difference: by
the logarithm of the ratio, shared among the features, which is the step of
generalized iterative scaling and needs no learning rate.  Classes come from the
training texts too: words are clustered by the frequent words that stand near.

What is held in full is bounded by parameters: the list of frequent words
(``FREQUENT``, of at most ``LONGEST`` bytes each) and the weights (some 3 MB).
Counts of all other words are a table; the tokens of a text that aren't frequent
meet it in a join, where no key is hot in training, since hot words are in the list.

Edge cases: a null text is the empty one, whose only token is the end; a null id
counts as the empty text where documents are held out; rows that share an id are
scored each for itself; without training texts every count is 0 and the model is
uniform over its classes; an empty table gives an empty result.  Other columns
of the documents are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loculus.llm.common import Scratch
from loculus.llm.files import tidy

#: Numbers of tokens: the end of a text, frequent words from 1 on, and every other word.
END, RARE = 0, 65_535
FREQUENT, LONGEST = RARE - 1, 64
#: Frequent words occur so often at least; rarer ones stand for words that training texts don't have.
LEAST_TIMES = 3
#: Outcomes of the two softmaxes: classes (0: other words, 1: the end), and the head words of a class with its tail last.
CLASSES, HEADS = 32, 16
#: Frequent words that tell what a word's neighbourhood is, and how near they count.
SIGNS, NEAR = 32, 4
#: Weight rows of one word (the frequent half have their own), of word pairs, and of (word, class): powers of two.
WORD_ROWS, PAIR_ROWS, HEAD_ROWS = 4096, 8192, 8192
BATCHES = 5
#: Two neighbouring float32 as one number, so that an addition does both.
PAIR = np.complex64
#: Counts that pull a weight to no effect, and outcomes that don't occur.
PRIOR, HEAD_PRIOR, NEVER = 10.0, 1.0, -60.0
#: Tokens that are computed together; words that a task counts before it hands them on; weight rows that are summed together.
TOGETHER, MOST_HELD, ROWS_A_SUM = 8_192, 300_000, 1024


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words (A to Z only); bytes are split at the blank and the ASCII controls 9 to 13."""
    return (text or b"").lower().split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

    held: Counter = Counter()
    for batch in batches:
        for text in batch.column("text"):
            held.update(words_of(text.as_py()))
            held[None] += 1  # the end
            if len(held) > MOST_HELD:
                yield out()
                held.clear()
    yield out()
    held.clear()
    tidy()


def count_tokens(texts: DataFrame) -> DataFrame:
    """(word, n) of lower-cased words of ``text`` (binary); the null word is the end of a text."""
    return texts.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame) -> list:
    """At most ``FREQUENT`` words with their counts, most frequent first: whole grades of counts (steps of 1 %), as many as fit."""
    grade = F.floor(F.log2("n") * 64)
    known = counts.where((F.length("word") <= LONGEST) & (F.col("n") >= LEAST_TIMES)).withColumn("grade", grade)
    held, least = 0, None
    for r in sorted(known.groupBy("grade").count().collect(), key=lambda r: -r["grade"]):  # some 4,000 grades at most
        held += r["count"]
        if held > FREQUENT:
            break
        least = r["grade"]
    return sorted(known.where(F.col("grade") >= least).select("word", "n").collect(), key=lambda r: (-r["n"], r["word"])) if least is not None else []


def _encoder(words: list[bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row, doc_id, held_out, part, text) to token numbers and the words that have none."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: k for k, w in enumerate(words, 1)}
        for batch in batches:
            ids, rare, times, size, ends = [], [], [], [], [0]
            for text in batch.column("text"):
                tokens = words_of(text.as_py())
                known = np.empty(len(tokens) + 1, np.uint16)
                known[:-1] = np.fromiter(map(number.get, tokens, repeat(RARE)), np.uint16, len(tokens))
                known[-1] = END
                others = Counter(map(tokens.__getitem__, np.flatnonzero(known == RARE).tolist()))
                ids.append(known.tobytes())
                size.append(len(known))
                rare.extend(others)
                times.extend(others.values())
                ends.append(len(rare))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind)) for flat, kind in ((rare, pa.binary()), (times, pa.int64()))]
            new = [pa.array(size, pa.int64()), pa.array(ids, pa.binary()), *lists]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "held_out", "part")), *new], ENCODED_NAMES)
        tidy()

    return encode


ENCODED = "row long, doc_id long, held_out boolean, part int, n_tokens long, ids binary, rare array<binary>, times array<long>"
ENCODED_NAMES = [c.split()[0] for c in ENCODED.split(", ")]


def _with_context(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of several texts with three ends before each, and the places of the tokens proper."""
    parts = [np.frombuffer(t, np.uint16).astype(np.int64) for t in texts]
    size = np.array([len(p) for p in parts])
    start = np.cumsum(size + 3) - size
    line = np.zeros(int((size + 3).sum()), np.int64)
    for at, p in zip(start.tolist(), parts, strict=True):
        line[at : at + len(p)] = p
    places = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
    return line, places


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts of ``ids`` laid into lines of about ``TOGETHER`` tokens; long texts are lines of their own."""
    held, size = [], 0
    for batch in batches:
        for text in batch.column("ids"):
            held.append(text.as_py())
            size += len(held[-1]) // 2
            if size >= TOGETHER:
                yield _with_context(held)
                held, size = [], 0
    if held:
        yield _with_context(held)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each token stands near each sign: (block of tokens, counts as int64)."""
    seen = np.zeros((RARE + 1) * SIGNS, np.int64)
    for line, _ in _stretches(batches):
        signs = np.flatnonzero((line > END) & (line <= SIGNS))
        which = line[signs] - 1
        for gap in range(1, NEAR + 1):
            first, end = np.searchsorted(signs, (gap, len(line) - gap))  # signs with a token so far before, and behind
            np.add.at(seen, line[signs[first:] - gap] * SIGNS + which[first:], 1)
            np.add.at(seen, line[signs[:end] + gap] * SIGNS + which[:end], 1)
    yield from _blocks({"near": seen.reshape(RARE + 1, SIGNS)})
    tidy()


def _blocks(tables: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Tables cut into blocks of rows, those without a count left out."""
    for name, table in tables.items():
        for at in range(0, len(table), ROWS_A_SUM):
            block = table[at : at + ROWS_A_SUM]
            if block.any():
                yield pa.RecordBatch.from_pydict({"name": [name], "at": pa.array([at], pa.int32()), "sums": [block.astype(np.float64).tobytes()]})


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
    return pa.table({"name": table.column("name")[:1], "at": table.column("at")[:1], "sums": [total.tobytes()]}, schema=table.schema)


def _summed(frame: DataFrame, work: Callable, shapes: dict[str, tuple[int, int]]) -> dict[str, np.ndarray]:
    """Tables that tasks have counted, added up by Spark block by block; their size is fixed by ``shapes``."""
    schema = "name string, at int, sums binary"
    found = {k: np.zeros(shape) for k, shape in shapes.items()}
    for r in frame.select("ids").mapInArrow(work, schema).groupBy("name", "at").applyInArrow(_added, schema).collect():
        block = np.frombuffer(r["sums"]).reshape(-1, shapes[r["name"]][1])
        found[r["name"]][r["at"] : r["at"] + len(block)] = block
    return found


def word_classes(near: np.ndarray, counts: np.ndarray, rounds: int = 12) -> np.ndarray:
    """The class of each token: k-means by cosine over the signs that stand near, weighted by the root of counts."""
    share = (near.sum(axis=0) + 1) / (near.sum() + SIGNS)
    place = np.log((near + 5 * share) / ((near.sum(axis=1, keepdims=True) + 5) * share))
    place /= np.maximum(np.linalg.norm(place, axis=1, keepdims=True), 1e-9)
    weight = np.sqrt(counts)[:, None] * place
    centres = place[np.argsort(-counts, kind="stable")[1 : CLASSES - 1]]
    for _ in range(rounds):
        nearest = (place @ centres.T).argmax(axis=1)
        for k in range(len(centres)):
            total = weight[nearest == k].sum(axis=0)
            if total.any():
                centres[k] = total / np.linalg.norm(total)
    found = nearest + 2
    found[END], found[RARE] = 1, 0
    return found


class Model:
    """Weights, and what is fixed before training: classes, places in a class, and logarithms of shares."""

    def __init__(self, counts: np.ndarray, rare_count: float, near: np.ndarray) -> None:
        """``counts`` by token number (0 at ``RARE``)."""
        self.kind = word_classes(near, counts)
        masses = np.bincount(self.kind, counts, CLASSES)
        masses[0] = max(rare_count, 0.5)
        order = np.lexsort((-counts, self.kind))
        first = np.searchsorted(self.kind[order], np.arange(CLASSES))
        rank = np.empty(RARE + 1, np.int64)
        rank[order] = np.arange(RARE + 1) - first[self.kind[order]]
        self.head = np.minimum(rank, HEADS - 1)
        self.head[RARE] = HEADS - 1
        heads = np.zeros((CLASSES, HEADS))
        np.add.at(heads, (self.kind, self.head), counts)
        heads[0, -1] = max(rare_count, 0.5)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.tail = np.where(counts > 0, np.log10(counts / heads[self.kind, self.head]), 0.0)
            self.bias = np.where(masses > 0, np.log((masses + 0.5) / (masses.sum() + 0.5 * CLASSES)), NEVER).astype(np.float32)
            self.head_bias = np.where(heads > 0, np.log(heads / heads.sum(axis=1, keepdims=True)), NEVER).astype(np.float32)
        self.weights = np.zeros((3 * WORD_ROWS + PAIR_ROWS, CLASSES), np.float32)
        self.head_weights = np.zeros((2 * HEAD_ROWS, HEADS), np.float32)

    @staticmethod
    def features(line: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
        """Weight rows of the tokens at ``places``: last word, second and third last, last two."""

        def row(word: np.ndarray) -> np.ndarray:
            half = WORD_ROWS // 2
            return np.where(word < half, word, half + (word * 2_654_435_761 >> 7 & half - 1))

        one, two, three = line[places - 1], line[places - 2], line[places - 3]
        pair = ((one * 1_000_003 + two * 7919) * 2_654_435_761 >> 9) & PAIR_ROWS - 1
        return row(one), WORD_ROWS + row(two), 2 * WORD_ROWS + row(three), 3 * WORD_ROWS + pair

    def head_features(self, line: np.ndarray, places: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
        """Weight rows of (last word, class) and (second last word, class)."""
        return tuple(k * HEAD_ROWS + ((line[places - 1 - k] * CLASSES + kind) * 2_654_435_761 >> 9 & HEAD_ROWS - 1) for k in (0, 1))

    @staticmethod
    def _softmax(bias: np.ndarray, weights: np.ndarray, rows: tuple[np.ndarray, ...]) -> np.ndarray:
        total = np.take(weights, rows[0], axis=0)
        total += bias
        for r in rows[1:]:
            total += np.take(weights, r, axis=0)
        np.exp(total, out=total)
        total /= np.einsum("ij->i", total)[:, None]
        return total

    def outcomes(self, line: np.ndarray, places: np.ndarray) -> tuple:
        """Probabilities of classes and of heads in the token's class, with the rows and the outcomes they are for."""
        token = line[places]
        kind, head = self.kind[token], self.head[token]
        rows, head_rows = self.features(line, places), self.head_features(line, places, kind)
        classes = self._softmax(self.bias, self.weights, rows)
        return token, (rows, kind, classes), (head_rows, head, self._softmax(self.head_bias[kind], self.head_weights, head_rows))

    def scores(self, line: np.ndarray, places: np.ndarray) -> np.ndarray:
        """log10 of each token's probability; words that aren't frequent lack the factor of their count."""
        at = np.arange(len(places))
        token, (_, kind, classes), (_, head, heads) = self.outcomes(line, places)
        return np.log10(classes[at, kind].astype(np.float64)) + np.log10(heads[at, head].astype(np.float64)) + self.tail[token]

    def statistics(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What tokens show and what the model expected, by weight row and outcome."""
        shown, expected = np.zeros_like(self.weights), np.zeros_like(self.weights)
        head_shown, head_expected = np.zeros_like(self.head_weights), np.zeros_like(self.head_weights)
        for line, places in _stretches(batches):
            for start in range(0, len(places), TOGETHER):
                _, classes, heads = self.outcomes(line, places[start : start + TOGETHER])
                for (rows, outcome, chance), seen, thought in ((classes, shown, expected), (heads, head_shown, head_expected)):
                    width, half = seen.shape[1], seen.shape[1] // 2
                    for r in rows:
                        np.add.at(seen.reshape(-1), r * width + outcome, np.float32(1))
                        np.add.at(thought.view(PAIR).reshape(-1), (r[:, None] * half + np.arange(half)).ravel(), chance.view(PAIR).ravel())
        yield from _blocks({"shown": shown, "expected": expected, "head_shown": head_shown, "head_expected": head_expected})
        del shown, expected, head_shown, head_expected
        tidy()

    def update(self, sums: dict[str, np.ndarray]) -> None:
        prior = PRIOR * np.exp(self.bias)
        self.weights += (np.log((sums["shown"] + prior) / (sums["expected"] + prior)) / 4).astype(np.float32)
        self.head_weights += (np.log((sums["head_shown"] + HEAD_PRIOR) / (sums["head_expected"] + HEAD_PRIOR)) / 2).astype(np.float32)


def _train(counts: np.ndarray, rare_count: float, training: DataFrame) -> Model:
    model = Model(counts, rare_count, _summed(training, _near, {"near": (RARE + 1, SIGNS)})["near"])
    shapes = {"shown": model.weights.shape, "expected": model.weights.shape}
    shapes |= {"head_shown": model.head_weights.shape, "head_expected": model.head_weights.shape}
    for part in range(BATCHES):
        shared = training.sparkSession.sparkContext.broadcast(model)
        model.update(_summed(training.where(F.col("part") == part), lambda batches, shared=shared: shared.value.statistics(batches), shapes))
        shared.destroy()
    return model


def _scorer(shared, base: np.ndarray, seen: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over the tokens of a text that are frequent words or the end, and over the model's factors of all tokens."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column("ids")]
            sums, start = np.zeros((3, len(texts))), 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size < TOGETHER):
                    size += len(texts[end]) // 2
                    end += 1
                line, places = _with_context(texts[start:end])
                first = np.cumsum([0, *(len(t) // 2 for t in texts[start : end - 1])])
                token = line[places]
                found = np.concatenate([shared.value.scores(line, places[k : k + TOGETHER]) for k in range(0, len(places), TOGETHER)])
                for k, values in enumerate((base[token], seen[token], found)):
                    sums[k, start:end] = np.add.reduceat(values, first)
                start = end
            new = [pa.array(sums[0]), pa.array(sums[1].astype(np.int64)), pa.array(sums[2])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "held_out", "n_tokens")), *new], SCORED_NAMES)
        tidy()

    return score


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, base double, known long, found double"
SCORED_NAMES = [c.split()[0] for c in SCORED.split(", ")]


def in_fold(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    """Whether the checksum of an id's text falls on the fold."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def score_documents(docs: DataFrame, scratch: Scratch, held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document, learned from those not held out.

    ``base_score`` is the add-half unigram model, ``score`` the model above; both are log10 probabilities of whole texts.
    """
    spark = docs.sparkSession
    held = in_fold(F.col("doc_id")) if held_out is None else held_out
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), F.coalesce(held, F.lit(False)).alias("held_out"))
    counts = scratch.table(count_tokens(texts.where("not held_out")), "counts")
    total, distinct, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0))).first()
    top = frequent_words(counts)

    numbered = texts.withColumns({"row": F.monotonically_increasing_id(), "part": F.when(F.col("held_out"), -1).otherwise(F.pmod(F.xxhash64("row"), F.lit(BATCHES))).cast("int")})
    where = f"{scratch.path}/encoded"
    numbered.mapInArrow(_encoder([bytes(r["word"]) for r in top]), ENCODED).write.partitionBy("part").option("compression", "zstd").parquet(where)
    encoded = spark.read.schema(ENCODED).parquet(where)

    number = np.zeros(RARE + 1)
    number[END] = ends
    number[1 : len(top) + 1] = [r["n"] for r in top]
    rare_count, rare_distinct = total - number.sum(), distinct - len(top) - bool(ends)
    model = _train(number, rare_count, encoded.where("part >= 0"))
    base = np.log10((number + 0.5) / (total + 0.5 * (distinct + 1)))
    base[RARE] = 0.0
    shared = spark.sparkContext.broadcast(model)
    scored = encoded.select("row", "doc_id", "held_out", "n_tokens", "ids").mapInArrow(_scorer(shared, base, number > 0), SCORED)

    others = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    count = F.coalesce(F.col("n"), F.lit(0))
    share = lambda whole, kinds: F.sum(F.col("times") * F.log10((count + 0.5) / F.lit(float(whole + 0.5 * (kinds + 1)))))
    rest = others.join(counts, "word", "left").groupBy("row").agg(
        share(total, distinct).alias("rare_base"),
        share(rare_count, rare_distinct).alias("rare_found"),
        F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return scored.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        plus("known", "rare_known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        plus("base", "rare_base").alias("base_score"),
        plus("found", "rare_found").alias("score"),
    )
