"""Quality rules: a decision list learned by sequential covering.

Statistics of every whole text come from one pass.  The rules are learned on a
bounded sample of labelled documents, which is stored before anything is
measured, so training never runs over the corpus: grow a conjunction of
thresholds by information gain on two thirds of the sample, prune its end on the
other third, keep it if it is precise enough there, take away what it covers,
and go on.  A learned list becomes an ordered Spark conditional expression over
the statistics, so its use on the corpus is an ordinary column.

Learning is bounded by ``SAMPLE_ROWS`` labelled documents (the smallest hashes of
their ids), ``MOST_RULES`` rules of ``MOST_CONDITIONS`` conditions each, and
``CUT_POINTS`` thresholds tried for a feature (quantiles of its values); judging
covers every document and every whole text.

Edge cases: a null text is an empty one and fails the base rules; without
labels, or with labels of one class, the list is empty and the base rules
decide; null labels are left out, of several labels for an id the smallest
counts; labels of absent documents are left out; of documents with repeated ids
the smallest text is learned from, and each gets its own row when judged.
Other columns are ignored or, in ``keep_good``, carried along whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loculus.llm.common import Scratch
from loculus.llm.files import tidy

#: Base rules: fewest words, and the largest share in percent of words in repeated windows.
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW_WORDS = 5
SYMBOLS = "#*$%&|<>"
#: The labelled sample's bound, and the limits of learning.
SAMPLE_ROWS = 20_000
SAMPLE_FILES = 32
MOST_RULES = 16
MOST_CONDITIONS = 4
LEAST_PRECISION = 0.95
LEAST_COVERED = 5
CUT_POINTS = 200
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclamations")
#: What the rules may ask for, as SQL over the statistics.
FEATURES = {
    "words": "cast(n_words as double)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "duplicate_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_word_share": "n_repeat_words / greatest(n_words, 1)",
    "capitals_per_char": "n_capitals / greatest(word_chars, 1)",
    "exclamations_per_word": "n_exclamations / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def _repeated_words(words: list[str]) -> int:
    """Words in windows of ``WINDOW_WORDS`` that occur twice or more in the text, first occurrences included."""
    n = len(words) - WINDOW_WORDS + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        mixed = np.zeros(n, np.uint64)
        for k in range(WINDOW_WORDS):
            mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    suspects = np.zeros(n, bool)
    suspects[order[1:][same]] = suspects[order[:-1][same]] = True
    at = np.flatnonzero(suspects).tolist()
    windows = [tuple(words[i : i + WINDOW_WORDS]) for i in at]  # hashes only choose; words decide
    seen = Counter(windows)
    covered = np.zeros(len(words) + 1, np.int64)
    for i, window in zip(at, windows, strict=True):
        if seen[window] > 1:
            covered[i] += 1
            covered[i + WINDOW_WORDS if i + WINDOW_WORDS < len(words) else len(words)] -= 1
    return int((np.cumsum(covered[:-1]) > 0).sum())


def text_statistics(text: str | None) -> tuple[int, ...]:
    """``STATISTICS`` of one whole text."""
    text = text or ""
    words = _WORDS.findall(text)
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    data = text.encode()
    capitals = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), _repeated_words(words), len(lines), capitals, text.count("!")


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in STATISTICS]))
def statistics_column(texts: pa.Array) -> pa.Array:
    rows = np.array([text_statistics(t.as_py()) for t in texts], np.int64).reshape(len(texts), len(STATISTICS))
    tidy()  # workers stay beside the next stage
    return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(STATISTICS))], names=list(STATISTICS))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


@dataclass
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x >= self.threshold if self.at_least else x < self.threshold

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.at_least else '<'} {self.threshold!r}D"


@dataclass
class Rule:
    """A conjunction; documents for which it holds are rejected."""

    conditions: list[Condition] = field(default_factory=list)

    def covers(self, data: dict[str, np.ndarray], n: int) -> np.ndarray:
        out = np.ones(n, bool)
        for c in self.conditions:
            out &= c.holds(data[c.feature])
        return out

    def sql(self) -> str:
        return " and ".join(c.sql() for c in self.conditions)


def _best_condition(data: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition] | None:
    """The condition with the largest information gain for ``bad`` among the rows given."""
    p, n = bad.sum(), (~bad).sum()
    base, best = np.log2(p / (p + n)), None
    for name, x in data.items():
        values = np.unique(x)
        if len(values) < 2:
            continue
        middles = (values[1:] + values[:-1]) / 2
        cuts = middles[np.unique(np.linspace(0, len(middles) - 1, CUT_POINTS).astype(int))]
        order = np.argsort(x, kind="stable")
        below = np.searchsorted(x[order], cuts)  # rows under each cut
        bad_below = np.concatenate([[0], np.cumsum(bad[order])])[below]
        for at_least, covered, hit in ((False, below, bad_below), (True, len(x) - below, p - bad_below)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(hit > 0, hit * (np.log2(hit / covered) - base), -np.inf)
            k = int(gain.argmax())
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0] + 1e-9):
                best = (float(gain[k]), Condition(name, at_least, float(cuts[k])))
    return best


def learn_rules(data: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray) -> list[Rule]:
    """An ordered list of rules that cover ``bad`` rows; ``prune`` marks the rows kept for pruning."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MOST_RULES and (left & bad & ~prune).sum() >= LEAST_COVERED and (left & bad & prune).any():
        rule, inside = Rule(), left & ~prune
        while len(rule.conditions) < MOST_CONDITIONS and (inside & ~bad).any():
            found = _best_condition({f: x[inside] for f, x in data.items()}, bad[inside])
            if found is None:
                break
            rule.conditions.append(found[1])
            inside &= found[1].holds(data[found[1].feature])
        held_out, scores = left & prune, []
        for k in range(1, len(rule.conditions) + 1):
            hit = Rule(rule.conditions[:k]).covers(data, len(bad)) & held_out
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            scores.append(((p - n) / (p + n) if p + n else -1.0, p / (p + n) if p + n else 0.0))
        if not scores:
            break
        k = int(np.argmax([s for s, _ in scores]))
        rule = Rule(rule.conditions[: k + 1])
        covered = rule.covers(data, len(bad)) & left
        if scores[k][1] < LEAST_PRECISION or (bad & covered).sum() < LEAST_PRECISION * covered.sum() or (bad & covered).sum() < LEAST_COVERED:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, scratch: Scratch | None = None) -> list[Rule]:
    """Rules from the labelled documents with the smallest id hashes, ``sample_rows`` documents at most."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    labelled = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")  # at most sample_rows rows are broadcast
    single = joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    stored = scratch.table(single.repartition(SAMPLE_FILES), "sample")
    measured = stored.select("doc_id", "quality", statistics_column("text").alias("s")).select("doc_id", "quality", "s.*")
    rows = measured.select(
        "doc_id",
        (F.pmod(F.xxhash64(F.lit("prune"), "doc_id"), F.lit(3)) == 0).alias("prune"),
        (F.col("quality") == 0).alias("bad"),
        base_failed().alias("failed"),
        *[F.expr(e).alias(f) for f, e in FEATURES.items()],
    ).toPandas()
    scratch.drop("sample")
    rows = rows[~rows["failed"].astype(bool)].sort_values("doc_id")
    if rows.empty:
        return []
    return learn_rules({f: rows[f].to_numpy(float) for f in FEATURES}, rows["bad"].to_numpy(bool), rows["prune"].to_numpy(bool))


def verdict(rules: list[Rule]) -> Column:
    """The decision list: false at the first rule that holds, true if none does."""
    chain = F.when(base_failed(), F.lit(False))
    for rule in rules:
        chain = chain.when(F.expr(rule.sql()), F.lit(False))
    return chain.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and the number of the rule that rejected (1 is the first)."""
    which = F.when(base_failed(), F.lit(0))
    for k, rule in enumerate(rules, 1):
        which = which.when(F.expr(rule.sql()), F.lit(k))
    measured = docs.select("doc_id", statistics_column("text").alias("s")).select("doc_id", "s.*")
    return measured.withColumns({"base_failed": base_failed(), "kept": verdict(rules), "rejected_by": which.otherwise(F.lit(None).cast("int"))})


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that the base rules and the list keep, with ``docs``' columns."""
    measured = docs.select(F.struct("*").alias("doc"), statistics_column("text").alias("s")).select("doc", "s.*")
    return measured.where(verdict(rules)).select(*[F.col("doc")[c].alias(c) for c in docs.columns])
