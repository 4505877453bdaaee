"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

1. quality rules: documents that the base rules or the learned decision list reject go;
2. near-duplicates: SimHash links and, beyond what they reach, exact prefix filtering; one document of
   each group stays (five-word shingles, similarity of 0.8 or more);
3. personal data: spans are replaced by their kind in brackets;
4. mixing: sources are repeated or cut to their target shares;
5. BPE: every document's token ids.

The first four return the columns of ``documents``; a stage works on all rows
that the one before it kept.

Edge cases: null and empty texts fail the base rules of the first stage; without
labels only those rules decide.  Equal rows, and texts with the same words, are one
group, of which the smallest doc_id stays (a null one only if there is no other).
A source that is null is a source of its own.  Further columns, whatever their
names, are carried along up to the last stage, which returns doc_id, n_tokens and
ids for every row that it gets.  Without documents every stage returns no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loculus.llm.bpe import encode
from loculus.llm.common import Scratch, read_table
from loculus.llm.mixing import mixed_documents
from loculus.llm.pii import mask_documents
from loculus.llm.quality import keep_good, train
from loculus.llm.queries import tokenizer_file
from loculus.llm.similar import keep_one_of_each


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, train(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs, Scratch(spark, "near-duplicates"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_documents(docs, Scratch(spark, "personal-data"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, Scratch(spark, "source-mix"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = encode(docs, tokenizer_file("byte_bpe_50k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mix", source_mix),
    ("token ids", token_ids),
]

#: Learned rules, SimHash and BPE are beyond SQL; tests hold each stage against plain Python instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    tables = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = tables.table(stage(spark, docs, sf_dir), f"{k}-{name.replace(' ', '-')}")
    return docs
