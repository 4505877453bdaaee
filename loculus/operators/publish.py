"""Publication: shards, manifests, changes, token sidecars and removal of leftovers; snapshots have a module of their own."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A snapshot needs at least this share of the live one's rows.
LEAST_SHARE = 0.5
MANIFEST_VERSION = 5
#: Zstandard's level for token files, which are written once and read often.
TOKEN_LEVEL = 19


def crc_shard(url: Column, shards: int) -> Column:
    """Shard of a URL, the same wherever it is computed."""
    return F.pmod(F.crc32(url.cast("binary")), F.lit(shards)).cast("int")


def first_urls(urls: DataFrame) -> DataFrame:
    """Each URL once, at its first position."""
    return urls.groupBy("url").agg(F.min("pos").alias("pos"))


def leftovers(present: DataFrame, built: DataFrame, key: str) -> DataFrame:
    """Keys that exist but were not built this time."""
    return present.select(key).distinct().join(built.select(key).distinct(), key, "left_anti")


def not_yet_done(items: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Items whose key hasn't been done; all of them if forced."""
    return items if force else items.join(done.select(key).distinct(), key, "left_anti")


def keep_canonical(files: DataFrame) -> DataFrame:
    """One file per urn: the conventionally named one, else the smallest path; files without urn all stay."""
    expected = F.concat(F.split_part("urn", F.lit(":"), F.lit(4)), F.lit(".xml"))
    named = F.substring_index("path", "/", -1) == expected
    best = files.where("urn is not null").groupBy("urn").agg(
        F.min(F.struct((~named).alias("other"), "path")).alias("b")
    ).select("urn", F.col("b.path").alias("path"))
    return files.join(best, ["urn", "path"], "left_semi").unionByName(files.where("urn is null"))


def digest_changes(before: DataFrame, now: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, removed or changed keys; equal ones are left out."""
    both = before.select(key, F.col(digest).alias("old"), F.lit(1).alias("in_old")).join(
        now.select(key, F.col(digest).alias("new"), F.lit(1).alias("in_new")),
        key,
        "full_outer",
    )
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(
        ~F.col("old").eqNullSafe(F.col("new")),
        "changed",
    )
    return both.select(key, change.alias("change")).where("change is not null")


def merge_manifests(parts: DataFrame) -> DataFrame:
    """``parts`` (ordinal, schema_version, work_urn, version, ...) with one row per version, the last one's; other schema versions are an error."""
    odd = parts.where(F.col("schema_version") != MANIFEST_VERSION).select("schema_version").limit(1).collect()
    if odd:
        raise ValueError(f"manifest has schema version {odd[0][0]}, not {MANIFEST_VERSION}")
    rest = [c for c in parts.columns if c not in ("work_urn", "version", "ordinal")]
    return parts.groupBy("work_urn", "version").agg(*[F.max_by(c, "ordinal").alias(c) for c in rest])


def record_source(metadata: DataFrame) -> DataFrame:
    """``metadata`` (json, source_repo, source_path) with where it came from inside ``document``; an empty path is left out."""
    fields = "map<string,string>"
    parsed = F.from_json("json", f"struct<document:{fields}>")["document"]
    added = F.map_from_arrays(F.array(F.lit("source_repo"), F.lit("source_path")), F.array("source_repo", F.coalesce("source_path", F.lit(""))))
    added = F.map_filter(added, lambda k, v: (k == "source_repo") | (v != ""))
    kept = F.map_filter(F.coalesce(parsed, F.create_map().cast(fields)), lambda k, _: ~F.map_contains_key(added, k))
    return metadata.withColumn("document", F.map_concat(kept, added))


def write_manifest(rows: DataFrame, path: str, source_digest: str, schema_version: int = MANIFEST_VERSION) -> str:
    """Write catalogue rows as JSON lines, each with the schema version and the digest of the sources that they were built from."""
    rows.select(
        F.lit(schema_version).alias("schema_version"),
        F.lit(source_digest).alias("source_digest"),
        *rows.columns,
    ).write.mode("overwrite").json(path)
    return path


def read_manifests(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of several manifests with ``ordinal``, the place of their manifest in the list."""
    parts = [spark.read.json(p).withColumn("ordinal", F.lit(k)) for k, p in enumerate(paths)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def check_shards(shards: Sequence[int], published: int | None) -> list[int]:
    """The shards to fetch: whole numbers from 0 without gaps, as many as were published (if that is known)."""
    wanted = sorted(set(shards))
    if wanted != list(range(len(wanted))):
        raise ValueError(f"shards {wanted} are not 0 to {len(wanted) - 1}")
    if published is not None and published != len(wanted):
        raise ValueError(f"{len(wanted)} shards are listed, but {published} were published")
    return wanted


def tokenizing_outcome(results: DataFrame) -> dict[str, int]:
    """Counts of generated, skipped and failed chunks of ``results`` (status); an unreachable service ends the run with an error."""
    counts = {r["status"]: r["n"] for r in results.groupBy("status").agg(F.count("*").alias("n")).collect()}
    if counts.get("unreachable"):
        raise ConnectionError(f"the tokenizing service was not reached for {counts['unreachable']} chunks")
    return {s: counts.get(s, 0) for s in ("generated", "skipped", "failed")}


def token_sidecars(tokens: DataFrame, root: str, key: str, force: bool = False) -> int:
    """Write tokens of keys that have none yet, Zstandard-compressed; returns how many keys were new."""
    spark = tokens.sparkSession
    store = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    exists = store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(store)
    fresh = not_yet_done(tokens, spark.read.parquet(root), key, force) if exists else tokens
    found = fresh.select(key).distinct().count()
    if found:
        fresh.write.mode("overwrite" if force else "append").option("compression", "zstd").option(
            "parquet.compression.codec.zstd.level",
            TOKEN_LEVEL,
        ).parquet(root)
    return found
