"""Old addresses to present pages: pull an identifier out of a request and resolve it in steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extract_identifiers(requests: DataFrame, text_prefix: str) -> DataFrame:
    """``requests`` (request) with ``urn`` and ``text_id``: from the query's doc or urn, else from the path."""
    plain = F.regexp_replace(F.try_url_decode(F.regexp_replace("request", "^[a-z]+://[^/]*", "")), " ", "")
    plain = F.regexp_replace(F.coalesce(plain, F.col("request")), "/{2,}", "/")
    named = F.regexp_extract(plain, r"[?&](?:doc|urn)=([^&#]*)", 1)
    value = F.when(named != "", named).otherwise(F.regexp_extract(plain, r"^/(?:texts|citations|[a-z]+/text)/([^?#]*)", 1))
    urn = F.when(F.contains(value, F.lit("urn:cts:")), F.concat(F.lit("urn:cts:"), F.substring_index(value, "urn:cts:", -1)))
    text_id = F.when(urn.isNull() & value.startswith(text_prefix), F.regexp_extract(F.substr(value, F.lit(len(text_prefix) + 1)), "^([^:]*)", 1))
    return requests.withColumns({"urn": urn, "text_id": text_id})


def resolve(identified: DataFrame, legacy: DataFrame, versions: DataFrame, families: DataFrame, works: DataFrame) -> DataFrame:
    """``href`` by exact version, else by id family, else (for a urn of a work) by the work's first version; never another language."""
    named = identified.join(legacy.select("text_id", F.col("urn").alias("_l")), "text_id", "left").withColumn("_urn", F.coalesce("urn", "_l"))
    bare = F.regexp_replace("_urn", r"^(urn:cts:[^:]*:[^:]*).*$", "$1")
    parts = F.size(F.split(F.split_part("_bare", F.lit(":"), F.lit(4)), r"\."))
    keyed = named.withColumn("_bare", bare).withColumn("_parts", parts).withColumn("_family", F.regexp_replace("_bare", "[0-9]+$", ""))
    out = (
        keyed.join(versions.select(F.col("urn").alias("_bare"), F.col("href").alias("_exact")), "_bare", "left")
        .join(families.select(F.col("family").alias("_family"), F.col("href").alias("_kin")), "_family", "left")
        .join(works.select(F.col("work_urn").alias("_bare"), F.col("href").alias("_first")), "_bare", "left")
    )
    href = F.when(F.col("_parts") == 3, F.coalesce("_exact", "_kin")).when(F.col("_parts") == 2, F.col("_first"))
    return out.withColumn("href", href).select(*identified.columns, "href")
