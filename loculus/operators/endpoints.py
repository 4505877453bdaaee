"""Addresses and bodies of what a library publishes, as rows: one frame for each endpoint, one JSON line for each body."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loculus.functions.citekey import passage
from loculus.functions.urn import fragment_url, reading_url
from loculus.operators.publish import crc_shard

#: Addresses of what exists once for all texts.
SEARCH_INDEX, URN_INDEX, CITATION_INDEX, VERSION_URNS = "/collections/search-index.json", "/urn-index.json", "/citation-index.json", "/cts-urns.json"


def page_urls(versions: DataFrame, chunks: DataFrame, whole_library: bool = True) -> DataFrame:
    """(endpoint, url) of every page of ``versions`` (urn, scheme) with ``chunks`` (urn, scheme, cts_urn); the default scheme is "".

    Ten kinds: the search index (only of a whole library), first page, list of
    chunks and contents of a version; first page and contents of its other
    schemes; and reading views and fragments of chunks in both.
    """
    spark = versions.sparkSession
    default, other = versions.where("scheme = ''"), versions.where("scheme <> ''")
    here, there = chunks.where("scheme = ''"), chunks.where("scheme <> ''")
    base, scheme, part = F.col("urn"), F.col("scheme"), passage(F.col("cts_urn"))
    rows = lambda frame, name, *url: frame.select(F.lit(name).alias("endpoint"), F.concat(F.lit("/"), *[F.lit(u) if isinstance(u, str) else u for u in url]).alias("url"))
    found = [
        rows(default, "first_chunk", base, "/"),
        rows(default, "chunk_index", base, "/chunks.json"),
        rows(default, "contents", base, "/_toc/"),
        rows(other, "first_scheme_chunk", base, "/", scheme, "/"),
        rows(other, "scheme_contents", base, "/", scheme, "/_toc/"),
        here.select(F.lit("reading_view").alias("endpoint"), reading_url(base, part).alias("url")),
        there.select(F.lit("scheme_reading_view").alias("endpoint"), reading_url(base, part, scheme).alias("url")),
        here.select(F.lit("fragment").alias("endpoint"), fragment_url(base, part).alias("url")),
        there.select(F.lit("scheme_fragment").alias("endpoint"), fragment_url(base, part, scheme).alias("url")),
    ]
    if whole_library:
        found.append(spark.createDataFrame([("search_index", SEARCH_INDEX)], "endpoint string, url string"))
    return reduce(DataFrame.unionByName, found)


def chunk_lists(chunks: DataFrame) -> DataFrame:
    """(url, body): the passages of each version's default scheme in order, as JSON."""
    listed = F.array_sort(F.collect_list(F.struct("pos", passage(F.col("cts_urn")).alias("p"))))
    bodies = chunks.where("scheme = ''").groupBy("urn").agg(F.to_json(F.transform(listed, lambda x: x["p"])).alias("body"))
    return bodies.select(F.concat(F.lit("/"), "urn", F.lit("/chunks.json")).alias("url"), "body")


def urn_bodies(versions: DataFrame) -> DataFrame:
    """(key, body) of the index from works to their versions: one JSON list for each work, ordered by id."""
    fields = [c for c in ("version", "kind", "language", "label") if c in versions.columns]
    return versions.groupBy(F.col("work_urn").alias("key")).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("body"))


def first_pages(versions: DataFrame, first: DataFrame) -> DataFrame:
    """(key, body): every version's urn and the address of its first page, from ``first`` (urn, cts_urn)."""
    return versions.join(first, "urn").select(
        F.col("urn").alias("key"),
        F.to_json(F.struct(reading_url(F.col("urn"), passage(F.col("cts_urn"))).alias("href"))).alias("body"),
    )


def citation_bodies(authors: DataFrame, works: DataFrame) -> DataFrame:
    """(key, body): each author's entry of the citation index, from the gazetteer's tables.

    Abbreviations in order; works by urn, each with title, abbreviations and citation scheme (``flat`` where none is named).
    """
    scheme = F.coalesce(F.col("scheme"), F.lit("flat")) if "scheme" in works.columns else F.lit("flat")
    titles = works.groupBy("author", "work_urn").agg(F.first("title").alias("title"), F.array_sort(F.collect_set("abbrev")).alias("title_abbrevs"), F.first(scheme).alias("scheme"))
    entry = F.struct("title", "title_abbrevs", "scheme")
    listed = titles.groupBy("author").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("work_urn", entry.alias("entry"))))).alias("works"))
    names = authors.groupBy("author").agg(
        F.first("name").alias("name"), F.array_sort(F.collect_set("abbrev")).alias("name_abbrevs"), F.first("default_work").alias("default_work_urn")
    )
    body = F.to_json(F.struct("name", "name_abbrevs", "default_work_urn", "works"), {"ignoreNullFields": "false"})
    return names.join(listed, "author").select(F.col("author").alias("key"), body.alias("body"))


def search_bodies(entries: DataFrame) -> DataFrame:
    """(key, body): each version's entry of the typeahead index, from ``entries`` (title, author, corpus, ..., url)."""
    fields = ("title", "author", "corpus", "language", "corpus_id", "lang", "kind", "status", "editors", "url")
    return entries.select(F.col("url").alias("key"), F.to_json(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in fields])).alias("body"))


#: Endpoints that exist once for the whole library; a shard of pages leaves them to the run that has the manifests.
GLOBAL_ENDPOINTS = ("index", "collections", "search_index", "urn_index", "citation_index", "cts_urns", "research")
BUILD_MODES = ("full", "corpus-only", "global-only")


def build_plan(urls: DataFrame, mode: str = "full", shard: int = 0, shards: int = 1, manifests: int = 0) -> DataFrame:
    """Of ``urls`` (endpoint, url) those that one run writes: all, a shard of the pages, or only what manifests are enough for.

    A URL belongs to one shard, by its checksum, whatever else is built; ``global-only`` needs a manifest at least.
    """
    if mode not in BUILD_MODES:
        raise ValueError(f"mode {mode} is none of {', '.join(BUILD_MODES)}")
    if not 0 <= shard < shards:
        raise ValueError(f"shard {shard} is not in [0, {shards})")
    if mode == "global-only" and not manifests:
        raise ValueError("mode global-only needs a manifest at least")
    shared = F.col("endpoint").isin(*GLOBAL_ENDPOINTS)
    kept = urls if mode == "full" else urls.where(shared if mode == "global-only" else ~shared)
    mine = kept if shards == 1 else kept.where(crc_shard(F.col("url"), shards) == shard)
    return mine.dropDuplicates(["url"])


def write_bodies(bodies: DataFrame, root: str, name: str) -> str:
    """Write (key, body) rows as JSON lines in as many files as Spark has partitions, and return the folder."""
    path = f"{root}/{name}"
    bodies.write.mode("overwrite").json(path)
    return path


def hit_url(base: Column, ref: Column, token: Column) -> Column:
    """Where a hit is read: its passage with the token's urn, percent-encoded (a space as %20)."""
    encoded = F.regexp_replace(F.url_encode(token), r"\+", "%20")
    for plain in "!'()*":  # stay as they are in a component
        encoded = F.replace(encoded, F.lit(f"%{ord(plain):02X}"), F.lit(plain))
    return F.concat(F.lit("/"), base, F.lit(":"), ref, F.lit("/?token="), encoded)
