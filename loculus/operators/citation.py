"""Abbreviated citations such as "Thuc. 5.4": from typed text to work, version and passage.

The gazetteer is two frames: authors (author, name, abbrev, default_work) and
works (author, work_urn, title, pos, abbrev), one row per abbreviation.  Spans of up to
three leading words meet abbreviations by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loculus.functions.citekey import typed_key, typed_scope
from loculus.operators.align import prefix_floor_join

LEADING_TOKENS = 3
LANGUAGES_FIRST = ("grc", "lat")


def gazetteer_tables(records: DataFrame, deployed: DataFrame, skipped_namespace: str = "") -> tuple[DataFrame, DataFrame]:
    """(authors, works) from ``records`` (author, name, name_abbrevs, default_abbrev, works: array of work_urn, title, title_abbrevs).

    Only works in ``deployed`` (work_urn) count; authors without abbreviations,
    without such works or in the skipped namespace are left out; an author's
    default is the first work with the default abbreviation.
    """
    usable = records.where(F.size("name_abbrevs") > 0)
    if skipped_namespace:
        usable = usable.where(~F.col("author").startswith(f"urn:cts:{skipped_namespace}:"))
    works = usable.select(
        "author",
        "default_abbrev",
        F.posexplode("works").alias("pos", "w"),
    ).select("author", "default_abbrev", "pos", "w.*").join(deployed.select("work_urn").distinct(), "work_urn", "left_semi")
    defaults = works.groupBy("author").agg(
        F.min_by(
            F.when(F.array_contains("title_abbrevs", F.col("default_abbrev")), F.col("work_urn")),
            F.when(F.array_contains("title_abbrevs", F.col("default_abbrev")), F.col("pos")),
        ).alias("default_work")
    )
    authors = usable.join(defaults, "author").select("author", "name", F.explode("name_abbrevs").alias("abbrev"), "default_work")
    return authors, works.select("author", "work_urn", "title", "pos", F.explode_outer("title_abbrevs").alias("abbrev"))


def _spans(words: Column) -> Column:
    """(n, piece) of the leading spans of a word list, at most three words long."""
    most = F.least(F.size(words), F.lit(LEADING_TOKENS))
    return F.when(
        most > 0,
        F.transform(F.sequence(F.lit(1), most), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(words, F.lit(1), n), " ").alias("piece"))),
    )


def author_spans(queries: DataFrame, authors: DataFrame) -> DataFrame:
    """(query_id, words, n, author, default_work) for the longest leading span that names any author."""
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    opened = queries.select("query_id", words.alias("words")).withColumn(
        "s",
        F.explode(_spans(F.col("words"))),
    ).select("query_id", "words", "s.n", "s.piece")
    met = opened.join(authors.distinct(), F.col("piece") == F.col("abbrev"))
    longest = F.max("n").over(Window.partitionBy("query_id"))
    return met.withColumn("_m", longest).where("n = _m").select("query_id", "words", "n", "author", "default_work").distinct()


def match_citations(queries: DataFrame, authors: DataFrame, works: DataFrame) -> DataFrame:
    """(query_id, kind, work_urn, passage, options): resolved, choose-work, ambiguous or not-found.

    One distinct work among the longest work spans of the candidate authors
    resolves; several are ambiguous; with none, a single default work
    resolves, one author offers a choice of works, several authors are ambiguous.
    """
    found = author_spans(queries, authors)
    rest = found.withColumn("rest", F.slice("words", F.col("n") + 1, F.greatest(F.size("words") - F.col("n"), F.lit(0))))
    spans = rest.withColumn("s", F.explode(_spans(F.col("rest")))).select("query_id", "author", "rest", "s.n", "s.piece")
    hits = spans.join(
        works.where("abbrev is not null"),
        (spans["author"] == works["author"]) & (spans["piece"] == works["abbrev"]),
    ).select("query_id", spans["author"], "rest", "n", "work_urn", "pos")
    best = Window.partitionBy("query_id", "author").orderBy(F.desc("n"), "pos")
    hit = hits.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    tail = F.array_join(F.slice("rest", F.col("n") + 1, F.greatest(F.size("rest") - F.col("n"), F.lit(0))), " ")
    by_work = hit.withColumn("passage", typed_scope(tail)).groupBy("query_id").agg(
        F.count_distinct("work_urn").alias("w"),
        F.min_by("work_urn", "author").alias("w_urn"),
        F.min_by("passage", "author").alias("w_passage"),
    )
    by_author = rest.groupBy("query_id").agg(
        F.count_distinct("author").alias("a"),
        F.count_distinct(F.when(F.col("default_work").isNotNull(), F.col("author"))).alias("d"),
        F.max("default_work").alias("d_urn"),
        F.first(typed_scope(F.array_join("rest", " "))).alias("d_passage"),
    )
    options = rest.join(works.groupBy("author").agg(F.count_distinct("work_urn").alias("k")), "author").groupBy("query_id").agg(F.sum("k").alias("k"))
    all_ = queries.select("query_id").join(by_author, "query_id", "left").join(by_work, "query_id", "left").join(options, "query_id", "left")
    kind = (
        F.when(F.col("a").isNull(), "not-found")
        .when(F.col("w") == 1, "resolved")
        .when(F.col("w") > 1, "ambiguous")
        .when(F.col("d") == 1, "resolved")
        .when(F.col("a") == 1, "choose-work")
        .otherwise("ambiguous")
    )
    resolved = F.col("kind") == "resolved"
    count = F.when(F.col("w") > 1, F.col("w")).when(F.col("kind") == "choose-work", F.col("k")).when(F.col("kind") == "ambiguous", F.col("a"))
    return all_.withColumn("kind", kind).select(
        "query_id",
        "kind",
        F.when(resolved, F.coalesce("w_urn", "d_urn")).alias("work_urn"),
        F.when(resolved, F.when(F.col("w") == 1, F.col("w_passage")).otherwise(F.col("d_passage"))).alias("passage"),
        F.coalesce(count, F.lit(0)).cast("long").alias("options"),
    )


def citation_options(matches: DataFrame, authors: DataFrame, works: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, kind, label, work_urn, passage): what each matched query may mean: its one work, the works to choose from, or the authors' works."""
    resolved = matches.where("kind = 'resolved'").select("query_id", "kind", F.lit("").alias("label"), "work_urn", "passage")
    open_ = matches.where("kind in ('choose-work', 'ambiguous')").select("query_id", "kind")
    spans = author_spans(queries.join(open_.select("query_id"), "query_id", "left_semi"), authors)
    named = works.select("author", "work_urn", "title").distinct()
    offered = open_.join(spans, "query_id").join(named, "author").select(
        "query_id",
        "kind",
        F.col("title").alias("label"),
        "work_urn",
        typed_scope(F.element_at("words", -1)).alias("passage"),
    )
    return resolved.unionByName(offered)


def option_links(options: DataFrame, versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``options`` (query_id, work_urn, passage) with ``href``: the work's picked version at the chunk that holds the passage; works without a version drop out.

    The chunk is found as a reader's jump finds it: the lowest one below the
    place, else the one before it, else the first; without a passage the
    version's first page is meant.
    """
    picked = pick_versions(versions, ["work_urn"]).select("work_urn", F.col("urn").alias("_urn"))
    with_key = options.join(picked, "work_urn").withColumn("_key", typed_key(F.coalesce("passage", F.lit(""))))
    places = chunks.select(F.col("urn").alias("_urn"), "key", F.col("passage").alias("_chunk"), "pos")
    landed = prefix_floor_join(with_key, places, ["_urn"], "_key", "key", F.col("_chunk"), "pos")
    base = F.concat(F.lit("/"), F.col("_urn"))
    href = F.when(F.col("passage").isNull(), F.concat(base, F.lit("/"))).otherwise(
        F.concat(base, F.lit(":"), F.coalesce("landing", "passage"), F.lit("/"))
    )
    return landed.withColumn("href", href).select(*options.columns, "href")


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON gazetteer, an object of authors by id: author, name, name_abbrevs, default_abbrev, works."""
    work = "struct<urn:string,title:string,abbreviations:array<string>>"
    entry = f"struct<name:string,abbreviations:array<string>,default_abbreviation:string,works:array<{work}>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.map_entries(F.from_json("value", f"map<string,{entry}>"))).alias("e"))
    listed = F.transform(
        "e.value.works",
        lambda w: F.struct(w["urn"].alias("work_urn"), w["title"].alias("title"), w["abbreviations"].alias("title_abbrevs")),
    )
    empty = F.array().cast("array<string>")
    return whole.select(
        F.col("e.key").alias("author"),
        F.col("e.value.name").alias("name"),
        F.coalesce("e.value.abbreviations", empty).alias("name_abbrevs"),
        F.col("e.value.default_abbreviation").alias("default_abbrev"),
        listed.alias("works"),
    )


def pick_versions(versions: DataFrame, work: list[str]) -> DataFrame:
    """One version per work: in the first preferred language, else not English by language, else any; then by position."""
    rank = F.when(
        F.col("language") == LANGUAGES_FIRST[0],
        0,
    ).when(F.col("language") == LANGUAGES_FIRST[1], 1).when(F.col("language") != "eng", 2).otherwise(3)
    order = Window.partitionBy(*work).orderBy(rank, F.when(rank >= 2, F.col("language")), "pos")
    return versions.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
