"""Citation keys, aligned versions, and commentary on passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loculus.functions import citekey
from loculus.operators import align, overlap
from loculus.operators.toc import scheme_names
from loculus.operators.tokens import tokens_in_runs
from loculus.plans.bindings import BOOK_SECTIONS, CHUNKS_SQL, TOKENS_SQL, chunks, passages, table, tokens
from loculus.plans.catalogue import dotted, query

#: A version is aligned with the one whose document comes so much later: the next number of its work.
SIBLING = 100


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as urns with ranges, letters and odd components: "3.2a-3.4", "x3.2"; of versions cited by book only "3-5", "x3", "4a"."""
    c = chunks(spark, sf_dir)
    fine = F.col("num") % 2 == 1
    book, n = F.when(fine, F.col("key")[0]), F.when(fine, F.col("key")[1]).otherwise(F.col("key")[0])
    kind = F.when(fine, n).otherwise(n % 5 + 1)  # 1 and 2 make ranges, even ones have a letter behind, 5 one before
    one = lambda k: F.concat_ws(".", book.cast("string"), k.cast("string"))
    text = F.concat(
        F.when(kind == 5, "x").otherwise(""),
        one(n),
        F.when(kind % 2 == 0, "a").otherwise(""),
        F.when(kind < 3, F.concat(F.lit("-"), one(n + 2))).otherwise(""),
    )
    return c.select("doc_id", "pos", text.alias("citation"), F.concat(F.lit("urn:cts:x:y.z.v:"), text).alias("urn"), book.alias("book"), n.alias("n"))


_RANGES_SQL = f"""{CHUNKS_SQL},
ranges as (
    select doc_id, pos, case when num % 2 = 1 then key[1] || '.' else '' end as lead, case when num % 2 = 1 then '0.'
    else '' end as odd, num % 2 = 1 as fine,
           case when num % 2 = 1 then key[2] else key[1] end as n, case when num % 2 = 1 then key[2] else key[1] % 5 + 1 end as kind
    from chunks)"""


@query(f"with {_RANGES_SQL} select doc_id, pos, case when kind < 5 then lead || n when fine then '0.' || n else '0' end as key from ranges")
def cite_start_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir).select("doc_id", "pos", dotted(citekey.start_key(F.col("urn"))).alias("key"))


@query(
    f"""with {_RANGES_SQL} select doc_id, pos, case when kind < 3 then lead || (n + 2) when kind < 5 then lead
    || n when fine then '0.' || n else '0' end as key from ranges"""
)
def cite_end_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir).select("doc_id", "pos", dotted(citekey.end_key(F.col("urn"))).alias("key"))


@query(f"with {_RANGES_SQL} select doc_id, pos, lead || n as key from ranges")
def cite_typed_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranges(spark, sf_dir).select("doc_id", "pos", dotted(citekey.typed_key(F.col("urn"))).alias("key"))


@query(f"with {_RANGES_SQL} select doc_id, pos, lead || n || '-' || lead || (n + 1) as qualified from ranges")
def cite_qualify(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.concat("n", F.lit("-"), F.col("n") + 1)
    return _ranges(spark, sf_dir).select(
        "doc_id",
        "pos",
        citekey.qualify(bare, F.concat_ws(".", F.col("book").cast("string"), F.lit("1"))).alias("qualified"),
    )


@query(
    f"""with {CHUNKS_SQL} select a.doc_id, a.pos, abs(a.key[1] - b.key[1]) || '.' || abs(coalesce(a.key[2],
    0) - coalesce(b.key[2], 0)) as distance from chunks a join chunks b on b.doc_id = a.doc_id + 100 and b.pos = 0"""
)
def cite_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    first = c.where("pos = 0").select((F.col("doc_id") - SIBLING).alias("doc_id"), F.col("key").alias("other"))
    return c.join(first, "doc_id").select("doc_id", "pos", dotted(citekey.distance(F.col("key"), F.col("other"))).alias("distance"))


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Passages of versions, and those of their siblings, on a common ``doc_id``."""
    c = chunks(spark, sf_dir)
    return c.select("doc_id", "passage", "key"), c.select(
        (F.col("doc_id") - SIBLING).alias("doc_id"),
        F.col("passage").alias("sibling"),
        F.col("key").alias("start"),
        F.col("pos"),
    )


@query(f"""with {CHUNKS_SQL},
m as (select a.doc_id, a.passage, max(b.key) as f from chunks a left join chunks b on b.doc_id = a.doc_id + 100 and b.key <= a.key group by 1, 2)
select doc_id, passage, array_to_string(f, '.') as floor from m""")
def asof_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, sibling = _pair(spark, sf_dir)
    return align.floor_join(base, sibling, ["doc_id"], "key", "start", F.col("sibling"), "pos").select("doc_id", "passage", "floor")


@query(f"""with {CHUNKS_SQL},
pairs as (select a.doc_id, a.passage, a.key, b.key as start, b.passage as sibling, b.pos, b.key[1:len(a.key)] = a.key as below
    from chunks a left join chunks b on b.doc_id = a.doc_id + 100),
m as (select doc_id, passage, min(start) filter (below) as p, max(start) filter (start <= key) as f, min(start) as first from pairs group by 1, 2)
select doc_id, passage, array_to_string(coalesce(p, f, first), '.') as landing from m""")
def prefix_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, sibling = _pair(spark, sf_dir)
    return align.prefix_floor_join(base, sibling, ["doc_id"], "key", "start", F.col("sibling"), "pos").select("doc_id", "passage", "landing")


_NEAR_SQL = f"""with {CHUNKS_SQL},
pairs as (
    select a.doc_id, a.passage, b.passage as sibling,
           row_number() over (partition by a.doc_id, a.passage order by abs(a.key[1] - b.key[1]),
    abs(coalesce(a.key[2], 0) - coalesce(b.key[2], 0)), b.pos) as r
    from chunks a left join chunks b on b.doc_id = a.doc_id + 100)"""


@query(_NEAR_SQL + " select doc_id, passage, sibling as nearest from pairs where r = 1")
def nearest_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, sibling = _pair(spark, sf_dir)
    return align.nearest_join(base, sibling, ["doc_id"], "key", "start", F.col("sibling"), "pos").select("doc_id", "passage", "nearest")


@query(f"""with {CHUNKS_SQL}
select a.doc_id, a.passage, b.passage as sibling from chunks a join chunks b on b.doc_id = a.doc_id + 100
where b.key = a.key or (len(a.key) < len(b.key) and b.key[1:len(a.key)] = a.key)""")
def range_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, sibling = _pair(spark, sf_dir)
    bases = base.select("doc_id", "passage", F.col("key").alias("low"), F.col("key").alias("high"))
    return align.range_join(bases, sibling, ["doc_id"], "low", "high", "start").select("doc_id", "passage", "sibling")


@query(f"""with {CHUNKS_SQL},
ends as (select doc_id - 100 as doc_id, min(key) as lo, max(key) as hi from chunks group by 1),
bases as (select c.* from chunks c join ends e on c.doc_id = e.doc_id where c.key between lo and hi),
ranged as (
    select a.doc_id, a.passage, b.passage as aligned, 'range' as how from bases a join chunks b on b.doc_id = a.doc_id + 100
    where b.key = a.key or (len(a.key) < len(b.key) and b.key[1:len(a.key)] = a.key)),
near as (
    select a.doc_id, a.passage, b.passage as aligned, 'nearest' as how,
           row_number() over (partition by a.doc_id, a.passage order by abs(a.key[1] - b.key[1]),
    abs(coalesce(a.key[2], 0) - coalesce(b.key[2], 0)), b.pos) as r
    from bases a join chunks b on b.doc_id = a.doc_id + 100
    where not exists (from ranged r where r.doc_id = a.doc_id and r.passage = a.passage))
select * from ranged union all select doc_id, passage, aligned, how from near where r = 1""")
def sibling_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, sibling = _pair(spark, sf_dir)
    bases = base.select("doc_id", "passage", F.col("key").alias("low"), F.col("key").alias("high"))
    return align.align_siblings(bases, sibling, ["doc_id"], "low", "high", "start", "sibling", "pos").select("doc_id", "passage", "aligned", "how")


@query(f"""with {CHUNKS_SQL},
m as (select a.doc_id, a.passage, max(b.key) filter (b.key <= a.key) as f, min(b.key) as first
    from chunks a join chunks b on b.doc_id = a.doc_id + 100 group by 1, 2)
select doc_id, passage, array_to_string(coalesce(f, first), '.') as toggled from m""")
def scheme_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, other = _pair(spark, sf_dir)
    floors = align.floor_join(base, other, ["doc_id"], "key", "start", F.col("sibling"), "pos")
    first = other.groupBy("doc_id").agg(F.min_by("sibling", "pos").alias("first"))
    return floors.join(first, "doc_id").select("doc_id", "passage", F.coalesce("floor", "first").alias("toggled"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as commentary entries on three books each of the documents of one source."""
    items = table(spark, sf_dir, "benchmark")
    return items.select(
        (F.col("item_id") % 20).alias("group_key"),
        "item_id",
        F.lit("urn:cts:x:y").alias("work_urn"),
        F.concat_ws("-", F.col("item_id") % 7 + 1, F.col("item_id") % 7 + 3).alias("entry_citation"),
    )


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = chunks(spark, sf_dir).select(
        (F.col("doc_id") % 20).alias("group_key"),
        "doc_id",
        F.lit("urn:cts:x:y.z").alias("urn"),
        F.col("passage").alias("citation"),
    )
    return overlap.entries_for_passages(passages, _entries(spark, sf_dir))


_OVERLAPS_SQL = f"""{CHUNKS_SQL},
meeting as (
    select doc_id, passage, item_id from chunks c join benchmark b on c.doc_id % 20 = b.item_id % 20
    where c.key[1] between b.item_id % 7 + 1 and b.item_id % 7 + 3)"""


@query(f"with {_OVERLAPS_SQL} select doc_id, passage, item_id from meeting")
def overlap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir).select("doc_id", F.col("citation").alias("passage"), "item_id")


@query(
    f"""with {_OVERLAPS_SQL} select doc_id, passage, case when item_id % 3 = 0 then 'label' || (item_id % 2)
    else 'author' || (item_id % 4) end as label, min(item_id) as first, count(*) as n from meeting
    group by 1, 2, 3"""
)
def overlap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _overlaps(spark, sf_dir).select(
        "doc_id",
        F.col("citation").alias("passage"),
        "item_id",
        F.when(
            F.col("item_id") % 3 == 0,
            F.array().cast("array<string>"),
        ).otherwise(F.array(F.concat(F.lit("author"), F.col("item_id") % 4))).alias("authors"),
        F.concat(F.lit("label"), F.col("item_id") % 2).alias("source_label"),
        F.lit("").alias("body"),
    )
    return overlap.entry_groups(found, ["doc_id", "passage"], "item_id").select("doc_id", "passage", "label", "first", "n")


_SPANS_SQL = f"""with {_RANGES_SQL},
groups as (select doc_id, case when fine then lead else '' end as lead, case when fine then rtrim(lead,
    '.')::bigint else (n - 1) // 5 + 1 end as book, min(n) as low, max(n) as high from ranges
    group by 1, 2, 3)"""


@query(f"{_SPANS_SQL} select doc_id, book, case when low = high then lead || low else lead || low || '-' || lead || high end as span from groups")
def citation_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranges(spark, sf_dir)
    own = F.concat_ws(".", F.col("book").cast("string"), F.lit("1"))
    c = r.select(
        "doc_id",
        F.coalesce("book", F.floor((F.col("n") - 1) / 5) + 1).alias("book"),
        F.col("n").cast("string").alias("n"),
        own.alias("own"),
    )
    return overlap.citation_spans(c, ["doc_id", "book"], "n", "own")


@query(
    f"""{_SPANS_SQL} select doc_id, book, case when low = high then lead || low else lead || low || '-'
    || lead || high end as span from groups where book % 3 <> 0"""
)
def target_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of references to a commented work; every third book refers to another work and is absent."""
    r = _ranges(spark, sf_dir).withColumn("group", F.coalesce("book", F.floor((F.col("n") - 1) / 5) + 1))
    work = F.when(F.col("group") % 3 == 0, "urn:cts:x:other.w:").otherwise("urn:cts:x:y.z:")
    aimed = r.select(
        "doc_id",
        F.col("group").alias("book"),
        F.concat(work, F.concat_ws(".", F.col("book").cast("string"), F.col("n").cast("string"))).alias("reference"),
        F.lit("urn:cts:x:y.z").alias("about"),
    )
    return overlap.target_spans(aimed, ["doc_id", "book"], "reference", "about")


@query(
    f"""with {CHUNKS_SQL} select doc_id, passage, lag(passage) over w as prev, lead(passage) over w as next
    from chunks window w as (partition by doc_id order by pos)"""
)
def prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("pos")
    return chunks(spark, sf_dir).select("doc_id", "passage", F.lag("passage").over(order).alias("prev"), F.lead("passage").over(order).alias("next"))


@query(f"with {CHUNKS_SQL} select doc_id, first(passage order by pos) as first_chunk, count(*) as n_chunks from chunks group by 1")
def first_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).groupBy("doc_id").agg(F.min_by("passage", "pos").alias("first_chunk"), F.count("*").alias("n_chunks"))


@query(f"with {CHUNKS_SQL} select doc_id, passage, pos from chunks where passage = '2.1'")
def passage_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir).where("passage = '2.1'").select("doc_id", "passage", "pos")


@query(f"""with {CHUNKS_SQL}, asked as (select item_id, item_id || ':' || (item_id % 3 + 1) || '.1' as urn from benchmark)
select item_id, urn, pos from asked left join chunks on doc_id || ':' || passage = urn""")
def passages_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passage for each benchmark item by its urn; what a version doesn't have is not found."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.concat("item_id", F.lit(":"), F.col("item_id") % 3 + 1, F.lit(".1")).alias("urn"))
    return asked.join(passages(spark, sf_dir).select("urn", "pos"), "urn", "left").select("item_id", "urn", "pos")


@query(f"""with {TOKENS_SQL},
ends as (select doc_id, max(pos) as n from tokens group by 1),
runs as (select doc_id, r as run, r * 30 as lo, r * 30 + 30 as hi from (select doc_id, unnest(range(n // 30 + 2)) as r from ends))
select r.doc_id, run, count(t.pos) as n_tokens from runs r left join tokens t on t.doc_id = r.doc_id and t.pos >= lo and t.pos < hi group by 1, 2""")
def token_run_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokens(spark, sf_dir)
    ends = words.groupBy("doc_id").agg(F.max("pos").alias("n"))
    runs = ends.select(
        "doc_id",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 30) + 1)).alias("run"),
    ).select("doc_id", "run", (F.col("run") * 30).alias("start"), (F.col("run") * 30 + 30).alias("end"))
    held = tokens_in_runs(runs, words.select("doc_id", F.col("pos").alias("start_char"), "token"), ["doc_id"])
    return held.groupBy("doc_id", "run").agg(F.count("token").alias("n_tokens"))


_FILES_SQL = f"""with {CHUNKS_SQL},
ends as (select doc_id - 100 as doc_id, min(key) as lo, max(key) as hi from chunks group by 1),
bases as (select c.* from chunks c join ends e on c.doc_id = e.doc_id where c.key between lo and hi),
ranged as (
    select a.doc_id, a.passage, b.passage as aligned, 'range' as how, b.pos from bases a join chunks b on b.doc_id = a.doc_id + 100
    where b.key = a.key or (len(a.key) < len(b.key) and b.key[1:len(a.key)] = a.key)),
near as (
    select a.doc_id, a.passage, b.passage as aligned, 'nearest' as how, b.pos,
           row_number() over (partition by a.doc_id, a.passage order by abs(a.key[1] - b.key[1]),
    abs(coalesce(a.key[2], 0) - coalesce(b.key[2], 0)), b.pos) as r
    from bases a join chunks b on b.doc_id = a.doc_id + 100
    where not exists (from ranged r where r.doc_id = a.doc_id and r.passage = a.passage)),
aligned as (select doc_id, passage, aligned, how from (from ranged union all select doc_id, passage,
    aligned, how, pos from near where r = 1) where pos % 3 <> 1),
firsts as (select doc_id - 100 as doc_id, first(passage order by pos) as aligned from chunks where pos % 3 <> 1 group by 1)
select * from aligned union all
select b.doc_id, b.passage, f.aligned, 'first' as how from bases b join firsts f on f.doc_id = b.doc_id
    where not exists (from aligned a where a.doc_id = b.doc_id and a.passage = b.passage)"""


@query(_FILES_SQL)
def sibling_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``sibling_align`` where every third page of a sibling is missing."""
    base, sibling = _pair(spark, sf_dir)
    bases = base.select("doc_id", "passage", F.col("key").alias("low"), F.col("key").alias("high"))
    files = sibling.where(F.col("pos") % 3 != 1).select("doc_id", "sibling")
    return align.align_siblings(
        bases,
        sibling,
        ["doc_id"],
        "low",
        "high",
        "start",
        "sibling",
        "pos",
        files,
    ).select("doc_id", "passage", "aligned", "how")


@query("""with d as (select doc_id, case when doc_id % 4 = 0 then 'card' else '' end as scheme from documents),
schemes as (select doc_id, '' as scheme from documents where doc_id % 7 <> 3 union all select doc_id, 'card' from documents where doc_id % 3 = 0)
select d.doc_id, d.scheme, coalesce(a.scheme, b.scheme) as used from d left join schemes a on a.doc_id = d.doc_id and a.scheme = d.scheme
    left join schemes b on b.doc_id = d.doc_id and b.scheme = '' where coalesce(a.scheme, b.scheme) is not null""")
def scheme_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemes come from the paths of the versions' indexes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("v"), "doc_id").alias("version"))
    default = docs.where("doc_id % 7 <> 3").select("version", F.concat(F.lit("g/w/"), "version", F.lit("/index.json")).alias("path"))
    card = docs.where("doc_id % 3 = 0").select("version", F.concat(F.lit("g/w/"), "version", F.lit("/card/index.json")).alias("path"))
    schemes = scheme_names(default.unionByName(card))
    asked = docs.withColumn("scheme", F.when(F.col("doc_id") % 4 == 0, "card").otherwise(""))
    return align.in_scheme(asked, schemes, ["version"], "scheme").select("doc_id", "scheme", "used")


@query(
    f"""with {_OVERLAPS_SQL} select doc_id, passage, 'c' || (item_id % 5) as commentary, min(item_id) as first,
    count(*) as n from meeting group by 1, 2, 3"""
)
def commentary_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commentary links of every passage, grouped by commentary."""
    passages = chunks(spark, sf_dir).select(
        (F.col("doc_id") % 20).alias("group_key"),
        "doc_id",
        F.lit("urn:cts:x:y.z").alias("urn"),
        F.col("passage").alias("citation"),
    )
    items = _entries(spark, sf_dir).withColumnRenamed("entry_citation", "line_ref")
    links = items.withColumns({"commentary": F.concat(F.lit("c"), F.col("item_id") % 5), "target": F.concat(F.lit("#"), "item_id")})
    found = overlap.links_for_passages(passages, links).withColumnRenamed("citation", "passage")
    return overlap.link_groups(found, ["doc_id", "passage"], "item_id").select("doc_id", "passage", "commentary", "first", "n")


@query(f"with {CHUNKS_SQL} select doc_id as doc, passage from chunks")
def citable_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books with their sections as a numbered tree, and what of it is cited: sections, and books that have none."""
    c = chunks(spark, sf_dir)
    fine, at = F.col("num") % 2 == 1, F.pmod("pos", F.lit(BOOK_SECTIONS))
    enter = F.when(fine, F.col("pos") + F.floor(F.col("pos") / BOOK_SECTIONS) + 1).otherwise(F.col("pos"))
    cited = c.select("doc_id", F.struct(enter.alias("enter"), enter.alias("leave"), F.col("passage").alias("n")).alias("e"))
    held = F.count("*").over(Window.partitionBy("doc_id", F.floor(F.col("pos") / BOOK_SECTIONS)))
    first = c.withColumn("held", held).where(fine & (at == 0)).withColumn("book", F.col("key")[0].cast("string"))
    above = first.select("doc_id", F.struct((enter - 1).alias("enter"), (enter - 1 + F.col("held")).alias("leave"), F.col("book").alias("n")).alias("e"))
    nodes = cited.unionByName(above).select(F.col("doc_id").alias("doc"), "e.*", F.lit("div").alias("tag"), F.lit("section").alias("type"))
    return overlap.citable_leaves(nodes).select("doc", F.col("n").alias("passage"))


_NODES_SQL = "nodes as (select conv_id as doc, turn, case when role = 'user' then 'note' else 'p' end as tag from conversations)"


@query(f"with {_NODES_SQL} select doc, turn, row_number() over (partition by doc order by turn) as number from nodes where tag = 'note'")
def footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of users stand for notes."""
    turns = table(spark, sf_dir, "conversations")
    nodes = turns.select(
        F.col("conv_id").alias("doc"),
        "turn",
        F.array(F.lit(0), F.col("turn").cast("int")).alias("path"),
        F.when(F.col("role") == "user", "note").otherwise("p").alias("tag"),
    )
    return overlap.footnote_numbers(nodes).select("doc", "turn", "number")


@query(
    """select conv_id as doc, turn, unnest(case when turn % 3 = 0 then ['urn:x:' || turn, 'urn:y:' || turn] when turn % 3 = 1 then ['urn:x:' || turn] else [] end) as reference from conversations"""
)
def corresp_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    one, two = F.concat(F.lit(" urn:x:"), "turn"), F.concat(F.lit("urn:x:"), "turn", F.lit("  urn:y:"), "turn")
    nodes = turns.select(
        F.col("conv_id").alias("doc"),
        "turn",
        F.array(F.col("turn").cast("int")).alias("path"),
        F.when(F.col("turn") % 3 == 0, two).when(F.col("turn") % 3 == 1, one).alias("corresp"),
    )
    return overlap.corresp_values(nodes).select("doc", F.col("path")[0].cast("long").alias("turn"), "reference")


@query(f"""with {CHUNKS_SQL},
anchors as (select doc_id as version, 'a' || doc_id || '.' || k as anchor_id, k from documents, range(3) t(k)),
held as (select a.version, a.anchor_id, c.passage from anchors a join chunks c on c.doc_id = a.version and c.pos = a.k and a.k <> 1),
single as (select doc_id as version, any_value(passage) as passage from chunks group by 1 having count(*) = 1)
select a.version, a.anchor_id, coalesce(h.passage, o.passage) as chunk from anchors a left join held h using (version,
    anchor_id) left join single o on o.version = a.version""")
def anchor_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three anchors for each document; the second one is in no chunk."""
    c = chunks(spark, sf_dir).select(F.col("doc_id").alias("version"), F.col("passage").alias("chunk"), "pos")
    name = lambda k: F.concat(F.lit("a"), "version", F.lit("."), k)
    anchors = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("version"), F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k"))
    held = c.where("pos in (0, 2)").select("version", "chunk", name(F.col("pos")).alias("anchor_id"))
    return overlap.chunk_of_anchor(
        anchors.select("version", name(F.col("k")).alias("anchor_id")),
        held,
        c.select("version", "chunk"),
    ).select("version", "anchor_id", "chunk")
