"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

Base spans come from four patterns.  They are seeds, and so are quoted values
that something is set to and that look random (``key = "..."``, see
``_looks_secret``).  The words before a seed make a lexical pattern (its last
two tokens, and its last one, of up to ``CONTEXT_CHARS`` characters in all;
longer ones make none, and neither do those that would reach over another match
of the seed's kind).  Patterns and values form a graph.  In each round Spark
scores a pattern by what its distinct values weigh together (seeds 1, others
their score of the round before) over their number, and a value by the best
pattern that stands before it; only patterns that reach ``PROMOTE`` count, with
at least ``LEAST_VALUES`` known values.  A pattern may thus enter through values
that other patterns promoted.  Identifier-like tokens (with a digit) that end
with a score become spans: of kind ``secret`` where the token is itself such a
quoted value, and of kind ``found`` where only a learned pattern has found it;
base spans are never changed.

Only DataFrame functions are used.  The texts are read once; what follows works
on matches.  Which candidates lie clear of base spans is seen from running
extremes in the order of the text, so a document with very many matches costs a
sort of them and no pairs.  A match's position is the running length of what ``split`` leaves
between matches, so positions are code points and need no Python.  Patterns
are summed with map-side combination, and only those above the threshold are
joined back, so a word such as an article, which stands before very many
matches, is never joined.

The patterns are written so that Java's matcher stays linear and iterative:
repetitions are possessive over single characters and starts are tied to the
ends of runs, which gives the same matches as the plain forms.

Edge cases: a null or empty text has no spans; repeated rows are handled one by one;
an empty table gives an empty result; a null doc_id is an id like any other; other
columns are ignored or, in ``mask_documents``, carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loculus.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")
SECRET, FOUND = "secret", "found"
#: Rounds of scoring; share and number of known distinct values that make a pattern trusted.
ROUNDS = 3
PROMOTE = 0.9
LEAST_VALUES = 5
#: Most characters of a lexical pattern.
CONTEXT_CHARS = 96
#: Stands for what lies before the characters that are kept; no pattern holds it.
_CUT = "\uffff"
_LOCAL, _DOMAIN = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: Equal to the plain forms (email, ip, card, phone) in what they match; see above.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@(?=[{_DOMAIN}]++\.[{_DOMAIN}])(?:(?!\.(?![{_DOMAIN}]))[{_DOMAIN}.])++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:(?![\x20-](?![0-9]))[0-9\x20-])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "candidate": r"(?<![A-Za-z0-9_@.+-])(?=[A-Za-z_@.+-]*+[0-9])[A-Za-z0-9][A-Za-z0-9_@.+-]{3,}[A-Za-z0-9]",
}
#: A text without this holds no match.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}


def _matches(text: Column, kind: str) -> Column:
    """array of (no, kind, value, gap, before) for all matches; ``gap`` is the length of what lies between."""
    pattern = F.lit(PATTERNS[kind])
    values = F.regexp_extract_all(text, pattern, F.lit(0))

    def gap(p: Column, i: Column) -> Column:
        cut = (i > 0) | (F.length(p) > CONTEXT_CHARS)  # something stands before what is kept
        return F.struct(F.length(p).alias("gap"), F.concat(F.when(cut, _CUT).otherwise(""), F.right(p, F.lit(CONTEXT_CHARS))).alias("before"))

    gaps = F.transform(F.split(text, PATTERNS[kind], -1), gap)
    both = F.transform(
        F.arrays_zip(values.alias("v"), F.slice(gaps, F.lit(1), F.size(values)).alias("g")),
        lambda x, i: F.struct(i.alias("no"), F.lit(kind).alias("kind"), x["v"].alias("value"), x["g"]["gap"].alias("gap"), x["g"]["before"].alias("before")),
    )
    possible = F.contains(text, F.lit(_NEEDS[kind])) if kind in _NEEDS else text.rlike("[0-9]")
    return F.when(possible, both).otherwise(F.expr("cast(array() as array<struct<no:int,kind:string,value:string,gap:int,before:string>>)"))


def _luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(backwards, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, doubled(d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    parts = F.split(value, r"\.")
    return (
        F.when(kind == "ip", F.forall(parts, lambda p: p.rlike(r"^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
        .when(kind == "card", F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", F.length(digits).between(8, 15))
        .otherwise(True)
    )


def _contexts(before: Column) -> Column:
    """The lexical patterns before a match: its last two tokens and its last one, with what is attached."""
    plain = F.regexp_replace(F.lower(before), "[0-9]", "0")
    last = lambda n: F.regexp_extract(plain, rf"(?<![^\s])(?:[^\s]++\s++){{{n}}}[^\s]*+\s*+$", 0)
    return F.filter(F.array_distinct(F.array(last(2), last(1))), lambda c: (F.length(F.trim(c)) > 0) & ~F.contains(c, F.lit(_CUT)))


def _looks_secret(value: Column, before: Column) -> Column:
    """A quoted value behind an equals sign or a colon, of 24 letters and digits or more with both in it."""
    random = value.rlike("^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_-]{24,}$")
    return random & before.rlike(r"""[=:]\s*["']$""")


def find_matches(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(documents, matches): row, doc_id, text_hash; and row, kind, start, end, value, before of valid matches and candidates.

    ``row`` numbers the rows of ``docs`` (it is stored, so it stays the same from here on).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = scratch.table(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.xxhash64(text).alias("text_hash"),
            F.concat(*[_matches(text, k) for k in PATTERNS]).alias("hits"),
        ),
        "scanned",
    )
    hits = scanned.where(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    order = Window.partitionBy("row", "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(order)
    placed = hits.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    matches = scratch.table(placed.where(_valid(F.col("kind"), F.col("value"))).select("row", "kind", "start", "end", "value", "before"), "matches")
    return scanned.select("row", "doc_id", "text_hash"), matches


def free_candidates(matches: DataFrame) -> DataFrame:
    """row, start, end, value, before of candidates that overlap no base span."""
    is_base = F.col("kind") != "candidate"
    forward, backward = Window.partitionBy("row").orderBy("start"), Window.partitionBy("row").orderBy(F.desc("start"))
    marked = matches.withColumns({"reach": F.max(F.when(is_base, F.col("end"))).over(forward), "ahead": F.min(F.when(is_base, F.col("start"))).over(backward)})
    taken = (F.coalesce("reach", F.lit(0)) > F.col("start")) | (F.coalesce("ahead", F.col("end")) < F.col("end"))
    return marked.where(~is_base & ~taken).select("row", "start", "end", "value", "before")


def bootstrap(matches: DataFrame, scratch: Scratch, rounds: int = ROUNDS, promote: float = PROMOTE, least_values: int = LEAST_VALUES) -> DataFrame:
    """row, kind, start, end, value of candidates whose contexts are those of known personal data."""
    base = matches.where(F.col("kind") != "candidate")
    free = scratch.table(free_candidates(matches), "free")
    secrets = free.where(_looks_secret(F.col("value"), F.col("before"))).select(F.lit("secret").alias("kind"), "value", "before")
    seeds = base.select("kind", "value", "before").unionByName(secrets)
    seeds = scratch.table(seeds.select("kind", "value", F.explode(_contexts(F.col("before"))).alias("context")).distinct(), "seeds")
    unknown = scratch.table(free.select("value", F.explode(_contexts(F.col("before"))).alias("context")).distinct(), "unknown")
    values = seeds.select("context", "value").unionAll(unknown.select("context", "value")).groupBy("context").agg(F.count_distinct("value").alias("values"))
    # A pattern with enough known values has at least as many values.
    values = scratch.table(values.where(F.col("values") >= least_values), "values")
    known = None
    for k in range(rounds):
        # All patterns before a known value are scored anew, so new ones may enter in every round.
        edges = seeds.select("context", "kind", "value", F.lit(1.0).alias("weight"))
        if known is not None:
            edges = edges.unionByName(unknown.join(known, "value").select("context", "kind", "value", F.col("score").alias("weight")))
        edges = edges.groupBy("context", "kind", "value").agg(F.max("weight").alias("weight"))
        scored = edges.groupBy("context", "kind").agg(F.count("*").alias("known"), F.sum("weight").alias("weight")).where(F.col("known") >= least_values)
        trusted = scored.join(values, "context").withColumn("score", F.col("weight") / F.col("values")).where(F.col("score") >= promote)
        known = scratch.table(
            unknown.join(trusted.select("context", "kind", "score"), "context").groupBy("kind", "value").agg(F.max("score").alias("score")),
            f"known-{k}",
        )
    kind = F.when(_looks_secret(F.col("value"), F.col("before")), SECRET).otherwise(FOUND)
    return free.join(known.select("value").distinct(), "value", "left_semi").select("row", kind.alias("kind"), "start", "end", "value")


def find_spans(docs: DataFrame, scratch: Scratch, **options) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): as ``find_matches``, with kinds of ``KINDS``, ``secret`` and ``found``."""
    documents, matches = find_matches(docs, scratch)
    found = bootstrap(matches, scratch, **options)
    base = matches.where(F.col("kind") != "candidate").select("row", "kind", "start", "end", "value")
    return documents, scratch.table(base.unionByName(found), "spans")


def span_report(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """doc_id, n_<kind> of each base kind, ``secret`` and ``found``, base_spans and spans ("kind:start:end" by kind and start, comma-joined)."""
    documents, spans = find_spans(docs, scratch, **options)
    kinds = (*KINDS, SECRET, FOUND)
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    entry = F.struct(rank.alias("rank"), "start", "end", F.concat_ws(":", "kind", "start", "end").alias("shown"))
    by_row = spans.groupBy("row").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds],
        F.array_sort(F.collect_list(entry)).alias("all"),
    )

    def shown(entries: Column) -> Column:
        return F.array_join(F.transform(entries, lambda e: e["shown"]), ",")

    texts = by_row.select(
        "row",
        *[f"n_{k}" for k in kinds],
        shown(F.filter("all", lambda e: e["rank"] <= len(KINDS))).alias("base_spans"),
        shown(F.col("all")).alias("spans"),
    )
    joined = documents.join(texts, "row", "left")
    return joined.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in kinds],
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_spans", "spans")],
    )


def mask_documents(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """``docs`` with every span's text replaced by its kind in brackets; ``n_chars`` follows where it exists.

    Overlapping spans become one, named after the first of them.
    """
    documents, spans = find_spans(docs, scratch, **options)
    order = Window.partitionBy("row").orderBy("start", F.col("end").desc(), "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("opens", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn(
        "run",
        F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)),
    )
    merged = runs.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "opens")).alias("kind"))
    lists = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))
    plan = documents.join(lists, "row").select(F.col("doc_id").alias("plan_id"), F.col("text_hash").alias("plan_hash"), "spans").dropDuplicates(["plan_id", "plan_hash"])
    packed = docs.select(F.struct("*").alias("doc"))  # whatever the columns' names are
    text = F.col("doc")["text"]
    same = F.col("doc")["doc_id"].eqNullSafe(F.col("plan_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("plan_hash"))
    joined = packed.join(plan, same, "left")

    def piece(span: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.element_at("spans", F.greatest(i, F.lit(1)))["end"]).cast("int")
        return F.concat(F.substr(text, before + 1, span["start"].cast("int") - before), F.lit("["), F.upper(span["kind"]), F.lit("]"))

    tail = F.substr(text, F.element_at("spans", -1)["end"].cast("int") + 1)
    masked = F.concat(F.array_join(F.transform("spans", piece), ""), tail)
    out = joined.select("doc", F.when(F.col("spans").isNotNull(), masked).otherwise(text).alias("masked"), F.col("spans").isNotNull().alias("changed"))
    replaced = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        replaced["n_chars"] = F.when(F.col("changed"), F.length("masked").cast("long")).otherwise(F.col("doc")["n_chars"])
    return out.select(*[replaced.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
