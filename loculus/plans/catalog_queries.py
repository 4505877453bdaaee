"""The catalogue of versions that the documents stand for."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loculus.functions import urn as U
from loculus.operators import catalog, citation, endpoints, facets, publish, redirect, snapshots, title_index
from loculus.plans.bindings import CHUNKS_SQL, VERSIONS_SQL, chunks, table, titles, versions
from loculus.plans.catalogue import query
from loculus.session import work_folder

WORK = ["textgroup", "work"]
CHOSEN = {"language": ["eng", "fre"], "kind": ["edition"]}
FACETS = ("corpus", "language", "kind", "status")
FUZZY_THRESHOLD = 0.75


def _with_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).withColumn("status", catalog.version_status(F.col("experimental")))


def _facet_index(spark: SparkSession, sf_dir: str) -> facets.FacetIndex:
    rows = _with_status(spark, sf_dir).select("urn", "title", *FACETS)
    return facets.facet_index(rows, "urn", FACETS)


_PREFERRED_SQL = f"""{VERSIONS_SQL},
open as (
    select *, regexp_replace(version, '[0-9]+$', '') as family, experimental and bool_or(not experimental) over (partition by textgroup,
    work, kind) as closed
    from versions),
preferred as (
    select *, not closed and row_number() over (partition by textgroup, work, kind, family, closed
    order by num desc, doc_id) = 1 as preferred from open)"""
_ORDER = "experimental, case kind when 'edition' then 1 when 'translation' then 2 else 3 end, not preferred, not starts_with(version, 'pub-'), lower(label), version"


def _preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.with_preferred(versions(spark, sf_dir), WORK, "doc_id")


@query(f"with {VERSIONS_SQL} select doc_id, urn, kind, original from versions")
def version_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).select("doc_id", "urn", "kind", "original")


@query(f"with {VERSIONS_SQL} select doc_id, regexp_replace(version, '[0-9]+$', '') as family, num as number from versions")
def version_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    family, number = U.family(F.col("version"))
    return versions(spark, sf_dir).select("doc_id", family.alias("family"), number.alias("number"))


@query(f"with {_PREFERRED_SQL} select doc_id, urn, preferred from preferred")
def preferred_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preferred(spark, sf_dir).select("doc_id", "urn", "preferred")


_BEST_SQL = f"""{_PREFERRED_SQL},
best as (select *, row_number() over (partition by textgroup, work, family order by experimental, num desc, {_ORDER}) as r from preferred)"""


@query(f"with {_BEST_SQL} select textgroup, work, family, version, num as number from best where r = 1")
def family_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.family_best(_preferred(spark, sf_dir), WORK)


@query(f"with {_PREFERRED_SQL} select urn, '/' || urn || ':1/' as href, kind, language, experimental from preferred")
def urn_map_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preferred(spark, sf_dir).select("urn", U.reading_url(F.col("urn"), F.lit("1")).alias("href"), "kind", "language", "experimental")


@query(f"with {_BEST_SQL} select work_urn || '.' || family as family_urn, urn from best where r = 1")
def urn_map_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = catalog.family_best(_preferred(spark, sf_dir).withColumn("stem", F.col("work_urn")), [*WORK, "stem"])
    return best.select(F.concat_ws(".", "stem", "family").alias("family_urn"), F.concat_ws(".", "stem", "version").alias("urn"))


@query(f"with {_PREFERRED_SQL} select work_urn, string_agg(version, ' ' order by {_ORDER}) as versions from preferred group by 1")
def urn_map_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = catalog.work_orders(_preferred(spark, sf_dir), WORK)
    lists = catalog.ordered_lists(placed, ["work_urn"], "place", "version", "versions")
    return lists.select("work_urn", F.array_join("versions", " ").alias("versions"))


@query(
    f"""with {VERSIONS_SQL} select work_urn, count(*) as n, string_agg(version, ' ' order by version) as versions
    from versions where language is not null group by 1"""
)
def urn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = versions(spark, sf_dir).where("language is not null")
    lists = catalog.ordered_lists(found, ["work_urn"], "version", "version", "versions")
    return lists.select("work_urn", F.size("versions").cast("long").alias("n"), F.array_join("versions", " ").alias("versions"))


@query(
    f"""with {VERSIONS_SQL} select corpus, count(distinct textgroup) as groups, count(distinct work_urn) as works,
    count(*) as versions from versions group by 1"""
)
def catalog_tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = catalog.catalog_tree(versions(spark, sf_dir))
    works = F.flatten(F.transform("textgroups", lambda g: g["works"]))
    return tree.select(
        "corpus",
        F.size("textgroups").cast("long").alias("groups"),
        F.size(works).cast("long").alias("works"),
        F.size(F.flatten(F.transform(works, lambda w: w["versions"]))).cast("long").alias("versions"),
    )


@query(
    f"""with {VERSIONS_SQL} select doc_id, work_urn, kind, row_number() over (partition by work_urn,
    kind order by experimental, not starts_with(version, 'pub-'), lower(label), version) as place
    from versions"""
)
def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("work_urn", "kind").orderBy(*catalog.display_keys())
    return versions(spark, sf_dir).select("doc_id", "work_urn", "kind", F.row_number().over(order).cast("long").alias("place"))


@query(f"""with {VERSIONS_SQL},
rows as (select *, case when experimental then 'experimental' else 'curated' end as status, language in ('eng',
    'fre') as l, kind = 'edition' as k from versions)
select 'corpus' as facet, corpus as value, count(distinct urn) filter (l and k) as n from rows group by 2
union all select 'language', language, count(distinct urn) filter (k) from rows group by 2
union all select 'kind', kind, count(distinct urn) filter (l) from rows group by 2
union all select 'status', status, count(distinct urn) filter (l and k) from rows group by 2""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.facet_counts(_facet_index(spark, sf_dir), CHOSEN)


@query(f"""with {VERSIONS_SQL},
rows as (select *, case when experimental then 'experimental' else 'curated' end as status, language in ('eng', 'fre') as l, kind = 'edition' as k,
    contains(lower(strip_accents(title)), 'e') as t from versions)
select 'corpus' as facet, corpus as value, count(distinct urn) filter (l and k and t) as n from rows group by 2
union all select 'language', language, count(distinct urn) filter (k and t) from rows group by 2
union all select 'kind', kind, count(distinct urn) filter (l and t) from rows group by 2
union all select 'status', status, count(distinct urn) filter (l and k and t) from rows group by 2""")
def facet_counts_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts under the choices and a typed part of the title."""
    return facets.facet_counts(_facet_index(spark, sf_dir), CHOSEN, catalog.holds_folded(F.col("title"), "E"))


@query(f"with {VERSIONS_SQL} select count(*) filter (language in ('eng', 'fre') and kind = 'edition') as shown, count(*) as total from versions")
def facet_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.shown(_facet_index(spark, sf_dir), CHOSEN)


@query(f"with {VERSIONS_SQL} select urn, title from versions where language in ('eng', 'fre') and kind = 'edition' and contains(lower(strip_accents(title)), 'the')")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).where(catalog.facet_match(CHOSEN, ("title", "THE"))).select("urn", "title")


@query(f"with {VERSIONS_SQL} select urn, title from versions where contains(lower(strip_accents(title)), 'ee')")
def accents_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that hold a part, accents aside."""
    return versions(spark, sf_dir).where(catalog.holds_folded(F.col("title"), "Éé")).select("urn", "title")


@query(
    f"""with {VERSIONS_SQL} select distinct 'language' as facet, language as value, case language when 'eng' then 'English'
    when 'deu' then 'German' when 'fre' then 'French' when 'spa' then 'Spanish' end as label
    from versions"""
)
def option_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).select(
        F.lit("language").alias("facet"),
        F.col("language").alias("value"),
        catalog.lookup(catalog.LANGUAGE_LABELS, F.col("language")).alias("label"),
    ).distinct()


@query(
    f"""with {VERSIONS_SQL} select title, textgroup as author, corpus, language, kind, case when experimental then 'experimental'
    else 'curated' end as status, '/' || urn || ':1/' as url from versions"""
)
def search_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_status(spark, sf_dir).select(
        "title",
        F.col("textgroup").alias("author"),
        "corpus",
        "language",
        "kind",
        "status",
        U.reading_url(F.col("urn"), F.lit("1")).alias("url"),
    )


@query(
    f"""with {VERSIONS_SQL} select v.about as work_urn, v.urn as version_urn from versions v where about is not null and about <> work_urn and about in (select work_urn
    from versions)"""
)
def commentary_cross_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.attach_commentaries(versions(spark, sf_dir).withColumnRenamed("urn", "version_urn"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three overlapping catalogues: each document in one or two of them."""
    v = versions(spark, sf_dir)
    one = v.withColumn("ordinal", F.pmod("doc_id", F.lit(3)))
    two = v.where("doc_id % 2 = 0").withColumn("ordinal", F.pmod("doc_id", F.lit(3)) + 3)
    return one.unionByName(two).withColumns({"title": F.concat("title", F.lit("@"), "ordinal"), "label": F.concat("label", F.lit("@"), "ordinal")})


@query(
    f"""with {VERSIONS_SQL} select urn, title || '@' || (doc_id % 3) as title, label || '@' || (doc_id % 3 + case when doc_id % 2 = 0 then 3 else 0 end) as label from versions"""
)
def merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.merge_catalogs(_parts(spark, sf_dir), ["urn"], ["title"], ["label"])


@query(
    f"""with {VERSIONS_SQL} select work_urn, version, label || '@' || (doc_id % 3 + case when doc_id % 2 = 0 then 3
    else 0 end) as label, 5 as schema_version from versions"""
)
def manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir).select("ordinal", "work_urn", "version", "label", F.lit(publish.MANIFEST_VERSION).alias("schema_version"))
    return publish.merge_manifests(parts)


@query(
    f"""with {VERSIONS_SQL} select textgroup || '.' || work || '.' || version as id from versions where textgroup = 'src7' and doc_id % 2 = 0 union select 'file.' || doc_id from versions where textgroup = 'src7'"""
)
def experimental_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one flagged repository contributes: versions that are catalogued there, and its files' names."""
    v = versions(spark, sf_dir).withColumn("repo", F.col("textgroup"))
    files = v.select("repo", F.concat(F.lit("data/x/file."), "doc_id", F.lit(".xml")).alias("path"))
    return catalog.experimental_ids(v.where("doc_id % 2 = 0"), files, ["src7"])


@query(f"""with {VERSIONS_SQL} select work_urn, version, language from versions
qualify row_number() over (partition by work_urn order by case when language <> 'eng' then 2 else 3 end, language, doc_id) = 1""")
def version_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citation.pick_versions(versions(spark, sf_dir).withColumn("pos", F.col("doc_id")), ["work_urn"]).select("work_urn", "version", "language")


@query(f"""with {VERSIONS_SQL}, flags as (select urn, case when doc_id % 5 = 0 then urn || ':1.2'
    when doc_id % 5 = 1 then work_urn when doc_id % 5 = 2 then 'x' || urn else urn end as given
    from versions)
select urn, given, starts_with(given, 'urn:cts:') and len(string_split(split_part(given, ':', 4), '.')) = 3 as valid from flags""")
def urn_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    given = F.when(
        k == 0,
        F.concat("urn", F.lit(":1.2")),
    ).when(k == 1, F.col("work_urn")).when(k == 2, F.concat(F.lit("x"), "urn")).otherwise(F.col("urn"))
    return versions(spark, sf_dir).select("urn", given.alias("given")).withColumn("valid", U.is_version_urn(F.col("given")))


@query(f"""with {VERSIONS_SQL} select urn, work_urn, corpus || '/' || textgroup || '/' || work
    || '/' || version as path, '/' || urn || '/card:3.4/_text/' as fragment, textgroup || '.'
    || work || '.' || version as version_id,
urn || ':1.2@que[3]' as token from versions""")
def urn_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = F.concat("urn", F.lit(":1.2"))
    return versions(spark, sf_dir).select(
        "urn",
        U.work_urn(cited).alias("work_urn"),
        U.path(cited).alias("path"),
        U.fragment_url(F.col("urn"), F.lit("3.4"), F.lit("card")).alias("fragment"),
        U.version_id(cited).alias("version_id"),
        U.token_urn(F.col("urn"), F.lit("1.2"), F.lit("que"), F.lit(3)).alias("token"),
    )


@query(f"""with {VERSIONS_SQL} select corpus, count(*) filter (kind = 'edition') as edition,
    count(*) filter (kind = 'translation') as translation, count(*) filter (kind = 'commentary') as commentary,
count(*) as total, round(100.0 * count(*) / max(count(*)) over (), 4) as percent from versions group by rollup (corpus)""")
def family_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.crosstab(versions(spark, sf_dir), "corpus", "kind", catalog.KINDS).drop("is_total")


@query(f"""with {_BEST_SQL}, asked as (select doc_id, work_urn || '.' || case when doc_id % 3 = 0 then version
    when doc_id % 3 = 1 then family || '999' else 'none-grc1' end as urn from preferred),
kin as (select work_urn || '.' || family as f, urn from best where r = 1)
select a.doc_id, coalesce(p.urn, k.urn) as href from asked a left join preferred p on p.urn = a.urn
    left join kin k on k.f = regexp_replace(a.urn, '[0-9]+$', '')""")
def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _preferred(spark, sf_dir)
    family, _ = U.family(F.col("version"))
    k = F.col("doc_id") % 3
    asked = chosen.select(
        "doc_id",
        F.concat(
            F.lit("/texts/"),
            "work_urn",
            F.lit("."),
            F.when(k == 0, F.col("version")).when(k == 1, F.concat(family, F.lit("999"))).otherwise("none-grc1"),
        ).alias("request"),
    )
    best = catalog.family_best(chosen.withColumn("stem", F.col("work_urn")), [*WORK, "stem"])
    families = best.select(F.concat_ws(".", "stem", "family").alias("family"), F.concat_ws(".", "stem", "version").alias("href"))
    works = chosen.groupBy("work_urn").agg(F.min("urn").alias("href"))
    legacy = spark.createDataFrame([], "text_id string, urn string")
    found = redirect.resolve(
        redirect.extract_identifiers(asked, "old:text:"),
        legacy,
        chosen.select("urn", F.col("urn").alias("href")),
        families,
        works,
    )
    return found.select("doc_id", "href")


def _gazetteer(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers' nations as authors with market segments as works; orders' notes as typed citations."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.initcap("n_name").alias("name"))
    works = F.array(
        *[
            F.struct(
                F.concat(F.lit("urn:cts:n:a"), "n_nationkey", F.lit(f".w{i}")).alias("work_urn"),
                F.lit(f"Title {i}").alias("title"),
                F.array(F.lit(f"T{i}."), F.lit(f"Tit. {i}")).alias("title_abbrevs"),
            ) for i in range(3)
        ]
    )
    records = nations.select(
        F.concat(F.lit("a"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("author"),
        "name",
        F.array(F.concat(F.lit("N"), F.col("n_nationkey") % 20, F.lit("."))).alias("name_abbrevs"),
        F.when(F.col("n_nationkey") % 4 == 0, "T1.").alias("default_abbrev"),
        works.alias("works"),
    )
    deployed = nations.select(F.concat(F.lit("urn:cts:n:a"), "n_nationkey").alias("s")).select(
        F.explode(F.array(*[F.concat("s", F.lit(f".w{i}")) for i in range(3)])).alias("work_urn")
    )
    authors, listed = citation.gazetteer_tables(records, deployed)
    key = F.col("o_orderkey")
    text = F.concat(
        F.lit("N"),
        key % 22,
        F.lit(". "),
        F.when(key % 3 == 0, F.concat(F.lit("T"), key % 4, F.lit(". "))).otherwise(""),
        key % 9 + 1,
        F.lit("."),
        key % 50,
    )
    queries = table(spark, sf_dir, "orders").select(key.alias("query_id"), text.alias("text"))
    return queries, authors, listed


_CITED_SQL = """
asked as (select o_orderkey as query_id, o_orderkey % 22 as a, case when o_orderkey % 3 = 0 then o_orderkey % 4 end as t,
    (o_orderkey % 9 + 1) || '.' || (o_orderkey % 50) as scope from orders),
authors as (select n_nationkey as n, n_nationkey % 20 as a, n_nationkey % 4 = 0 as d from nation),
found as (select query_id, any_value(t) as t, any_value(scope) as scope, count(n) as authors,
    count(n) filter (d) as defaults, min(n) filter (d) as d_author, min(n) as first_author from asked q
    left join authors using (a) group by 1)"""


@query(f"with {_CITED_SQL} select query_id, authors as n_authors from found where authors > 0")
def author_span_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, authors, _ = _gazetteer(spark, sf_dir)
    return citation.author_spans(queries, authors).groupBy("query_id").agg(F.count_distinct("author").alias("n_authors"))


@query(f"""with {_CITED_SQL},
kinds as (
    select *, case when authors = 0 then 'not-found' when t < 3 and authors = 1 then 'resolved'
    when t < 3 then 'ambiguous' when defaults = 1 then 'resolved' when authors = 1 then 'choose-work'
    else 'ambiguous' end as kind from found)
select query_id, kind, case when kind = 'resolved' then 'urn:cts:n:a' || (case when t < 3 then first_author
    || '.w' || t else d_author || '.w1' end) end as work_urn,
       case when kind = 'resolved' and (t is null or t < 3) then scope end as passage,
       case when kind = 'choose-work' then 3 when kind = 'ambiguous' then authors else 0 end as options from kinds""")
def citation_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citation.match_citations(*_gazetteer(spark, sf_dir))


TITLE_ASKED = "the and attion"


@query(f"""with {VERSIONS_SQL},
plain as (select urn, textgroup, regexp_replace(title, '[^ -~]', '?', 'g') as title from versions),
scored as (
    select *, least(case when contains(lower(title), '{TITLE_ASKED}') then 0.0 else levenshtein(lower(title),
    '{TITLE_ASKED}')::double / greatest(length(title), {len(TITLE_ASKED)}) end,
                    levenshtein(lower(textgroup), '{TITLE_ASKED}')::double / greatest(length(textgroup), {len(TITLE_ASKED)}), 1.0) as raw from plain)
select title, textgroup as author, '' as editors, urn as url, round(raw, 6) as score from scored
    where round(raw, 6) <= {FUZZY_THRESHOLD} order by score, title, url limit 50""")
def fuzzy_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles near a typed one; the stand-in titles share few words with it, so more distance is allowed than by default.

    Letters outside ASCII are replaced on both sides: DuckDB counts edits in bytes.
    """
    return title_index.fuzzy_titles(titles(spark, sf_dir), TITLE_ASKED, threshold=FUZZY_THRESHOLD)


@query(f"""with {VERSIONS_SQL},
plain as (select urn, textgroup, regexp_replace(title, '[^ -~]', '?', 'g') as title from versions),
typed as (select substr(title, 1, 5) || 'x' || substr(title, 6, 3) || substr(title, 10) as asked from plain where length(title) = 16 order by urn limit 1),
scored as (
    select plain.*, least(case when contains(lower(title), lower(asked)) then 0.0
                               else levenshtein(lower(title), lower(asked))::double / greatest(length(title), length(asked)) end,
                          levenshtein(lower(textgroup), lower(asked))::double / greatest(length(textgroup), length(asked)), 1.0) as raw
    from plain, typed)
select title, textgroup as author, '' as editors, urn as url, round(raw, 6) as score from scored where round(raw, 6) <= 0.3
order by score, title, url limit 50""")
def fuzzy_misspelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is near the first title with one letter too many and one left out, at the default distance."""
    found = titles(spark, sf_dir)
    first = found.entries.where(F.length("title") == 16).orderBy("url").select("title").first()
    asked = "" if first is None else first.title[:5] + "x" + first.title[5:8] + first.title[9:]
    return title_index.fuzzy_titles(found, asked)


@query("""with works as (select n_nationkey::bigint as n, unnest([0, 1, 2]) as i from nation)
select w.n as author, i, 'Title ' || i as title, i = 1 and w.n % 4 = 0 as is_default,
       dense_rank() over (order by upper(n_name[1]) || lower(n_name[2:]), w.n) as author_place,
    row_number() over (partition by w.n order by i) as work_place
from works w join nation on n_nationkey = w.n""")
def abbreviation_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, authors, works = _gazetteer(spark, sf_dir)
    named = works.select("author", "work_urn", "title", "pos").distinct().join(authors.select("author", "name", "default_work").distinct(), "author")
    number = F.substr("author", F.lit(2)).cast("long")
    # authors are few beside works: their places come from one row each
    places = authors.select("author", "name").distinct().select(
        "author",
        F.row_number().over(Window.orderBy("name", "author")).cast("long").alias("author_place"),
    )
    within = F.row_number().over(Window.partitionBy("author").orderBy("title", "pos")).cast("long")
    return named.join(places, "author").select(
        number.alias("author"),
        F.col("pos").alias("i"),
        "title",
        F.equal_null("work_urn", "default_work").alias("is_default"),
        "author_place",
        within.alias("work_place"),
    )


@query(
    f"""with {VERSIONS_SQL} select urn, work_urn, row_number() over (partition by work_urn order by case
    when language = original then 0 when language <> 'eng' then 1 else 2 end, lower(label), version) as place
    from versions"""
)
def link_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("language") == F.col("original"), 0).when(F.col("language") != "eng", 1).otherwise(2)
    order = Window.partitionBy("work_urn").orderBy(rank, F.lower("label"), "version")
    return versions(spark, sf_dir).select("urn", "work_urn", F.row_number().over(order).cast("long").alias("place"))


@query(f"with {VERSIONS_SQL} select urn, work_urn, row_number() over (partition by work_urn order by experimental, doc_id) as place from versions")
def sibling_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("work_urn").orderBy("experimental", "doc_id")
    return versions(spark, sf_dir).select("urn", "work_urn", F.row_number().over(order).cast("long").alias("place"))


def _chunks_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Versions with their schemes (every third document has a second one), and chunks with urns in both."""
    v = versions(spark, sf_dir).select("doc_id", "urn", "work_urn", "version", "kind", "language", "label")
    schemes = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(""), F.lit("card"))).otherwise(F.array(F.lit("")))
    named = v.withColumn("scheme", F.explode(schemes))
    listed = named.join(chunks(spark, sf_dir).select("doc_id", "pos", "passage", "key"), "doc_id")
    return named, listed.withColumn("cts_urn", F.concat_ws(":", "urn", "passage"))


@query(f"""with {VERSIONS_SQL}, {CHUNKS_SQL},
other as (select * from versions where doc_id % 3 = 0),
parts as (select v.urn, v.doc_id, passage from versions v join chunks c on c.doc_id = v.doc_id)
select 'search_index' as endpoint, '/collections/search-index.json' as url
union all select 'first_chunk', '/' || urn || '/' from versions union all select 'chunk_index',
    '/' || urn || '/chunks.json' from versions union all select 'contents', '/' || urn || '/_toc/'
    from versions
union all select 'first_scheme_chunk', '/' || urn || '/card/' from other union all select 'scheme_contents', '/' || urn || '/card/_toc/' from other
union all select 'reading_view', '/' || urn || ':' || passage || '/' from parts union all select 'fragment',
    '/' || urn || ':' || passage || '/_text/' from parts
union all select 'scheme_reading_view', '/' || urn || '/card:' || passage || '/' from parts
    where doc_id % 3 = 0 union all select 'scheme_fragment', '/' || urn || '/card:' || passage
    || '/_text/' from parts where doc_id % 3 = 0""")
def endpoint_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoints.page_urls(*_chunks_of(spark, sf_dir))


@query(
    f"with {VERSIONS_SQL}, {CHUNKS_SQL} select '/' || urn || '/chunks.json' as url, '[' || string_agg('\"' || passage || '\"', ',' order by pos) || ']' as body from versions v join chunks c on c.doc_id = v.doc_id group by urn"
)
def chunk_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoints.chunk_lists(_chunks_of(spark, sf_dir)[1])


@query(f"""with {VERSIONS_SQL}, {CHUNKS_SQL}, firsts as (select doc_id, first(passage order by pos) as passage from chunks group by 1)
select urn as key, '{{"href":"/' || urn || ':' || passage || '/"}}' as body from versions v join firsts f on f.doc_id = v.doc_id""")
def first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    named, listed = _chunks_of(spark, sf_dir)
    first = listed.where("scheme = ''").groupBy("urn").agg(F.min_by("cts_urn", "pos").alias("cts_urn"))
    return endpoints.first_pages(named.where("scheme = ''"), first)


@query(
    f"with {VERSIONS_SQL} select work_urn as key, '[' || string_agg('{{\"version\":\"' || version || '\",\"kind\":\"' || kind || '\",\"language\":\"' || language || '\",\"label\":\"' || label || '\"}}', ',' order by version) || ']' as body from versions where language is not null group by 1"
)
def urn_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoints.urn_bodies(versions(spark, sf_dir).where("language is not null"))


@query(r"""with works as (select n_nationkey as n, i from nation, range(3) t(i))
select 'a' || lpad(n_nationkey::varchar, 2, '0') as key,
       '{"name":"' || n_name || '","name_abbrevs":["N' || (n_nationkey % 20) || '."],"default_work_urn":' ||
       case when n_nationkey % 4 = 0 then '"urn:cts:n:a' || n_nationkey || '.w1"' else 'null' end || ',"works":{' ||
       (select string_agg('"urn:cts:n:a' || n || '.w' || i || '":{"title":"Title ' || i || '","title_abbrevs":["T' || i || '.","Tit. ' || i || '"],"scheme":"flat"}', ',' order by i)
        from works where n = n_nationkey) || '}}' as body
from (select n_nationkey, array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(n_name, ' ')], ' ') as n_name from nation)""")
def citation_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, authors, works = _gazetteer(spark, sf_dir)
    return endpoints.citation_bodies(authors, works)


@query(f"""with {VERSIONS_SQL}
select '/' || urn || ':1/' as key, to_json({{'title': regexp_replace(title, '[^ -~]', '?', 'g'), 'author': textgroup, 'corpus': upper(corpus),
    'language': coalesce(case language when 'eng' then 'English' when 'deu' then 'German' when 'fre' then 'French' when 'spa' then 'Spanish' end, ''),
    'corpus_id': corpus, 'lang': coalesce(language, ''), 'kind': kind, 'status': case when experimental then 'experimental' else 'curated' end, 'editors': '', 'url': '/' || urn || ':1/'}}) as body
from versions""")
def search_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _with_status(spark, sf_dir)
    entries = v.select(
        F.regexp_replace("title", "[^ -~]", "?").alias("title"),
        F.col("textgroup").alias("author"),
        F.upper("corpus").alias("corpus"),
        catalog.lookup(catalog.LANGUAGE_LABELS, F.col("language")).alias("language"),
        F.col("corpus").alias("corpus_id"),
        F.col("language").alias("lang"),
        "kind",
        "status",
        F.lit("").alias("editors"),
        U.reading_url(F.col("urn"), F.lit("1")).alias("url"),
    )
    return endpoints.search_bodies(entries)


@query(f"""with {VERSIONS_SQL},
shards as (select doc_id % 4 as shard, corpus, work_urn, version, label from versions),
merged as (select work_urn, version, arg_max(corpus, shard) as corpus, arg_max(label, shard) as label,
    count(*) as contributions from shards group by 1, 2),
a as (select corpus, count(*) as whole, md5(string_agg(work_urn || version || label, ',' order by work_urn,
    version, label)) as d from versions group by 1),
b as (select corpus, count(*) as merged, md5(string_agg(work_urn || version || label, ',' order by work_urn,
    version, label)) as d from merged group by 1)
select a.corpus, whole, merged, a.d = b.d as same from a join b on a.corpus = b.corpus""")
def split_equals_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of four shards, merged, against the whole catalogue."""
    v = versions(spark, sf_dir).select(
        "corpus",
        "work_urn",
        "version",
        "label",
        F.pmod("doc_id", F.lit(4)).alias("ordinal"),
        F.lit(publish.MANIFEST_VERSION).alias("schema_version"),
    )
    merged = publish.merge_manifests(v)
    digest = F.sum(F.xxhash64("work_urn", "version", "label").cast("decimal(38,0)"))
    whole, parts = (x.groupBy("corpus").agg(F.count("*").alias(n), digest.alias(f"d_{n}")) for x, n in ((v, "whole"), (merged, "merged")))
    return whole.join(parts, "corpus").select("corpus", "whole", "merged", (F.col("d_whole") == F.col("d_merged")).alias("same"))


@query(f"""with {VERSIONS_SQL},
merged as (select * replace (case when doc_id % 2 = 0 then not experimental else experimental end as experimental) from versions),
open as (
    select *, regexp_replace(version, '[0-9]+$', '') as family, experimental and bool_or(not experimental) over (partition by textgroup,
    work, kind) as closed from merged)
select urn, title, experimental, not closed and row_number() over (partition by textgroup, work,
    kind, family, closed order by num desc, doc_id) = 1 as preferred from open""")
def merged_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two catalogues, the later of which judges versions anew; which are preferred is decided after the merge."""
    v = versions(spark, sf_dir)
    later = v.where("doc_id % 2 = 0").withColumns({"experimental": ~F.col("experimental"), "title": F.lit("late")})
    parts = v.withColumn("ordinal", F.lit(0)).unionByName(later.withColumn("ordinal", F.lit(1)))
    return catalog.merge_collections(parts, ["title"], ["kind", "experimental"], WORK, "doc_id").select("urn", "title", "experimental", "preferred")


@query(f"""with {VERSIONS_SQL},
editions as (select work_urn, case when doc_id % 3 > 0 then language end as lang, kind, doc_id from versions),
firsts as (select work_urn, arg_min(lang, doc_id) as lang from editions where kind = 'edition' and lang is not null group by 1)
select distinct v.work_urn, coalesce(f.lang, case corpus when 'c0' then 'grc' when 'c1' then 'lat' end) as original
    from versions v left join firsts f on f.work_urn = v.work_urn""")
def original_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = versions(spark, sf_dir)
    editions = v.select("work_urn", F.when(F.col("doc_id") % 3 > 0, F.col("language")).alias("lang"), "kind", F.col("doc_id").alias("pos"))
    return catalog.original_languages(editions, v.select("corpus", "work_urn").distinct(), {"c0": "grc", "c1": "lat"}).select("work_urn", "original")


def _display_levels(v: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpora, groups and works with stand-ins for labels and sort keys."""
    corpora = v.select("corpus").distinct().withColumn("label", F.reverse("corpus"))
    groups = v.select("corpus", "textgroup").distinct().withColumn("sort_key", F.right("textgroup", F.lit(1)))
    works = v.select("corpus", "textgroup", "work_urn").distinct().withColumn("sort_key", F.right("work_urn", F.lit(1)))
    return corpora, groups, works


def _display_sql(shown: str, group_key: str, work_key: str) -> str:
    return f"""with {VERSIONS_SQL}, shown as ({shown}),
listed as (
    select corpus, textgroup, work_urn, kind, experimental, version, label, urn from shown
    union all select w.corpus, w.textgroup, w.work_urn, 'commentary', v.experimental, v.version, v.label, v.urn
    from shown v join (select distinct corpus, textgroup, work_urn from shown) w on w.work_urn = v.about where v.about <> v.work_urn),
c as (select corpus, row_number() over (order by reverse(corpus), corpus) as corpus_place from (select distinct corpus from shown)),
g as (
    select corpus, textgroup, row_number() over (partition by corpus order by {group_key}, textgroup) as group_place
    from (select distinct corpus, textgroup from shown)),
w as (
    select corpus, textgroup, work_urn, row_number() over (partition by corpus, textgroup order by {work_key}, work_urn) as work_place
    from (select distinct corpus, textgroup, work_urn from shown))
select corpus_place, group_place, work_place, kind, row_number() over (partition by work_urn,
    kind order by experimental, not starts_with(version, 'pub-'), lower(label), version, urn) as place,
    urn
from listed join w using (corpus, textgroup, work_urn) join g using (corpus, textgroup) join c using (corpus)"""


@query(_display_sql("from versions", "right(textgroup, 1)", "right(work_urn, 1)"))
def display_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = versions(spark, sf_dir)
    return catalog.display_tree(v, *_display_levels(v))


@query(_display_sql(
    "select * replace (case when corpus in ('c1', 'c2') then 'series_' || textgroup else textgroup end as textgroup) from versions",
    "case when corpus = 'c2' then replace(textgroup, 'series_', '') else right(textgroup, 1) end",
    "case when starts_with(textgroup, 'series_') then split_part(work_urn, '.', -1) else right(work_urn, 1) end",
))
def display_tree_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of two corpora stand for series; one of these corpora lists its groups by id."""
    v = versions(spark, sf_dir)
    v = v.withColumn("textgroup", F.when(F.col("corpus").isin("c1", "c2"), F.concat(F.lit("series_"), "textgroup")).otherwise(F.col("textgroup")))
    return catalog.display_tree(v, *_display_levels(v), listed_by_id=["c2"])


@query(f"""with {VERSIONS_SQL}, {CHUNKS_SQL},
picked as (select work_urn, urn, doc_id from versions qualify row_number() over (partition by work_urn
    order by case when language <> 'eng' then 2 else 3 end, language, doc_id) = 1),
asked as (select doc_id as query_id, work_urn || case when doc_id % 11 = 0 then 'none' else '' end as work_urn,
    case when doc_id % 5 = 0 then null when doc_id % 5 = 1 then [doc_id % 9] else [doc_id % 9,
    doc_id % 4] end as key from versions),
met as (select a.query_id, p.urn, a.key, c.key as start, c.passage, c.pos, c.key[1:len(a.key)] = a.key as below
    from asked a join picked p on p.work_urn = a.work_urn left join chunks c on c.doc_id = p.doc_id),
landed as (select query_id, urn, any_value(key) as key, coalesce(arg_min(passage, start) filter (below),
    arg_max(passage, start) filter (start <= key), arg_min(passage, pos)) as chunk from met
    group by 1, 2)
select query_id, case when key is null then '/' || urn || '/' else '/' || urn || ':' || coalesce(chunk,
    array_to_string(key, '.')) || '/' end as href from landed""")
def citation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One typed passage for each document, of its work (or, for some, of a work that isn't there)."""
    v, k = versions(spark, sf_dir), F.col("doc_id")
    passage = F.when(k % 5 == 0, None).when(k % 5 == 1, (k % 9).cast("string")).otherwise(F.concat_ws(".", k % 9, k % 4))
    asked = v.select(k.alias("query_id"), F.concat("work_urn", F.when(k % 11 == 0, "none").otherwise("")).alias("work_urn"), passage.alias("passage"))
    places = chunks(spark, sf_dir).join(v.select("doc_id", "urn"), "doc_id").select("urn", "key", "passage", "pos")
    return citation.option_links(asked, v.withColumn("pos", k), places).select("query_id", "href")


@query(f"with {VERSIONS_SQL} select urn, kind, language, experimental from versions")
def published_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as it is read back from the current snapshot after its publication."""
    root = f"{work_folder(spark)}/published/{uuid.uuid4().hex}"
    snapshots.publish_snapshot(versions(spark, sf_dir).select("urn", "kind", "language", "experimental"), root, has_index=F.col("kind") == "edition")
    return snapshots.read_snapshot(spark, root)


@query(f"""with {VERSIONS_SQL}, {CHUNKS_SQL},
there as (select distinct doc_id from chunks)
select work_urn, count(*) as versions from versions where doc_id % 7 <> 0 and doc_id in (select doc_id from there) group by 1""")
def deployed_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with the versions that can be shown: a seventh have no sidecar, and versions without a word no chunk."""
    v = versions(spark, sf_dir)
    named = chunks(spark, sf_dir).select("doc_id").distinct().join(v.select("doc_id", "urn"), "doc_id")
    shown = catalog.deployable(v, v.where(F.col("doc_id") % 7 != 0).select("urn"), named.select("urn"))
    return shown.groupBy("work_urn").agg(F.count("*").alias("versions"))
