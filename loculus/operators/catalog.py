"""The catalogue of versions: kinds, preferred versions, ordering, indexes, facets and merging.

Versions are one flat table (corpus, textgroup, work, version, language, ...);
the nested tree exists only where it is written.  Lookup tables that users
configure (labels, owners, licences, overrides) are small frames or maps given
as parameters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loculus.functions.urn import family, file_stem, id_language, version_id

#: Kinds in display order, labels of languages and of editors' roles.
KINDS = ("edition", "translation", "commentary")
LANGUAGE_LABELS = {
    "ang": "Old English",
    "ara": "Arabic",
    "cop": "Coptic",
    "deu": "German",
    "eng": "English",
    "fas": "Persian",
    "fre": "French",
    "ger": "German",
    "grc": "Greek",
    "ita": "Italian",
    "jpn": "Japanese",
    "lat": "Latin",
    "mul": "Multiple",
    "spa": "Spanish",
}
ROLE_LABELS = {
    "translator": "Translator",
    "transl": "Translator",
    "editor": "Editor",
    "associate editor": "Associate Editor",
    "assistant editor": "Assistant Editor",
    "commentator": "Commentator",
}
#: Fixed value: how the id of a series begins.
SERIES_PREFIX = "series_"
HOUSE_PREFIX = "pub-"


def lookup(values: Mapping[str, str], key: Column) -> Column:
    """The label of a key from a constant map, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key) if values else F.lit(None).cast("string")


def first_text(*choices: Column) -> Column:
    """The first choice that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])


def work_title(titles: Column, fallback: Column) -> Column:
    """Of a map language to title: English, Latin, Greek, any, else the fallback."""
    return first_text(
        F.element_at(titles, F.lit("eng")),
        F.element_at(titles, F.lit("lat")),
        F.element_at(titles, F.lit("grc")),
        F.get(F.map_values(titles), F.lit(0)),
        fallback,
    )


def group_names(groups: DataFrame, names: DataFrame) -> DataFrame:
    """``groups`` (urn) with ``name`` from ``names`` (urn, lang, name): by urn, else by the id behind the namespace; English first, else the first."""
    best = names.withColumn("_id", F.substring_index("urn", ":", -1)).withColumn("_rank", F.when(F.col("lang") == "eng", 0).otherwise(1))
    pick = lambda by: best.groupBy(by).agg(F.min_by("name", F.struct("_rank", "urn", "name")).alias("name"))
    exact, loose = pick("urn").withColumnRenamed("name", "_exact"), pick("_id").withColumnRenamed("name", "_loose")
    joined = groups.withColumn("_id", F.substring_index("urn", ":", -1)).join(exact, "urn", "left").join(loose, "_id", "left")
    return joined.withColumn("name", first_text(F.col("_exact"), F.col("_loose"), F.col("_id"))).select(*groups.columns, "name")


def editors_shown(editors: Column) -> Column:
    """Editors (name, role) as one string: known roles in brackets, others as "ed. name", blank names left out."""
    named = F.filter(editors, lambda e: F.trim(F.coalesce(e["name"], F.lit(""))) != "")
    role = lambda e: lookup(ROLE_LABELS, F.lower(F.trim(F.coalesce(e["role"], F.lit("")))))
    return F.array_join(
        F.transform(
            named,
            lambda e: F.when(
                role(e).isNotNull(),
                F.concat(F.trim(e["name"]), F.lit(" ("), role(e), F.lit(")")),
            ).otherwise(F.concat(F.lit("ed. "), F.trim(e["name"]))),
        ),
        ", ",
    )


def licence(own: Column, availability: Column, repository: Column, of_repository: Mapping[str, str]) -> Column:
    """Licence text: the document's own, its availability statement, its repository's default, or null."""
    return first_text(own, availability, lookup(of_repository, repository))


def source_url(repository: Column, file: Column, base_of_repository: Mapping[str, str]) -> Column:
    """Where a document's source lies, or null for unknown repositories and empty paths."""
    return F.when(
        F.coalesce(file, F.lit("")) != "",
        F.concat_ws("/", lookup(base_of_repository, repository), file),
    ).otherwise(None) if base_of_repository else F.lit(None).cast("string")


def badge(version: Column, of_prefix: Mapping[str, str]) -> Column:
    """Label of the first prefix that the id's last component begins with."""
    leaf = F.substring_index(version, ".", -1)
    out = F.lit(None).cast("string")
    for prefix, label in reversed(list(of_prefix.items())):
        out = F.when(leaf.startswith(prefix), label).otherwise(out)
    return out


def version_kind(catalogued: Column, about: Column, version: Column, language: Column, original: Column) -> Column:
    """The catalogue's kind; else commentary if it is about a work; else by language against the original's.

    The language token of the id counts before the document's own language.
    """
    token = id_language(version)
    spoken = F.when(lookup(LANGUAGE_LABELS, token).isNotNull(), token).otherwise(F.coalesce(language, F.lit("")))
    own = F.when(F.coalesce(about, F.lit("")) != "", "commentary").when(
        (F.coalesce(original, F.lit("")) == "") | (spoken == original),
        "edition",
    ).otherwise("translation")
    return F.when(catalogued.isin(*KINDS), catalogued).otherwise(own)


def original_languages(editions: DataFrame, works: DataFrame, of_corpus: Mapping[str, str]) -> DataFrame:
    """``works`` (corpus, work_urn) with ``original``: language of the first catalogued edition that has one, else the corpus's."""
    first = editions.where("kind = 'edition' and coalesce(lang, '') <> ''").groupBy("work_urn").agg(F.min_by("lang", "pos").alias("_first"))
    return works.join(first, "work_urn", "left").withColumn(
        "original",
        first_text(F.col("_first"), lookup(of_corpus, F.col("corpus"))),
    ).drop("_first")


def commentator(own_group: Column, about: Column, name: Column) -> Column:
    """Who wrote a commentary: its group's name, unless it stands beside the work that it is about."""
    same = F.regexp_replace(about, r"\.[^.]*$", "") == own_group
    return F.when(about.isNull() | same, "").otherwise(name)


def with_preferred(versions: DataFrame, work: Sequence[str], pos: str, forced: Column | None = None) -> DataFrame:
    """``versions`` (version, kind, experimental) with ``preferred``.

    In each id family of a kind the highest number is preferred, the first on
    ties; an experimental version only where its kind has no curated one.  If
    any version of a work is ``forced``, exactly the forced ones are.
    """
    stem, number = family(F.col("version"))
    by_kind = Window.partitionBy(*work, "kind")
    by_work = Window.partitionBy(*work)
    marked = versions.withColumns(
        {
            "_family": stem,
            "_number": number,
            "_curated": F.max(~F.col("experimental")).over(by_kind),
            "_forced": F.lit(False) if forced is None else F.coalesce(forced, F.lit(False)),
        }
    )
    marked = marked.withColumn("_open", ~(F.col("experimental") & F.col("_curated")))
    rank = F.row_number().over(Window.partitionBy(*work, "kind", "_family", "_open").orderBy(F.desc("_number"), pos))
    chosen = marked.withColumns({"_rank": rank, "_any": F.max("_forced").over(by_work)})
    preferred = F.when(F.col("_any"), F.col("_forced")).otherwise(F.col("_open") & (F.col("_rank") == 1))
    return chosen.withColumn("preferred", preferred).select(*versions.columns, "preferred")


def display_keys(house_prefix: str = HOUSE_PREFIX) -> list[Column]:
    """Experimental last, the house's own first, then label and id."""
    return [F.col("experimental"), ~F.col("version").startswith(house_prefix), F.lower("label"), F.col("version")]


def default_keys(house_prefix: str = HOUSE_PREFIX) -> list[Column]:
    """Best version of a work first: curated, by kind, preferred, then as displayed."""
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return [F.col("experimental"), F.when(kind > 0, kind).otherwise(len(KINDS) + 1), ~F.col("preferred"), *display_keys(house_prefix)[1:]]


def family_best(versions: DataFrame, work: Sequence[str], house_prefix: str = HOUSE_PREFIX) -> DataFrame:
    """One version per id family of a work: curated, then highest number, then default order."""
    stem, number = family(F.col("version"))
    order = Window.partitionBy(*work, "family").orderBy("experimental", F.desc("number"), *default_keys(house_prefix))
    ranked = versions.withColumns({"family": stem, "number": number})
    return ranked.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select(*work, "family", "version", "number")


def work_orders(versions: DataFrame, work: Sequence[str], house_prefix: str = HOUSE_PREFIX) -> DataFrame:
    """Every version with its place in its work's default order, from 1."""
    return versions.withColumn("place", F.row_number().over(Window.partitionBy(*work).orderBy(*default_keys(house_prefix))))


def ordered_lists(rows: DataFrame, by: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Values per group as one list in order."""
    return rows.groupBy(*by).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(order).alias("place"), F.col(value).alias("value")))),
            lambda r: r["value"],
        ).alias(name)
    )


def catalog_tree(versions: DataFrame) -> DataFrame:
    """One row per corpus with nested groups, works and versions; empty levels don't appear."""
    works = versions.groupBy("corpus", "textgroup", "work").agg(
        F.array_sort(F.collect_list(F.struct("version", "kind", "language"))).alias("versions")
    )
    groups = works.groupBy("corpus", "textgroup").agg(F.array_sort(F.collect_list(F.struct("work", "versions"))).alias("works"))
    return groups.groupBy("corpus").agg(F.array_sort(F.collect_list(F.struct("textgroup", "works"))).alias("textgroups"))


def merge_catalogs(parts: DataFrame, key: Sequence[str], first: Sequence[str], last: Sequence[str], ordinal: str = "ordinal") -> DataFrame:
    """Rows of several catalogues by key: ``first`` columns from the first source, ``last`` ones from the last."""
    return parts.groupBy(*key).agg(*[F.min_by(c, ordinal).alias(c) for c in first], *[F.max_by(c, ordinal).alias(c) for c in last])


def merge_collections(
    parts: DataFrame,
    first: Sequence[str],
    last: Sequence[str],
    work: Sequence[str],
    pos: str,
    ordinal: str = "ordinal",
) -> DataFrame:
    """Several catalogues (urn, version, kind, experimental, ...) as one, with ``preferred`` decided anew over what each work has now."""
    return with_preferred(merge_catalogs(parts, ["urn", *work, "version", pos], first, last, ordinal), work, pos)


def deployable(versions: DataFrame, sidecars: DataFrame, chunks: DataFrame) -> DataFrame:
    """``versions`` that have a metadata sidecar (urn) and at least one chunk (urn); works and groups without any version are thereby gone."""
    return versions.join(sidecars.select("urn").distinct(), "urn", "left_semi").join(chunks.select("urn").distinct(), "urn", "left_semi")


def experimental_ids(versions: DataFrame, files: DataFrame, flagged: Sequence[str]) -> DataFrame:
    """(id): version ids that flagged repositories contribute: catalogued there (repo, urn), or named so by a document's file (repo, path)."""
    catalogued = versions.where(F.col("repo").isin(*flagged)).select(version_id(F.col("urn")).alias("id"))
    documents = files.where(F.col("repo").isin(*flagged) & ~F.col("path").endswith("__cts__.xml") & F.col("path").endswith(".xml"))
    return catalogued.unionByName(documents.select(file_stem(F.col("path")).alias("id"))).distinct()


def listed_versions(versions: DataFrame) -> DataFrame:
    """(corpus, textgroup, work_urn, kind, version_urn): versions under their works, and commentaries also under the works that they are about."""
    about = versions.where("about is not null and about <> work_urn")
    works = versions.select(F.col("work_urn").alias("_w"), F.col("corpus").alias("_c"), F.col("textgroup").alias("_g")).distinct()
    crossed = about.join(works, about["about"] == works["_w"]).select(
        F.col("_c").alias("corpus"),
        F.col("_g").alias("textgroup"),
        F.col("_w").alias("work_urn"),
        F.lit("commentary").alias("kind"),
        "experimental",
        "version",
        "label",
        "urn",
    )
    return versions.select("corpus", "textgroup", "work_urn", "kind", "experimental", "version", "label", "urn").unionByName(crossed)


def version_status(experimental: Column) -> Column:
    """Curated unless it is known to be experimental."""
    return F.when(F.coalesce(experimental, F.lit(False)), "experimental").otherwise("curated")


def is_series(textgroup: Column) -> Column:
    """Groups that are a series of volumes, not an author."""
    return textgroup.startswith(SERIES_PREFIX)


def display_tree(versions: DataFrame, corpora: DataFrame, groups: DataFrame, works: DataFrame, listed_by_id: Sequence[str] = ()) -> DataFrame:
    """(corpus_place, group_place, work_place, kind, place, urn): the order in which everything is shown.

    Corpora (corpus, label) go by label, groups (corpus, textgroup, sort_key) and
    works (corpus, textgroup, work_urn, sort_key) by sort key, then by id; versions of
    a kind as ``display_keys`` has them.  Works of a series go by id, and so do the groups
    of the corpora ``listed_by_id``, series without what marks them as such.
    """
    bare = F.when(is_series(F.col("textgroup")), F.expr(f"substring(textgroup, {len(SERIES_PREFIX) + 1})")).otherwise(F.col("textgroup"))
    groups = groups.withColumn("sort_key", F.when(F.col("corpus").isin(*listed_by_id), bare).otherwise(F.col("sort_key")))
    works = works.withColumn("sort_key", F.when(is_series(F.col("textgroup")), F.substring_index("work_urn", ".", -1)).otherwise(F.col("sort_key")))
    at = lambda by, *order: F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    c = corpora.select("corpus", at([F.lit(0)], F.lower("label"), "corpus").alias("corpus_place"))  # one row per corpus
    g = groups.select("corpus", "textgroup", at(["corpus"], "sort_key", "textgroup").alias("group_place"))
    w = works.select("corpus", "textgroup", "work_urn", at(["corpus", "textgroup"], "sort_key", "work_urn").alias("work_place"))
    shown = listed_versions(versions).withColumn("place", at(["work_urn", "kind"], *display_keys(), "urn"))
    joined = shown.join(w, ["corpus", "textgroup", "work_urn"]).join(g, ["corpus", "textgroup"]).join(c, "corpus")
    return joined.select("corpus_place", "group_place", "work_place", "kind", "place", "urn")


def attach_commentaries(versions: DataFrame) -> DataFrame:
    """(work_urn, version_urn): commentaries under the deployed work that they are about, their own work left out."""
    works = versions.select("work_urn").distinct()
    about = versions.where("about is not null and about <> work_urn").select(F.col("about").alias("work_urn"), "version_urn")
    return about.join(works, "work_urn", "left_semi")


#: Compares without regard to accents and case, in whatever language.
FOLDED = "UNICODE_CI_AI"


def holds_folded(text: Column, part: str) -> Column:
    """Whether a text holds a part, accents and case aside; an empty part is in every text that isn't null."""
    return F.contains(F.collate(text, FOLDED), F.collate(F.lit(part), FOLDED))


def facet_match(chosen: Mapping[str, Sequence[str]], text: tuple[str, str] | None = None) -> Column:
    """Rows that match every facet (any of its values) and whose ``text`` column holds what was typed, accents and case aside."""
    out = F.lit(True)
    for facet, values in chosen.items():
        if values:
            out &= F.col(facet).isin(*values)
    if text and text[1]:
        out &= holds_folded(F.col(text[0]), text[1])
    return F.coalesce(out, F.lit(False))


def crosstab(rows: DataFrame, row: str, column: str, names: Sequence[str]) -> DataFrame:
    """Counts of ``column`` values per ``row`` value with a total row, totals and the share of all in percent."""
    counts = rows.rollup(row).agg(
        *[F.count_if(F.col(column) == n).alias(n) for n in names],
        F.count("*").alias("total"),
        F.grouping(row).alias("is_total"),
    )
    return counts.withColumn("percent", F.round(100.0 * F.col("total") / F.max("total").over(Window.partitionBy()), 4))
