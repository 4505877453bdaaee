"""Identifiers of the form ``urn:cts:<namespace>:<group>.<work>.<version>:<passage>`` as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_version_urn(urn: Column) -> Column:
    """Whether it names a version: the prefix, and exactly three dotted components after the namespace."""
    parts = F.split(F.coalesce(urn, F.lit("")), ":")
    return (F.size(parts) >= 4) & urn.startswith("urn:cts:") & (F.size(F.split(F.get(parts, F.lit(3)), r"\.")) == 3)


def work_urn(urn: Column) -> Column:
    """Without passage and version."""
    parts = F.split(urn, ":")
    bare = F.when(F.size(parts) == 5, F.slice(parts, 1, 4)).otherwise(parts)
    leaf = F.split(F.element_at(bare, -1), r"\.")
    short = F.when(F.size(leaf) >= 3, F.slice(leaf, 1, 2)).otherwise(leaf)
    return F.concat_ws(":", F.slice(bare, F.lit(1), F.size(bare) - 1), F.array_join(short, "."))


def work_parts(urn: Column) -> tuple[Column, Column, Column]:
    """(namespace, group, work) of a work's urn."""
    leaf = F.split_part(urn, F.lit(":"), F.lit(4))
    return F.split_part(urn, F.lit(":"), F.lit(3)), F.split_part(leaf, F.lit("."), F.lit(1)), F.split_part(leaf, F.lit("."), F.lit(2))


def version_id(urn: Column) -> Column:
    """``group.work.version`` without namespace and passage; other strings stay as they are."""
    parts = F.split(urn, ":")
    return F.when(F.size(parts) > 3, F.get(parts, F.lit(3))).otherwise(urn)


def about_work(own: Column, catalogued: Column) -> Column:
    """The work a commentary is about: the catalogue's word before the document's; null unless it names a work."""
    about = F.coalesce(F.nullif(catalogued, F.lit("")), own)
    return F.nullif(F.regexp_extract(about, r"^(urn:cts:[^:]*:[^:.]*\.[^:.]*)", 1), F.lit(""))


def path(urn: Column) -> Column:
    """Relative path of a urn, its passage left out; a string without namespace becomes one flat name."""
    bare = F.regexp_replace(urn, "^urn:cts:", "")
    nested = F.concat_ws("/", F.split_part(bare, F.lit(":"), F.lit(1)), F.translate(F.split_part(bare, F.lit(":"), F.lit(2)), ".", "/"))
    return F.when(F.contains(bare, F.lit(":")), nested).otherwise(F.translate(bare, ":.", "__"))


def reading_url(base: Column, chunk: Column, scheme: Column | None = None) -> Column:
    """Path of a passage's page, in another citation scheme if one is given."""
    scheme = F.lit("") if scheme is None else F.coalesce(scheme, F.lit(""))
    return F.concat(F.lit("/"), base, F.when(scheme != "", F.concat(F.lit("/"), scheme)).otherwise(""), F.lit(":"), chunk, F.lit("/"))


def fragment_url(base: Column, chunk: Column, scheme: Column | None = None) -> Column:
    return F.concat(reading_url(base, chunk, scheme), F.lit("_text/"))


def token_urn(base: Column, ref: Column, form: Column, occurrence: Column) -> Column:
    return F.concat(base, F.lit(":"), ref, F.lit("@"), form, F.lit("["), occurrence.cast("string"), F.lit("]"))


def scheme_slug(scheme: Column) -> Column:
    """"" for the default scheme, the lower-cased name behind its prefix for others; the bare prefix stays a name."""
    lowered = F.lower(scheme)
    return F.when(scheme == "CTS", "").when(lowered == "cts-", lowered).otherwise(F.regexp_replace(lowered, "^cts-", ""))


def family(version: Column) -> tuple[Column, Column]:
    """(id family, trailing number or 0) of a version id."""
    return F.regexp_replace(version, "[0-9]+$", ""), F.coalesce(F.regexp_extract(version, "[0-9]+$", 0).try_cast("bigint"), F.lit(0).cast("bigint"))


def id_language(version: Column) -> Column:
    """Language token at the end of a version id, or "" ."""
    return F.regexp_extract(version, r"-([a-z]{3})[0-9]*[a-z]?$", 1)


def prefixes_meet(a: Column, b: Column) -> Column:
    return a.startswith(b) | b.startswith(a)


def file_stem(path: Column) -> Column:
    """A file's name without folders and its last suffix; dots inside stay."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def chunk_folder(urn: Column, scheme: Column | None = None) -> Column:
    """Folder of a version's chunks; other schemes than the default lie in one of their own name."""
    extra = F.lit("") if scheme is None else F.coalesce(scheme, F.lit(""))
    return F.concat(path(urn), F.when(extra != "", F.concat(F.lit("/"), extra)).otherwise(""))


def chunk_file(urn: Column, chunk: Column) -> Column:
    return F.concat(chunk_folder(urn), F.lit("/chunk_"), chunk, F.lit(".html"))


def manifest_file(urn: Column) -> Column:
    return F.concat(chunk_folder(urn), F.lit("/index.json"))


def catalogue_page(language: Column) -> Column:
    return F.concat(F.lit("catalog/"), language, F.lit(".html"))


def sidecar_name(file: Column) -> Column:
    """Token file beside a chunk's XML file."""
    return F.regexp_replace(file, r"\.[^./]*$", ".tokens.json.zst")
