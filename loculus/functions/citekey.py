"""Citation keys: positions such as ``1.51`` as arrays of numbers.

Arrays compare number by number with a shorter prefix first, which is the
order of the places they stand for, so ``<``, ``min`` and ``ORDER BY`` on keys
need nothing of their own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of lyric divisions, whose numbers restart and never are citations (fixed values).
LYRIC_DIVISIONS = ("antistrophe", "episode", "epode", "mesode", "pnigos", "strophe", "systema")


def passage(urn: Column) -> Column:
    """What follows the last colon."""
    return F.substring_index(urn, ":", -1)


def _numbers(part: Column, pattern: str) -> Column:
    return F.transform(F.split(part, r"\."), lambda c: F.coalesce(F.regexp_extract(c, pattern, 0).try_cast("bigint"), F.lit(0).cast("bigint")))


def start_key(citation: Column) -> Column:
    """Key of the text before the first dash; a component without leading digits counts as 0."""
    return _numbers(F.substring_index(passage(citation), "-", 1), r"^[0-9]+")


def end_key(citation: Column) -> Column:
    """Key of the text after the first dash, or of all of it."""
    return _numbers(F.regexp_replace(passage(citation), "^[^-]*-", ""), r"^[0-9]+")


def typed_key(citation: Column) -> Column:
    """As ``start_key``, but a component's digits may stand anywhere in it ("a1" is 1): for typed input."""
    return _numbers(F.substring_index(passage(citation), "-", 1), r"[0-9]+")


def distance(a: Column, b: Column) -> Column:
    """Component-wise difference of two keys, the shorter filled with zeros; compares by nearness."""
    return F.zip_with(a, b, lambda x, y: F.abs(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))))


def begins_with(key: Column, prefix: Column) -> Column:
    return (F.size(key) >= F.size(prefix)) & (F.slice(key, F.lit(1), F.size(prefix)) == prefix)


def sortable(key: Column) -> Column:
    """A string that sorts as the key does; Parquet keeps useful minima and maxima of it."""
    return F.array_join(F.transform(key, lambda n: F.lpad(n.cast("string"), 12, "0")), ".")


def starts_within(start: Column, low: Column, high: Column) -> Column:
    """A start inside a range; a single place also holds every finer start below it."""
    return start.between(low, high) | ((low == high) & (F.size(low) < F.size(start)) & begins_with(start, low))


def ranges_overlap(a: Column, b: Column) -> Column:
    """Two citations share a place: each begins before the other ends, a coarse place holding finer ones."""
    before = lambda x, y: (start_key(x) <= end_key(y)) | begins_with(start_key(x), end_key(y))
    return before(a, b) & before(b, a)


def qualify(value: Column, citation: Column) -> Column:
    """Put the leading components that a bare value lacks in front of it, on both sides of a range."""
    full = F.split(citation, r"\.")

    def one(part: Column) -> Column:
        missing = F.size(full) - F.size(F.split(part, r"\."))
        return F.when(missing > 0, F.concat_ws(".", F.slice(full, F.lit(1), F.greatest(missing, F.lit(0))), part)).otherwise(part)

    dash = F.instr(value, "-")
    return F.when(dash > 0, F.concat_ws("-", one(F.substring_index(value, "-", 1)), one(F.substr(value, dash + 1)))).otherwise(one(value))


def target_citation(urn: Column, work_urn: Column) -> Column:
    """The citation of a reference that targets the work (or a part or whole of it), else null."""
    work = F.regexp_replace(urn, ":[^:]*$", "")
    aims = work.startswith(work_urn) | work_urn.startswith(work)
    return F.when(urn.startswith("urn:cts:") & (passage(urn) != "") & aims, passage(urn))


def span(first: Column, last: Column) -> Column:
    """"a" or "a-b" of the first start and the last end of some citations."""
    low, high = F.substring_index(first, "-", 1), F.substring_index(last, "-", -1)
    return F.when(low == high, low).otherwise(F.concat_ws("-", low, high))


def typed_scope(raw: Column) -> Column:
    """The start of a typed citation ("5.4-6", "100a."), or null if it is none."""
    trimmed = F.regexp_replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), "[.,;]+$", "")
    start = F.regexp_extract(trimmed, r"^([0-9]+(?:\.[0-9]+)*[a-z]?)(?:[-–—][0-9]+(?:\.[0-9]+)*[a-z]?)?\.?$", 1)
    return F.nullif(start, F.lit(""))
