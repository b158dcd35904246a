"""Column functions for stamps, names, numbers as text and labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000


def stamp_parts(ns: Column) -> tuple[Column, Column]:
    """Whole seconds and the remaining nanoseconds (both long, exact)."""
    rest = F.pmod(ns, F.lit(NS))
    return ((ns - rest) / NS).cast("long"), rest


def join_stamp(sec: Column, nanosec: Column) -> Column:
    return sec * NS + nanosec


def topic_folder(topic: Column) -> Column:
    """Topic name usable as a folder: outer slashes dropped, inner ones replaced."""
    return F.regexp_replace(F.regexp_replace(topic, "^/+|/+$", ""), "/", "_")


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def half_up(value: Column, digits: int) -> Column:
    """Decimal rounding of the shortest text form, halves away from zero."""
    return F.round(value, digits)


def fixed(value: Column, digits: int) -> Column:
    """Fixed digits without grouping; a dash for missing values."""
    text = F.regexp_replace(F.format_number(F.round(value, digits), digits), ",", "")
    return F.coalesce(text, F.lit("-"))


def percent_of_counts(k: Column, n: Column) -> Column:
    """Percentage with one decimal from integer counts, halves up, no binary rounding."""
    tenths = (F.lit(2000).cast("long") * k + n - F.pmod(F.lit(2000).cast("long") * k + n, 2 * n)) / (2 * n)
    return F.when(n > 0, tenths.cast("long") / 10)


def recover_count(ratio: Column, n: Column, digits: int = 4) -> Column:
    """Integer numerator of a rounded ratio; NULL when it does not reproduce the ratio."""
    k = F.rint(ratio * n).cast("long")
    return F.when((n > 0) & (F.abs(F.round(k / n, digits) - ratio) < 10.0 ** -(digits + 2)), k)


def delta_text(old: Column, new: Column, higher_better: bool, digits: int = 3) -> Column:
    """Signed change with its direction."""
    d = F.round(new - old, digits)
    sign = F.when(d > 0, "+").otherwise("")
    good = (d > 0) if higher_better else (d < 0)
    word = F.when(d == 0, "same").when(good, "better").otherwise("worse")
    return F.when(old.isNull() | new.isNull(), "-").otherwise(F.concat(sign, fixed(d, digits), F.lit(" "), word))


def label_of(code: Column, names: Mapping[str, str]) -> Column:
    """Display name of a code; unknown codes stay as they are."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code), code)


def flag(text: Column) -> Column:
    """Booleans written as 0/1 or as words."""
    return F.when(F.lower(text).isin("1", "true"), True).when(F.lower(text).isin("0", "false"), False)


# Display names of statuses and error kinds.
STATUS_NAMES = {
    "tp": "detected",
    "merged": "merged with another object",
    "split": "split into pieces",
    "low_iou": "overlap too low",
    "missed": "not detected",
    "not_present": "not present",
    "ignored_match": "ignored match",
    "no_kf": "no keyframe",
}
TIDE_NAMES = {"dupe": "duplicate", "loc": "localisation", "bkg": "background", "other": "other"}


def nearly_same(a: Column, b: Column, least: float = 0.7) -> Column:
    """Texts of which, in letters and digits alone, one holds the other or few characters differ.

    The share of differing characters is an edit distance.
    """
    a, b = (F.regexp_replace(x, "[^0-9A-Za-z]", "") for x in (a, b))
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a) | (1 - F.levenshtein(a, b) / longest >= least))
