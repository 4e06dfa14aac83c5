"""Values derived from a row of the flattened view."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINIMUM_NUC, MINIMUM_AA = 1200, 400


def latest_date(dates: Column) -> Column:
    return F.coalesce(F.array_max(dates), F.lit(""))


def first(items: Column) -> Column:
    return F.coalesce(F.get(items, F.lit(0)), F.lit(""))


def lab(lab_ids: Column) -> Column:
    """The first lab in order."""
    return F.coalesce(F.array_min(F.map_keys(lab_ids)), F.lit(""))


def lab_id(lab_ids: Column) -> Column:
    return first(F.coalesce(F.try_element_at(lab_ids, F.array_min(F.map_keys(lab_ids))), F.array().cast("array<string>")))


def ids_of(lab_ids: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(lab_ids, F.lit(name)), F.array().cast("array<string>"))


def all_lab_ids(lab_ids: Column) -> Column:
    """``lab#id``, sorted and distinct."""
    each = F.transform(F.map_entries(lab_ids), lambda e: F.transform(e["value"], lambda v: F.concat(e["key"], F.lit("#"), v)))
    return F.array_sort(F.array_distinct(F.flatten(each)))


def make_name(name: Column, passages: Column, hi_names: Column, separator: str = " ") -> Column:
    return F.coalesce(F.get(hi_names, F.lit(0)), F.trim(F.concat(name, F.lit(separator), first(passages))))


def seq_id(name: Column, passages: Column, encode: bool = False) -> Column:
    plain = F.trim(F.concat(name, F.lit("__"), first(passages)))
    return F.url_encode(plain) if encode else plain


def is_short(nuc: Column, aa: Column) -> Column:
    return F.when(aa == "", F.length(nuc) < MINIMUM_NUC).otherwise(F.length(aa) < MINIMUM_AA)


def all_variants(passages: Column, reassortants: Column) -> Column:
    """Every reassortant with every passage, blank-separated; missing ones count as one empty value."""
    some = lambda a: F.when(F.size(a) > 0, a).otherwise(F.array(F.lit("")))
    return F.array_distinct(F.flatten(F.transform(some(reassortants), lambda r: F.transform(some(passages), lambda p: F.trim(F.concat(r, F.lit(" "), p))))))


def all_names(name: Column, passages: Column, reassortants: Column) -> Column:
    return F.transform(all_variants(passages, reassortants), lambda v: F.trim(F.concat(name, F.lit(" "), v)))
