"""Scalar expressions of the engine, all of them built-in Spark functions."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

from stayflow.functions import constants as C


def age_bucket(age: Column) -> Column:
    """Decades from 18-29 to 80+."""
    low = (F.floor(age / 10) * 10).cast("int")
    return F.when(age < 30, "18-29").when(age >= 80, "80+").otherwise(F.concat_ws("-", low, low + 9))


def modality(code: Column) -> Column:
    """What stands before the first //."""
    return F.substring_index(code, "//", 1)


def priority(code: Column) -> Column:
    """Order of an event among those of its time."""
    known = F.create_map(*[F.lit(x) for name, p in C.PRIORITY.items() for x in (name, float(p))])
    return F.coalesce(F.try_element_at(known, modality(code)), F.lit(C.DEFAULT_PRIORITY))


def bin_of(edges: Column, value: Column) -> Column:
    """Index of the first upper edge that value does not exceed, less one; above all edges (and NaN) the last bin.

    A single edge gives -1; no edges or no value give null.
    """
    upper = F.transform(F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 1, F.lit(0))), lambda e: value <= e)
    at = F.array_position(upper, F.lit(True))
    return F.when(value.isNotNull() & (F.size(edges) > 0), (F.coalesce(F.nullif(at, F.lit(0)), F.size(edges) - 1) - 1).cast("int"))


def gap_token(minutes: Column, edges: list[int] | None = None) -> Column:
    """The token of a time gap; null under a minute and without a gap."""
    edges = edges or C.GAP_EDGES
    found = F.when(minutes.isNull() | (minutes < 1), None)
    for low, high in pairwise(edges):
        found = found.when(minutes <= high, f"DT//{low}-{high}")
    return found.otherwise(f"DT//{edges[-1]}+")


def micros(time: Column) -> Column:
    """Exact microseconds since 1970 of a time without zone, taken as UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), time)


def from_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01").cast("timestamp_ntz"))


def in_stay(time: Column, start: Column, end: Column) -> Column:
    """Both ends belong to the stay."""
    return (time >= start) & (time <= end)
