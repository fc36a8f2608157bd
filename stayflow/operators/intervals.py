"""Points that lie in intervals of the same key, by a sweep: no key's points are paired with all of its intervals.

Intervals are dealt into cells of a grid whose width grows eightfold by level: an interval belongs to the first level whose
cells are as long as itself, where it touches two cells at most. A point goes to one cell of each level that intervals have.
Within a key and cell, interval starts and points are taken in order of time; the intervals that have begun and not ended
are kept in a heap by their end, and each point meets all of them. Work is that of sorting plus the pairs found; memory is
that of the intervals that are open at one time. A hot key is spread over its cells.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayflow.functions.expressions import micros

#: Width of the finest cells in microseconds, by how much it grows from level to level, and the number of levels.
BASE, GROWTH, LEVELS = 86_400_000_000, 8, 9


def _level(length: Column) -> Column:
    """The first level whose cells are as long as `length`."""
    found = F.lit(LEVELS)
    for i in reversed(range(LEVELS)):
        found = F.when(length <= BASE * GROWTH**i, i).otherwise(found)
    return found


def _cell(at: Column, level: Column) -> Column:
    widths = F.array(*[F.lit(BASE * GROWTH**i) for i in range(LEVELS)])
    return F.when(level < LEVELS, F.floor(at / F.get(widths, level))).otherwise(F.lit(0)).cast("long")


def interval_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, keep: list[str]) -> DataFrame:
    """A row for each point and each span of its key with start <= at <= end: the point's columns, then `keep` of the span,
    whose names the points do not have. Nulls in key or times, and spans that end before they start, match nothing."""
    p = points.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), micros(F.col(at)).alias("at"), F.struct(*points.columns).alias("point"))
    s = spans.where(F.col(key).isNotNull() & (F.col(start) <= F.col(end))).select(F.col(key).alias("key"), micros(F.col(start)).alias("at"), micros(F.col(end)).alias("upto"), F.struct(*keep).alias("span"))
    s = s.withColumn("level", _level(F.col("upto") - F.col("at")))
    levels = [r["level"] for r in s.select("level").distinct().collect()]
    begins = s.withColumn("cell", F.explode(F.array_distinct(F.array(_cell(F.col("at"), F.col("level")), _cell(F.col("upto"), F.col("level"))))))
    p = p.withColumn("level", F.explode(F.array(*[F.lit(x) for x in sorted(levels)]).cast("array<int>")))
    p = p.withColumns({"cell": _cell(F.col("at"), F.col("level")), "upto": F.lit(None).cast("long")})
    marks = begins.withColumn("kind", F.lit(0)).unionByName(p.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    where = ["key", "level", "cell"]
    marks = marks.select(*where, "at", "kind", "upto", "point", "span").repartition(*where).sortWithinPartitions(*where, "at", "kind")
    names = ["point", "span"]
    found = marks.mapInArrow(_sweep, marks.select(*names).schema).select("point.*", "span.*")
    return found


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, begun, number = None, [], 0
    for b in batches:
        rows, spans = [], []
        columns = [b.column(c).to_pylist() for c in ("key", "level", "cell", "at", "kind", "upto")]
        span = b.column("span")
        for i, (key, level, cell, at, kind, upto) in enumerate(zip(*columns, strict=True)):
            if group != (key, level, cell):
                group, begun = (key, level, cell), []
            if kind == 0:
                heapq.heappush(begun, (upto, number, span[i].as_py()))
                number += 1
                continue
            while begun and begun[0][0] < at:
                heapq.heappop(begun)
            rows += [i] * len(begun)
            spans += [x[2] for x in begun]
            if len(rows) >= 100_000:
                yield _found(b, rows, spans)
                rows, spans = [], []
        yield _found(b, rows, spans)


def _found(batch: pa.RecordBatch, rows: list[int], spans: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("point").take(pa.array(rows, pa.int64())), pa.array(spans, batch.column("span").type)], names=["point", "span"])
