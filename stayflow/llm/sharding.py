"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced jointly.

Rows with equal texts are a group and stay in one shard. Only a group that holds more than a whole shard's share of bytes,
tokens or rows can't, and is cut into pieces of an eighth of a share; rows that are equal in id as well are counted first
and their copies dealt evenly to pieces, so that a single row repeated any number of times is cut like any other group. A piece (of a group, or a whole one) goes to the
shard where the dot product of the piece and the shard's residual capacity is highest.

Pieces are packed in classes from the heaviest to the lightest, so that the lighter ones fill what the heavier ones left
uneven. A class is dealt by hash to cells of about `cell` pieces, each of which fills the residual capacity of all shards
in proportion, so no task sees more than a cell and the driver no more than the shards' loads.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stayflow.llm.common import BLANKS
from stayflow.sources.store import scratch, written

DIMENSIONS = ("bytes", "tokens", "rows")
#: What the dimensions count in the dot product; the law is that bytes are near equal.
WEIGHTS = np.array([4.0, 1.0, 1.0])
#: Copies of a row that one task makes from a count.
MANY = 4096
#: The heaviest piece of a class weighs up to so many times the lightest.
STEP = 16


def pack(sizes: np.ndarray, shards: int, first: int = 0, left: np.ndarray | None = None, weights: np.ndarray = WEIGHTS) -> np.ndarray:
    """The shard of each piece. sizes: a row per piece, a column per dimension. left: the share of the pieces' total that
    each shard is to get, a row per shard (equal shares if None). Of equal shards the next after `first` is taken."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    totals = sizes.sum(axis=0, dtype=np.float64)
    shares = sizes / np.where(totals > 0, totals, 1)
    left = np.full((shards, sizes.shape[1]), 1 / shards) if left is None else left
    turn = (np.arange(shards) + first) % shards
    left = left[turn]
    result = np.empty(len(sizes), np.int64)
    for i in np.argsort(-shares.max(axis=1), kind="stable"):
        best = int(np.argmax(left @ (shares[i] * weights)))
        left[best] -= shares[i]
        result[i] = best
    return turn[result]


def classes_of(counts: dict[int, int], cell: int) -> list[tuple[int, int, int]]:
    """Counts of pieces by logarithm of weight (0 is the heaviest) -> (first, last, pieces) of each class. What fits into
    one cell together with all that is heavier is one class."""
    found: list[tuple[int, int, int]] = []
    for level in sorted(counts):
        if found and found[-1][2] + counts[level] <= cell and len(found) == 1:
            found[-1] = (found[-1][0], level, found[-1][2] + counts[level])
        else:
            found.append((level, level, counts[level]))
    return found


def shard(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", cell: int = 8192) -> DataFrame:
    """(doc_id, size, tokens, text_crc32, shard, slot), a row per row of docs; text is not shuffled.

    size: UTF-8 bytes plus 1 (a null text has none: size 1, crc 0, grouped with empty texts); tokens: runs of characters
    that are not white space. slot numbers a shard's rows from 0 without gaps, in order of (a hash of) the group, id and
    size; repeated rows get slots of their own. A null id is a value like any other. An empty table gives an empty table.
    """
    full = F.coalesce(F.col(text), F.lit(""))
    blank = F.translate(full, BLANKS, "      ")
    tokens = F.when(F.length(F.trim(blank)) > 0, F.regexp_count(blank, F.lit(r"[^ ]+"))).otherwise(0)
    found = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(full) + 1).cast("long").alias("size"), tokens.cast("long").alias("tokens"), F.crc32(full.cast("binary")).alias("text_crc32"), F.xxhash64(full).alias("h")
    )
    with scratch() as keep:
        rows = written(found.groupBy(*found.columns).agg(F.count("*").alias("copies")), "sizes")
        total = rows.agg(*_sums()).first()
        if not total["rows"]:
            keep(rows)
            return rows.select("doc_id", "size", "tokens", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
        placed, rows = _placed(rows, np.array([float(total[d] or 0) for d in DIMENSIONS]), shards, cell)
        rows = rows.join(placed, ["h", "text_crc32", "piece"])
        # slots: rows are numbered in small ranges of hashes, and ranges are counted up within their shard
        ranges = max(1, round(total["rows"] / (shards * 20_000)))
        rows = written(rows.withColumn("range", F.pmod(F.xxhash64(F.lit("range"), "h", "piece", "doc_id"), F.lit(ranges)).cast("int")), "shards")
        counts = rows.groupBy("shard", "range").agg(F.sum("copies").alias("n"))
        before = counts.select("shard", "range", (F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).alias("before"))
        before = written(before, "ranges")
        keep(rows, before)
    order = Window.partitionBy("shard", "range").orderBy("h", "text_crc32", "piece", F.col("doc_id").asc_nulls_first(), "size")
    upto = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("first", upto - F.col("copies")).join(before, ["shard", "range"]).withColumn("first", F.col("first") + F.col("before"))
    few = rows.where(F.col("copies") <= MANY).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    many = rows.where(F.col("copies") > MANY).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(MANY).cast("long"))))
    many = many.repartition("h", "piece", "doc_id", "from").withColumn("i", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + MANY, F.col("copies")) - 1))).drop("from")
    return few.unionByName(many).select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("first") + F.col("i")).cast("long").alias("slot"))


def _sums() -> list[Column]:
    """The dimensions of rows that stand for `copies` rows each."""
    return [F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("rows")]


def _packer(shards: int, number: int, left: np.ndarray):
    """The pieces of a cell with their shards, for applyInPandas; number is that of the class."""

    def place(cell_rows: pd.DataFrame) -> pd.DataFrame:
        found = cell_rows.sort_values(["h", "text_crc32", "piece"], ignore_index=True)
        chosen = pack(found[list(DIMENSIONS)].to_numpy(np.float64), shards, int(found["cell"].iloc[0]) * 7 + number, left)
        return found[["h", "text_crc32", "piece", *DIMENSIONS]].assign(shard=chosen.astype(np.int32))

    return place


def _placed(rows: DataFrame, total: np.ndarray, shards: int, cell: int) -> tuple[DataFrame, DataFrame]:
    """(h, text_crc32, piece, shard) of all pieces, and rows with their piece."""
    group, piece = ["h", "text_crc32"], ["h", "text_crc32", "piece"]
    weight = F.greatest(*[F.col(d) / max(1.0, t) for d, t in zip(DIMENSIONS, total, strict=True)])
    groups = rows.groupBy(*group).agg(*_sums())
    # at most 3 * shards groups have more than a shard's share of something, whatever the size of the table
    cut = F.least(F.ceil(weight * shards * 8), F.col("rows")).cast("int")
    large = written(groups.where((weight > 1 / shards) & (F.col("rows") > 1)).select(*group, cut.alias("pieces")), "large")
    rows = rows.join(F.broadcast(large), group, "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    # the copies of a row go to as many pieces as there are, beginning with that of its hash
    among = F.least("copies", "pieces").cast("int")
    rows = rows.withColumns({"among": among, "j": F.explode(F.sequence(F.lit(0), among - 1))})
    by = F.pmod(F.pmod(F.xxhash64(F.lit("piece"), "doc_id", "size"), F.col("pieces")) + F.col("j"), F.col("pieces")).cast("int")
    share = F.floor(F.col("copies") / F.col("among")) + F.when(F.col("j") < F.col("copies") % F.col("among"), 1).otherwise(0)
    rows = rows.withColumns({"piece": by, "copies": share}).drop("pieces", "among", "j")
    level = F.greatest(F.lit(0), F.floor(-F.log(float(STEP), weight))).cast("int")
    parts = written(rows.groupBy(*piece).agg(*_sums()).withColumn("level", level), "pieces")
    counts = {r["level"]: r["n"] for r in parts.groupBy("level").agg(F.count("*").alias("n")).collect()}
    load, done = np.zeros((shards, len(DIMENSIONS))), []
    for number, (first, last, n) in enumerate(classes_of(counts, cell)):
        left = total / shards - load
        left = left / np.where(left.sum(axis=0) > 0, left.sum(axis=0), 1)
        cells = max(1, round(n / cell))
        dealt = parts.where(F.col("level").between(first, last)).withColumn("cell", F.pmod(F.xxhash64(F.lit("cell"), *piece), F.lit(cells)).cast("int"))
        one = written(dealt.groupBy("cell").applyInPandas(_packer(shards, number, left), "h long, text_crc32 long, piece int, bytes long, tokens long, rows long, shard int"), "placed")
        for r in one.groupBy("shard").agg(*[F.sum(d).alias(d) for d in DIMENSIONS]).collect():
            load[r["shard"]] += [r[d] for d in DIMENSIONS]
        done.append(one.select(*piece, "shard"))
    return reduce(DataFrame.unionByName, done), rows
