"""Training data from token sequences: route filters, masks, overlapping chunks, batches by token budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayflow.functions import constants as C

UNK, PAD, CONT = (C.SPECIAL_TOKENS.index(t) for t in ("[UNK]", "[PAD]", "[CONT]"))


def dropped_by_route(vocab: DataFrame, route: str) -> DataFrame:
    """(id): waveform tokens that a route does not have. Unknown routes keep all."""
    allowed = C.ECG_ROUTES.get(route)
    ecg = vocab.where(F.col("token").startswith("ECG//"))
    if allowed is None:
        return ecg.where(F.lit(False)).select("id")
    for prefix in allowed:
        ecg = ecg.where(~F.col("token").startswith(prefix))
    return ecg.select("id")


def filter_route(rows: DataFrame, vocab: DataFrame, route: str, drop_orphans: bool = False) -> DataFrame:
    """Token rows (hospitalization_id, pos, token_id, ...) that the route keeps; positions stay as they were. Bin tokens
    behind a dropped similarity stay, unless drop_orphans."""
    dropped = dropped_by_route(vocab, route)
    if not drop_orphans:
        return rows.join(dropped.withColumnRenamed("id", "token_id"), "token_id", "left_anti")
    bins = vocab.where(F.col("token").rlike("^Q_-?[0-9]+$")).select(F.col("id").alias("of"), F.lit("bin").alias("kind"))
    marked = rows.join(dropped.select(F.col("id").alias("of"), F.lit("dropped").alias("kind")).unionByName(bins), F.col("token_id") == F.col("of"), "left")
    before = F.lag("kind").over(Window.partitionBy("hospitalization_id").orderBy("pos"))
    marked = marked.withColumn("orphan", (F.col("kind") == "bin") & before.eqNullSafe(F.lit("dropped")))
    return marked.where(~F.coalesce((F.col("kind") == "dropped") | F.col("orphan"), F.lit(False))).drop("of", "kind", "orphan")


def filter_arrays(seqs: DataFrame, drop: list[int]) -> DataFrame:
    """The same for sequences as arrays, timestamps in parallel."""
    kept = F.filter(F.arrays_zip("token_ids", "timestamps_us"), lambda x: ~x.token_ids.isin(drop) if drop else F.lit(True))
    return seqs.withColumn("kept", kept).select("hospitalization_id", F.col("kept.token_ids").alias("token_ids"), F.col("kept.timestamps_us").alias("timestamps_us"), F.size("kept").alias("token_count"))


def label_ids(vocab: DataFrame, prefixes: tuple[str, ...] = C.LOSS_PREFIXES) -> DataFrame:
    """(id) of tokens that weigh more in training."""
    test = F.lit(False)
    for p in prefixes:
        test = test | F.col("token").startswith(p)
    return vocab.where(test).select("id")


def label_mask(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add `is_label` to token rows."""
    marked = labels.select(F.col("id").alias("label_id"))
    return rows.join(marked, F.col("token_id") == F.col("label_id"), "left").withColumn("is_label", F.col("label_id").isNotNull()).drop("label_id")


def chunk_starts(length: Column, max_len: int, overlap: int) -> Column:
    """Where chunks begin: one at 0 if the sequence fits or overlap is 0, else every max(max_len - overlap, 1) up to the first that reaches the end."""
    stride = max(max_len - overlap, 1)
    last = (F.ceil((length - max_len) / stride) * stride).cast("int")
    many = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride))
    return F.when((length <= max_len) | F.lit(overlap == 0), F.array(F.lit(0))).otherwise(many)


def chunks(seqs: DataFrame, max_len: int, overlap: int = 0, labels: list[int] | None = None, cont: bool = True) -> DataFrame:
    """(hospitalization_id, chunk, start, ids, label_mask, loss_mask). Later chunks begin with [CONT], whose place a full
    chunk makes by losing its last token; the overlap bears no loss, [CONT] does."""
    n = F.size("token_ids")
    rows = seqs.select("hospitalization_id", "token_ids", F.posexplode(chunk_starts(n, max_len, overlap)).alias("chunk", "start"))
    part = F.slice("token_ids", F.col("start") + 1, F.lit(max_len))
    later = F.col("start") > 0
    ids = F.when(later & F.lit(cont), F.slice(F.concat(F.array(F.lit(CONT)), part), 1, max_len)).otherwise(part)
    rows = rows.withColumn("ids", ids).drop("token_ids")
    free = F.when(later & F.lit(cont and overlap > 0), F.lit(1)).otherwise(0)
    masked = F.when(later, F.lit(overlap)).otherwise(0)
    loss = F.transform("ids", lambda _, i: F.when((i >= free) & (i < masked), 0).otherwise(1))
    is_label = F.transform("ids", lambda t: t.isin(labels) if labels else F.lit(False))
    return rows.withColumns({"label_mask": is_label, "loss_mask": loss})


def token_batches(chunk_rows: DataFrame, budget: int, seed: int | None = None) -> DataFrame:
    """Add (length, batch, place): chunks in order of length, a new batch where the sum of lengths would pass the budget.

    A chunk longer than the budget is a batch of its own. The running sum starts anew with each batch, so lengths are
    taken in order within ranges of equal length: whole batches of one length are arithmetic, and only their counts per
    length, which are as many as there are lengths, go through one task. With a seed, batches are numbered anew in a
    random order.
    """
    rows = chunk_rows.withColumn("length", F.size("ids"))
    counts = rows.groupBy("length").agg(F.count("*").alias("n"))

    def plan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths = pd.concat(list(parts)).sort_values("length")
        out, batch, used, filled = [], 0, 0, False
        for length, n in zip(lengths["length"], lengths["n"], strict=True):
            done = 0
            while done < n:
                room = (budget - used) // length if length else n
                if room <= 0 and filled:
                    batch, used, filled = batch + 1, 0, False
                    continue
                take = min(n - done, max(room, 1))
                whole = max(1, budget // length) if length else n
                if not filled and n - done > 2 * whole:  # many full batches of this length at once
                    full = (n - done) // whole
                    out.append((length, done, done + full * whole, batch, whole))
                    done, batch = done + full * whole, batch + full
                    continue
                out.append((length, done, done + take, batch, take))
                done, used, filled = done + take, used + take * length, True
        yield pd.DataFrame(out, columns=["length", "from", "upto", "first", "each"])

    steps = counts.coalesce(1).mapInPandas(plan, "length int, `from` long, upto long, first long, each long")
    # a length may hold most chunks, so they are numbered in slices, and slices are counted up within their length
    rows = rows.withColumn("slice", F.substring(F.md5(F.concat_ws("/", "hospitalization_id", "chunk")), 1, 2))
    sizes = rows.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("length").alias("sl"), F.col("slice").alias("ss"), (F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "slice").orderBy("hospitalization_id", "chunk"))
    ranked = rows.withColumn("place", place).join(before, (F.col("length") == F.col("sl")) & (F.col("slice") == F.col("ss")))
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place") - 1).drop("slice", "sl", "ss", "before", "place")
    steps = steps.withColumnRenamed("length", "l")
    placed = ranked.join(steps, (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("upto")))
    batch = F.col("first") + F.floor((F.col("rank") - F.col("from")) / F.col("each"))
    placed = placed.withColumn("batch", batch.cast("long")).drop("l", "rank", "from", "upto", "first", "each")
    return placed if seed is None else shuffled(placed, seed)


def shuffled(batch_rows: DataFrame, seed: int) -> DataFrame:
    """Batches numbered anew in the order of a seeded hash. Batches, not rows, are numbered: in ranges of the hash, and
    ranges are counted up, so that no task orders all batches."""
    batches = batch_rows.select("batch").distinct().withColumn("hash", F.md5(F.concat_ws("/", F.lit(str(seed)), "batch")))
    batches = batches.withColumn("range", F.substring("hash", 1, 3))
    sizes = batches.groupBy(F.col("range").alias("r")).agg(F.count("*").alias("n"))
    before = sizes.select("r", (F.sum("n").over(Window.orderBy("r")) - F.col("n")).alias("before"))  # 4096 rows at most
    place = F.row_number().over(Window.partitionBy("range").orderBy("hash", "batch")) - 1
    numbered = batches.withColumn("place", place).join(before, F.col("range") == F.col("r"))
    numbered = numbered.select(F.col("batch").alias("old"), (F.col("before") + F.col("place")).cast("long").alias("new"))
    return batch_rows.join(numbered, F.col("batch") == F.col("old")).withColumn("batch", F.col("new")).drop("old", "new")


def padded(batch_rows: DataFrame) -> DataFrame:
    """ids, label_mask and loss_mask padded to the longest of the batch; attention_mask tells the padding."""
    widths = batch_rows.groupBy("batch").agg(F.max("length").alias("width"))
    rows = batch_rows.join(widths, "batch")
    pad = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.col("width") - F.col("length")))
    ones = F.array_repeat(F.lit(1), F.col("length"))
    return rows.withColumns({"ids": pad(F.col("ids"), PAD), "label_mask": pad(F.col("label_mask"), False), "loss_mask": pad(F.col("loss_mask"), 0), "attention_mask": pad(ones, 0)})
