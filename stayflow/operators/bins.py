"""Numeric bins: exact percentiles as edges, clinical edges, and their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayflow.functions import constants as C
from stayflow.functions.expressions import bin_of
from stayflow.sources.catalog import Catalog
from stayflow.sources.store import written

NUMERIC_SOURCES = (
    ("vitals", "vital_category", "VITAL", "vital_value"),
    ("labs", "lab_category", "LAB_RESULT", "lab_value_numeric"),
    ("medication_admin_continuous", "med_category", "MED_CONT", "med_dose"),
    ("medication_admin_intermittent", "med_category", "MED_BOLUS", "med_dose"),
)

#: Waveform branches and the columns of their similarities.
BRANCHES = {"1D": "1d_similarity", "2D_Morphology": "2d_partial_similarity", "2D_Global": "2d_global_similarity"}


def numeric_values(t: Catalog, ids: DataFrame | None = None) -> DataFrame:
    """(code, value), values that are not null."""

    def one(name: str, column: str, prefix: str, value: str) -> DataFrame:
        rows = t[name] if ids is None else t.for_stays(name, ids)
        return rows.where(F.col(value).isNotNull()).select(F.concat(F.lit(f"{prefix}//"), F.col(column)).alias("code"), F.col(value).alias("value"))

    return reduce(DataFrame.unionByName, [one(*s) for s in NUMERIC_SOURCES])


def _cell(cuts: Column, value: Column) -> Column:
    """Where a value stands among ascending cuts: 2j + 1 on cut j, 2j between the cuts before and at j. NaN is above all."""
    below = F.size(F.filter(cuts, lambda c: c < value))
    return 2 * below + F.when(F.get(cuts, below) == value, 1).otherwise(0)


def rank_brackets(values: DataFrame, key: str, n_bins: int, k: int, error: float) -> DataFrame:
    """(known, total, cuts, inside): cuts around each percentile's rank from a mergeable rank sketch of k items, and which of
    the gaps between cuts (the first below them, the last above) lie in a bracket. Keys of up to k values are one gap."""
    ranks = [(max(0.0, i / n_bins - error), min(1.0, i / n_bins + error)) for i in range(n_bins + 1)]
    sketch = values.groupBy(F.col(key).alias("known")).agg(F.count("*").alias("total"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))
    sketch = sketch.where(F.col("total") >= n_bins)
    large = (F.col("total") > k) & (F.kll_sketch_get_n_double("sketch") > 0)
    at = F.when(large, F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(r) for pair in ranks for r in pair]))).otherwise(F.array().cast("array<double>"))
    # nothing of a sketch stays in the table: a few numbers a key
    found = sketch.select("known", "total", at.alias("at")).withColumn("cuts", F.array_sort(F.array_distinct("at")))
    ends = F.transform(F.sequence(F.lit(0), F.lit(n_bins)), lambda i: F.struct(F.get("at", 2 * i).alias("low"), F.get("at", 2 * i + 1).alias("high")))
    gap = lambda j: F.exists(ends, lambda e: (e.low <= F.get("cuts", j - 1)) & (e.high >= F.get("cuts", j)))
    inside = F.transform(F.sequence(F.lit(0), F.size("cuts")), lambda j: F.coalesce(gap(j), F.lit(False)) | (F.size("cuts") == 0))
    return found.select("known", "total", "cuts", inside.alias("inside"))


def quantile_edges(values: DataFrame, n_bins: int = 10, key: str = "code", k: int = 2048, error: float = 0.003) -> DataFrame:
    """(key, edges array<double>): distinct values of the linear-interpolated percentiles, for keys with n_bins values or more.

    A first reading sketches the ranks of each key's values. A second one counts values by the gaps between the sketch's
    brackets, and single values inside brackets only, so that a few per cent of the distinct values are shuffled and ordered.
    The counts say where each wanted rank truly lies; should one lie outside its bracket, that gap's values are counted in
    a third reading. The two values around each rank are interpolated exactly as a + d*t for t < 0.5, else b - d*(1 - t).
    """
    held = values.where(F.col("value").isNotNull()).select(F.col(key).alias("key"), F.col("value").cast("double").alias("value"))
    brackets = written(rank_brackets(held, "key", n_bins, k, error), "brackets")
    placed = held.join(brackets, F.col("key") == F.col("known")).withColumn("cell", _cell(F.col("cuts"), F.col("value")))
    single = (F.col("cell") % 2 == 1) | F.get("inside", F.shiftright("cell", 1))
    counted = placed.withColumn("value", F.when(single, F.col("value"))).groupBy("key", "cell", "value").agg(F.count("*").alias("n"))
    counted = written(counted, "counts")
    # at most two cells for each of the few cuts of a key
    before = F.sum("held").over(Window.partitionBy("key").orderBy("cell")) - F.col("held")
    cells = counted.groupBy("key", "cell").agg(F.sum("n").alias("held"), F.count("value").alias("singles")).withColumn("before", before)
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(100.0 * i / n_bins / 100).alias("p")) for i in range(n_bins + 1)])
    h = (F.col("total") - 1) * F.col("q.p")
    wanted = brackets.select("known", "total", F.explode(ranks).alias("q"))
    wanted = wanted.select("known", F.col("q.i").alias("i"), F.floor(h).alias("low"), F.least(F.floor(h) + 1, F.col("total") - 1).alias("high"), (h - F.floor(h)).alias("t"))
    holds = lambda r, upto, n: (r >= upto - n) & (r < upto)
    upto, size = F.col("before") + F.col("held"), F.col("held")
    asked = cells.join(wanted, F.col("key") == F.col("known")).where(holds(F.col("low"), upto, size) | holds(F.col("high"), upto, size))
    asked = written(asked.groupBy("key", "cell", "before", "singles").agg(F.collect_list(F.struct("i", "low", "high", "t")).alias("ranks")), "asked")
    rows = counted.where("value is not null")
    missed = asked.where("singles = 0").select("key", "cell")
    if not missed.isEmpty():
        more = placed.join(missed, ["key", "cell"]).groupBy("key", "cell", "value").agg(F.count("*").alias("n"))
        rows = rows.unionByName(more)
    by = Window.partitionBy("key", "cell").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(asked, ["key", "cell"]).withColumn("upto", F.col("before") + F.sum("n").over(by))
    rows = rows.select("key", "value", "n", "upto", F.inline("ranks"))
    has = lambda r: holds(F.col(r), F.col("upto"), F.col("n"))
    ends = rows.where(has("low") | has("high")).groupBy("key", "i").agg(F.max(F.when(has("low"), F.col("value"))).alias("a"), F.max(F.when(has("high"), F.col("value"))).alias("b"), F.first("t").alias("t"))
    d = F.col("b") - F.col("a")
    edge = F.when(F.col("t") < 0.5, F.col("a") + d * F.col("t")).otherwise(F.col("b") - d * (1 - F.col("t")))
    return ends.groupBy(F.col("key").alias(key)).agg(F.array_sort(F.collect_set(edge)).alias("edges"))


def clinical_edges(like: DataFrame) -> DataFrame:
    """The clinical edges as a table (code, clinical)."""
    rows = ", ".join(f"('{code}', array({', '.join(f'{float(e)!r}d' for e in edges)}))" for code, edges in C.CLINICAL_EDGES.items())
    return like.sparkSession.sql(f"select * from values {rows} as c(code, clinical)")


def bin_edges(values: DataFrame, mode: str = "hybrid", n_bins: int = 10) -> DataFrame:
    """(code, edges) by mode. quantile: percentiles; clinical_only: the clinical lists; hybrid (also for unknown modes):
    clinical lists, joined with the percentiles where they are fewer than n_bins + 1, and percentiles for other codes."""
    if mode == "quantile":
        return quantile_edges(values, n_bins)
    clinical = clinical_edges(values)
    if mode == "clinical_only":
        return clinical.select("code", F.col("clinical").alias("edges"))
    both = clinical.join(quantile_edges(values, n_bins), "code", "full")
    short = (F.size("clinical") < n_bins + 1) & F.col("edges").isNotNull()
    merged = F.when(F.col("clinical").isNull(), F.col("edges")).when(short, F.array_sort(F.array_union("clinical", "edges"))).otherwise(F.col("clinical"))
    return both.select("code", merged.alias("edges"))


def bin_counts(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, bin, n): how many values of each code that has edges lie in each of its bins."""
    return with_bins(values, edges).where("bin is not null").groupBy("code", "bin").agg(F.count("*").alias("n"))


def ecg_similarity_edges(ecg: DataFrame, n_bins: int = 10) -> DataFrame:
    """(branch, edges) of the three similarity columns."""
    long = ecg.select(F.inline(F.array(*[F.struct(F.lit(b).alias("branch"), F.col(f"`{c}`").alias("value")) for b, c in BRANCHES.items()])))
    return quantile_edges(long, n_bins, "branch")


def similarity_bin(edges: Column, value: Column, default: int = 5) -> Column:
    """The bin of a waveform similarity; `default` where its branch has no edges."""
    return F.when(edges.isNull(), F.lit(default)).otherwise(bin_of(edges, value))


def with_similarity_bins(ecg: DataFrame, edges: DataFrame) -> DataFrame:
    """(hadm_id, ecg_time, branch, similarity, bin): a row per recording and branch with a similarity."""
    long = F.array(*[F.struct(F.lit(b).alias("branch"), F.col(f"`{c}`").alias("similarity")) for b, c in BRANCHES.items()])
    rows = ecg.select("hadm_id", "ecg_time", F.inline(long)).where("similarity is not null")
    known = edges.withColumnRenamed("branch", "known")
    return rows.join(known, F.col("branch") == F.col("known"), "left").select("hadm_id", "ecg_time", "branch", "similarity", similarity_bin(F.col("edges"), F.col("similarity")).alias("bin"))


def with_bins(df: DataFrame, edges: DataFrame, bin_of=bin_of, code: str = "code", value: Column | None = None) -> DataFrame:
    """Add `bin`, null where the code has no edges."""
    joined = df.join(edges.withColumnRenamed("code", "edge_code"), F.col(code) == F.col("edge_code"), "left")
    return joined.withColumn("bin", bin_of(F.col("edges"), F.col("value") if value is None else value)).drop("edge_code", "edges")
