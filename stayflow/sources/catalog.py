"""Source tables by name: Parquet scans with declared columns, id filters and the artifacts that runs leave behind."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, is_dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stayflow.sources.store import delete, write_text

#: Declared columns of each source table. Columns that a file lacks are added as nulls of their type.
SCHEMAS: dict[str, str] = {
    "patient": "patient_id string, race_category string, sex_category string, birth_date timestamp_ntz, death_dttm timestamp_ntz",
    "hospitalization": "patient_id string, hospitalization_id string, admission_dttm timestamp_ntz, discharge_dttm timestamp_ntz, age_at_admission bigint, discharge_category string",
    "adt": "hospitalization_id string, in_dttm timestamp_ntz, out_dttm timestamp_ntz, location_category string",
    "vitals": "hospitalization_id string, recorded_dttm timestamp_ntz, vital_category string, vital_value double",
    "labs": "hospitalization_id string, lab_order_dttm timestamp_ntz, lab_collect_dttm timestamp_ntz, lab_result_dttm timestamp_ntz, lab_category string, lab_value_numeric double",
    "medication_admin_continuous": "hospitalization_id string, admin_dttm timestamp_ntz, med_category string, med_group string, med_dose double, med_dose_unit string, mar_action_category string",
    "medication_admin_intermittent": "hospitalization_id string, admin_dttm timestamp_ntz, med_category string, med_group string, med_dose double, med_dose_unit string, mar_action_category string",
    "respiratory_support": "hospitalization_id string, recorded_dttm timestamp_ntz, device_category string, mode_category string, fio2_set double, peep_set double, tidal_volume_set double, resp_rate_set double, pressure_support_set double, tracheostomy boolean",
    "patient_assessments": "hospitalization_id string, recorded_dttm timestamp_ntz, assessment_category string, numerical_value double, categorical_value string",
    "code_status": "patient_id string, hospitalization_id string, start_dttm timestamp_ntz, code_status_category string",
    "position": "hospitalization_id string, recorded_dttm timestamp_ntz, position_category string",
    "hospital_diagnosis": "hospitalization_id string, diagnosis_code string, diagnosis_code_format string, diagnosis_primary bigint, poa_present bigint",
    "patient_procedures": "hospitalization_id string, procedure_code string, procedure_code_format string, procedure_billed_dttm timestamp_ntz",
    "crrt_therapy": "hospitalization_id string, recorded_dttm timestamp_ntz, crrt_mode_category string, blood_flow_rate double, ultrafiltration_out double",
    "ecmo_mcs": "hospitalization_id string, recorded_dttm timestamp_ntz, device_category string, mcs_group string, flow double",
    "ecg": "subject_id bigint, hadm_id bigint, ecg_time timestamp_ntz, top1class string, top1score double, `1d_prototype_num` bigint, `2d_partial_prototype_num` bigint, `2d_global_prototype_num` bigint, `1d_similarity` double, `2d_partial_similarity` double, `2d_global_similarity` double",
}


#: Ids that are sent to the readers as a predicate, and bytes of a row group of files by stay.
FEW, ROW_GROUP = 10_000, 4 << 20


@cache
def declared(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


class Catalog:
    """Tables by name. A table that is not there is empty with its declared columns, or an error if it is asked for strictly."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame]):
        self.spark, self.tables = spark, dict(tables)
        #: Columns that the files have, before declared ones were added.
        self.own = {name: set(df.columns) for name, df in self.tables.items()}
        self.typed: dict[str, DataFrame] = {}

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str, prefix: str = "") -> Catalog:
        """Every <prefix><name>.parquet of a folder whose name is declared."""
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        there = {s.getPath().getName() for s in fs.listStatus(path)} if fs.exists(path) else set()
        return cls(spark, {n: spark.read.parquet(f"{folder}/{prefix}{n}.parquet") for n in SCHEMAS if f"{prefix}{n}.parquet" in there})

    def has(self, name: str) -> bool:
        return name in self.tables

    def __getitem__(self, name: str) -> DataFrame:
        """The table with its declared columns, cast, then any others."""
        if name not in SCHEMAS:
            raise KeyError(name)
        if name not in self.typed:
            self.typed[name] = self._typed(name, declared(name))
        return self.typed[name]

    def _typed(self, name: str, schema: StructType) -> DataFrame:
        if not self.has(name):
            return self.spark.createDataFrame([], schema)
        df, own = self.tables[name], self.own[name]
        others = [c for c in df.columns if c not in schema.names]
        columns = [(F.col(f"`{f.name}`") if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        return df.select(*columns, *[F.col(f"`{c}`") for c in others])

    def strict(self, name: str) -> DataFrame:
        if not self.has(name):
            raise FileNotFoundError(f"no table {name}")
        return self[name]

    def for_stays(self, name: str, ids: DataFrame) -> DataFrame:
        """Rows of the stays in ids (hospitalization_id); unknown ids give no rows."""
        return self[name].join(ids.select("hospitalization_id").distinct(), "hospitalization_id", "left_semi")

    def for_ids(self, name: str, ids: Sequence[str]) -> DataFrame:
        """Rows of the stays in a list. Up to FEW ids are a predicate that reaches the Parquet reader: of files written by
        write_by_stay() it skips row groups whose Bloom filter knows none of them. Longer lists are a semi-join, to which
        Spark adds its own runtime filter."""
        wanted = sorted({i for i in ids if i is not None})
        if len(wanted) > FEW:
            return self.for_stays(name, self.spark.createDataFrame([(i,) for i in wanted], "hospitalization_id string"))
        self.spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(FEW))
        return self[name].where(F.col("hospitalization_id").isin(wanted))

    def patient_ids(self) -> DataFrame:
        return self["patient"].select("patient_id").distinct().orderBy("patient_id")

    def stay_ids(self, patients: DataFrame | None = None) -> DataFrame:
        stays = self["hospitalization"]
        if patients is not None:
            stays = stays.join(patients.select("patient_id"), "patient_id", "left_semi")
        return stays.select("hospitalization_id").distinct().orderBy("hospitalization_id")

    def preload(self, ids: DataFrame, names: list[str]) -> Catalog:
        """A catalog of the stays in ids, its tables dealt by stay and kept; release() lets them go."""
        kept = {n: self.for_stays(n, ids).repartition("hospitalization_id").persist() for n in names if self.has(n) and n != "patient"}
        return Catalog(self.spark, self.tables | kept)

    def release(self) -> None:
        for df in self.tables.values():
            df.unpersist()


def read_ecg_csv(spark: SparkSession, path: str) -> DataFrame:
    """Waveform prototypes from CSV; shifted_ecg_time is the time of the recording."""
    schema = declared("ecg")
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    time = "shifted_ecg_time" if "shifted_ecg_time" in raw.columns else "ecg_time"
    named = raw.withColumn("ecg_time", F.try_to_timestamp(F.col(time)).cast("timestamp_ntz"))
    numbers = {f.name: (F.col(f"`{f.name}`") if f.name in named.columns else F.lit(None)) for f in schema}
    return named.select(*[c.try_cast("double").cast(f.dataType) if f.dataType.simpleString() == "bigint" else c.try_cast(f.dataType) for f in schema for c in [numbers[f.name]]]).toDF(*schema.names)


def id_map(stays: DataFrame) -> DataFrame:
    """(hadm_id bigint, hospitalization_id), empty if any id is no number."""
    ids = stays.select("hospitalization_id").distinct().withColumn("hadm_id", F.col("hospitalization_id").try_cast("bigint"))
    bad = ids.where(F.col("hadm_id").isNull() & F.col("hospitalization_id").isNotNull()).agg(F.count("*").alias("bad"))
    return ids.where("hadm_id is not null").join(F.broadcast(bad), F.col("bad") == 0).select("hadm_id", "hospitalization_id")


def save_json(spark: SparkSession, artifact, path: str) -> None:
    """A small artifact (dataclass, dictionary or collected rows) as JSON, in whatever file system the path names."""
    data = asdict(artifact) if is_dataclass(artifact) else [r.asDict(recursive=True) for r in artifact.collect()] if isinstance(artifact, DataFrame) else artifact
    write_text(spark, path, json.dumps(data, indent=2, default=str))


def load_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


#: Declared columns of the artifacts that a run leaves behind.
ARTIFACTS: dict[str, str] = {
    "splits": "patient_id string, first_admit timestamp_ntz, split string",
    "code_profile": "code string, event_count bigint, admission_count bigint, included boolean",
    "bin_edges": "code string, edges array<double>",
    "token_edges": "code string, edges array<double>",
    "similarity_edges": "branch string, edges array<double>",
    "vocabulary": "token string, id int",
    "intervals": "label string, horizon_hours int, low double, median double, high double",
}


def load_artifact(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """An artifact with its declared columns and types; one that lacks a column or has another type is an error."""
    schema = StructType.fromDDL(ARTIFACTS[name])
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    found = {f.name: f.dataType.simpleString() for f in df.schema}
    if wrong := [f.name for f in schema if found.get(f.name) != f.dataType.simpleString()]:
        raise ValueError(f"{name} in {folder}: no fitting column {', '.join(wrong)}")
    return df.select(*schema.names)


def export_artifact(spark: SparkSession, name: str, folder: str, path: str) -> None:
    """An artifact as JSON lines, written by Spark."""
    load_artifact(spark, name, folder).write.mode("overwrite").json(path)


@dataclass
class StageResult:
    """What a stage of a run reports."""

    success: bool
    output_path: str
    duration_seconds: float
    metrics: dict
    errors: list[str] = None
    warnings: list[str] = None


def write_log(log: DataFrame, path: str, keep_empty: bool = True) -> bool:
    """An event log or token sequences to Parquet with zstd. Without keep_empty a log of no rows leaves no file; the result
    says whether there is one."""
    log.write.mode("overwrite").option("compression", "zstd").parquet(path)
    if keep_empty or not log.sparkSession.read.schema(log.schema).parquet(path).isEmpty():
        return True
    delete(log.sparkSession, path)
    return False


def write_by_stay(df: DataFrame, path: str, row_group: int = ROW_GROUP) -> None:
    """A table as Parquet sorted by stay, with a Bloom filter of the stays for each of its small row groups."""
    sorted_rows = df.repartitionByRange("hospitalization_id").sortWithinPartitions("hospitalization_id")
    options = {"parquet.bloom.filter.enabled#hospitalization_id": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.block.size": str(row_group), "compression": "zstd"}
    sorted_rows.write.mode("overwrite").options(**options).parquet(path)


def read_sequences(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per stay with its events in order, from one or several files of an event log."""
    log = spark.read.parquet(*paths)
    item = F.struct("event_idx", "time", "code", "value", "value_cat")
    return log.groupBy("hospitalization_id").agg(F.sort_array(F.collect_list(item)).alias("events"))
