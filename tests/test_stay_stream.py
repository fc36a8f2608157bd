"""The streamed log equals the log of all events at once."""

import random
from datetime import datetime, timedelta

import pytest

from stayflow.operators.insert import with_gaps
from stayflow.streaming.stay_log import stay_log

T0 = datetime(2024, 1, 1)
SCHEMA = "hospitalization_id string, time timestamp_ntz, code string, value double, value_cat string, modality string, src int, stage int"


def events(seed):
    rng = random.Random(seed)
    rows = []
    for h in range(6):
        time = T0 + timedelta(minutes=rng.randint(0, 60))
        for i in range(rng.randint(1, 40)):
            time += timedelta(seconds=rng.choice([0, 0, 20, 90, 600, 4000, 40_000]), microseconds=rng.choice([0, 1, 999_999]))
            modality = rng.choice(["VITAL", "LABEL", "ECG", "DISCH", "DEMO"])
            rows.append((f"h{h}", time, f"{modality}//{i % 3}", rng.choice([None, 1.5, -2.0]), rng.choice([None, "x"]), modality, rng.randint(1, 3), rng.randint(0, 2)))
    return rows


@pytest.mark.parametrize("batches", [1, 7])
def test_any_cut_into_batches_gives_the_same_log(spark, tmp_path, batches):
    rows, rng = events(batches), random.Random(batches)
    # out of order by half an hour at most, within the hour that the watermark waits
    order = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.randint(0, 30)))
    end = max(r[1] for r in rows) + timedelta(hours=3)
    parts = [order[i * len(order) // batches : (i + 1) * len(order) // batches] for i in range(batches)]
    parts += [[("zz", end, "VITAL//end", None, None, "VITAL", 1, 0)], [("zz", end + timedelta(hours=3), "VITAL//end", None, None, "VITAL", 1, 0)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = stay_log(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).where("hospitalization_id <> 'zz'").collect()
    want = with_gaps(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: (r["hospitalization_id"], r["event_idx"], r["time"], r["code"], r["value"], r["value_cat"], r["modality"])
    assert sorted(map(key, got), key=str) == sorted(map(key, want), key=str) and any(r["modality"] == "DT" for r in got)
