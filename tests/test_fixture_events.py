"""The three-patient fixture: extraction, labels, insertion."""

from datetime import datetime, timedelta

import pytest

from stayflow.functions import constants as C
from stayflow.operators import dataset, extract, insert, labels, profile, split, tokens
from stayflow.sources.catalog import Catalog, id_map, read_ecg_csv


def codes(df, stay):
    return [r["code"] for r in df.where(f"hospitalization_id = '{stay}'").orderBy("event_idx").collect()]


@pytest.fixture(scope="module")
def log(mini):
    full = insert.full_log(extract.base_events(mini), mini["hospitalization"], labels.all_labels(mini))
    return full.persist()


def test_demographics_first_and_billing_after_discharge(log):
    got = codes(log, "H001")
    assert got[:3] == ["DEMO//AGE_60-69", "DEMO//SEX_Male", "DEMO//RACE_White"]
    assert got[3:5] == ["ICD_POA//E11.9", "ICD_POA//I50.9"]
    assert got[-2:] == ["ICD//E11.9", "ICD//I50.9"] and got.index("DISCH//GENERAL") < got.index("DISCH//Home")


def test_labels_of_the_fixture(mini):
    found = {}
    for r in labels.all_labels(mini).collect():
        found.setdefault(r["hospitalization_id"], {})[r["code"].removeprefix("LABEL//")] = r["time"]
    assert {"mortality", "icu_admission", "mech_vent", "high_fio2", "vasopressor", "gcs_low", "dnr", "prone", "crrt", "new_intubation"} <= set(found["H003"])
    assert {"discharge_home", "icu_admission", "vasopressor"} <= set(found["H001"]) and "mortality" not in found["H001"]
    assert found["H001"]["icu_admission"] == datetime(2020, 3, 15, 20, 30)
    assert "icu_admission" not in found.get("H002", {})


def test_registry():
    by = {}
    for s in labels.REGISTRY.values():
        by[s.category] = by.get(s.category, 0) + 1
    assert by == {"source_only": 42, "partial": 3, "external": 16}
    assert len(labels.names()) == 45 and labels.tokens(("partial",))[0] == "LABEL//readmit_30d"


def test_log_invariants(log, mini):
    rows = log.orderBy("hospitalization_id", "event_idx").collect()
    by = {}
    for r in rows:
        by.setdefault(r["hospitalization_id"], []).append(r)
    for stay, events in by.items():
        assert [r["event_idx"] for r in events] == list(range(len(events)))
        times = [r["time"] for r in events]
        assert times == sorted(times)
        kept = [r["code"] for r in events if r["code"].startswith("LABEL//")]
        assert len(kept) == len(set(kept)), stay


def test_clock_tokens(mini):
    got = insert.clock_events(mini["hospitalization"]).where("hospitalization_id = 'H001'").orderBy("time").collect()
    assert got[0]["code"] == "CLOCK//12:00" and got[0]["time"] == datetime(2020, 3, 15, 12)
    assert got[-1]["time"] == datetime(2020, 3, 18, 12) and len(got) == 19


def test_profile_filters(spark, mini):
    counts = profile.code_counts(mini)
    assert counts.where("code = 'VITAL//hr'").first()["event_count"] == 15
    kept = profile.profile(counts, {f: (10, 3) for f in C.THRESHOLDS})
    assert {r["code"] for r in kept.where("included").collect()} == {"VITAL//hr", "VITAL//sbp"}
    assert extract.labs(mini, kept).count() == 0 and extract.vitals(mini, kept).count() == 30
    assert extract.continuous_medications(mini, kept).count() == 0
    assert profile.profile(counts).where("included").count() == 0


def test_missing_and_unknown_tables(spark, mini):
    empty = Catalog(spark, {"hospitalization": mini["hospitalization"]})
    assert not empty.has("vitals") and empty["vitals"].count() == 0
    with pytest.raises(FileNotFoundError):
        empty.strict("vitals")
    with pytest.raises(KeyError):
        empty["nothing"]
    assert extract.base_events(empty).count() == 9  # an age and two discharge events for each stay


def test_ids(spark, mini):
    assert mini.patient_ids().count() == 3
    assert [r[0] for r in mini.stay_ids(spark.createDataFrame([("P002",)], "patient_id string")).collect()] == ["H002"]
    assert id_map(mini["hospitalization"]).count() == 0  # H001 is no number
    assert id_map(spark.createDataFrame([("17",), ("5",)], "hospitalization_id string")).count() == 2


def test_ecg_windows_and_routes(spark, mini, tmp_path):
    stay = mini["hospitalization"].where("hospitalization_id = 'H001'").first()
    admit, end = stay["admission_dttm"], stay["discharge_dttm"]
    path = tmp_path / "ecg.csv"
    times = [admit - timedelta(days=3), admit - timedelta(days=10), admit + timedelta(hours=12), end + timedelta(days=1)]
    lines = ["subject_id,hadm_id,shifted_ecg_time,top1class,top1score,1d_prototype_num,1d_similarity,2d_partial_prototype_num,2d_partial_similarity,2d_global_prototype_num,2d_global_similarity"]
    path.write_text("\n".join(lines + [f"1,7,{t:%Y-%m-%d %H:%M:%S},NSR,0.9,{i},0.5,12,0.25,,0.75" for i, t in enumerate(times)]))
    ecg = read_ecg_csv(spark, str(path))
    ids = spark.createDataFrame([(7, "H001")], "hadm_id long, hospitalization_id string")
    kept = insert.ecg_in_window(ecg, ids, mini["hospitalization"])
    assert [r["1d_prototype_num"] for r in kept.orderBy("ecg_time").collect()] == [0, 2]
    assert insert.ecg_in_window(ecg, ids, mini["hospitalization"], 2).count() == 1
    per = {route: insert.ecg_events(kept, route).count() / 2 for route in C.ECG_ROUTES}
    assert per == {"no_ecg": 0, "fusion_class": 3, "all_branches": 6}
    log = insert.full_log(extract.base_events(mini), mini["hospitalization"], ecg=insert.ecg_events(kept))
    assert codes(log, "H001")[0] == "ECG//Class/NSR"  # before admission, so before all else


def test_tokens_round_trip(log, mini):
    edges = tokens.train_edges(log, 5)
    vocab = tokens.vocabulary(log, edges, 5)
    names = [r["token"] for r in vocab.orderBy("id").collect()]
    assert names[:6] == C.SPECIAL_TOKENS and names[6:-5] == sorted(names[6:-5]) and names[-5:] == [f"Q_{i}" for i in range(5)]
    rows = tokens.encoded_rows(log, vocab, edges)
    seqs = {r["hospitalization_id"]: r for r in tokens.sequences(rows).collect()}
    one = seqs["H001"]
    assert one["token_ids"][0] == 2 and one["token_ids"][-1] == 3 and len(one["timestamps_us"]) == one["token_count"]
    assert one["timestamps_us"] == sorted(one["timestamps_us"])
    assert tokens.decode(rows, vocab).where("token = '[UNK]'").count() == 0


def test_split(spark):
    rows = [(f"p{i:03d}", f"h{i}", datetime(2020, 1, 1) + timedelta(hours=7 * (i * 37 % 100))) for i in range(100)]
    stays = spark.createDataFrame(rows, "patient_id string, hospitalization_id string, admission_dttm timestamp_ntz")
    found = split.patient_split(stays)
    got = {r["split"]: r["count"] for r in found.groupBy("split").count().collect()}
    assert got == {"train": 77, "val": 10, "test": 13}
    order = [r["split"] for r in found.orderBy("first_admit").collect()]
    assert order == ["train"] * 77 + ["val"] * 10 + ["test"] * 13
    assert split.sample_patients(found, 20).count() == 20


def test_route_filter_arrays(spark):
    seqs = spark.createDataFrame([("a", [1, 2, 3, 2], [10, 20, 30, 40])], "hospitalization_id string, token_ids array<int>, timestamps_us array<bigint>")
    got = dataset.filter_arrays(seqs, [2]).first()
    assert got["token_ids"] == [1, 3] and got["timestamps_us"] == [10, 30] and got["token_count"] == 2
