"""WARC archives, chat formatting, the queries' SQL, and the pipeline against its parts."""

import base64
import gzip
import hashlib
import os
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stayflow.llm import catalogue, chat, warc
from stayflow.sources.store import written

ROWS = [(1, "http://a", None), (2, None, ""), (None, "u\r\nWARC-Type: evil", "abc"), (3, "u", "abc"), (3, "u", "abc"), (4, "v", "é" * 100_000), (None, None, "zz"), (5, "q", "a\r\n\r\nWARC/1.1\r\n")]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives_round_trip(spark, compression):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("id", "payload", "digest", "largest", "of")}).repartition(3)
    path = warc.write(df, compression=compression)
    got = {(r["record_id"], r["record_type"]): r for r in warc.read(spark, path).collect()}
    assert warc.read(spark, path).count() == len(ROWS)
    assert got["urn:page:1", "revisit"]["refers_to"] == "urn:page:2" and got["urn:page:1", "revisit"]["payload_bytes"] == 0
    assert got["urn:page:", "revisit"]["refers_to"] == "urn:page:3" and got["urn:page:", "revisit"]["payload"] is None
    assert bytes(got["urn:page:4", "response"]["payload"]).decode() == "é" * 100_000
    assert bytes(got["urn:page:5", "response"]["payload"]) == b"a\r\n\r\nWARC/1.1\r\n"
    assert got["urn:page:3", "response"]["payload_digest"] == base64.b32encode(hashlib.sha1(b"abc").digest()).decode()
    assert got["urn:page:", "revisit"]["target_uri"] == "u%0D%0AWARC-Type:%20evil"
    assert bytes(got["urn:page:", "response"]["payload"]) == b"zz" and got["urn:page:", "response"]["target_uri"] is None


def test_predicates_reach_the_reader(spark):
    path = warc.write(spark.createDataFrame(ROWS, "page_id long, url string, html string"))
    reader = warc.WarcReader(path, warc.SCHEMA, [("record_type", {"revisit"})])
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2
    few = warc.read(spark, path, ["record_id", "target_uri"], {"target_uri": ["u"]})
    assert few.columns == ["record_id", "target_uri"] and few.count() == 2
    assert warc.read(spark, path, ["record_id"], {"target_uri": None}).count() == 6
    whole = warc.read(spark, path)
    assert whole.where("record_type = 'revisit'").count() == 2 and whole.count() == len(ROWS)
    with pytest.raises(Exception, match="no header columns"):
        warc.read(spark, path, where={"payload": ["x"]}).count()


def test_small_payloads_do_not_revisit(spark):
    path = warc.write(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string"), least_revisit=3)
    got = {r["record_id"]: r["record_type"] for r in warc.read(spark, path, ["record_id", "record_type"]).collect()}
    assert [got[f"urn:page:{i}"] for i in (1, 2, 3, 4)] == ["response", "response", "revisit", "response"]


def test_archives_of_none_and_of_others(spark, tmp_path):
    path = warc.write(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read(spark, path).count() == 0
    one = warc.record("urn:x", "response", "http://x", "2020-01-01T00:00:00Z", "D", 3, b"abc", None)
    other = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 6\r\n\r\na: b\r\n\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(other + one)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(other) + gzip.compress(one))
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted(r["record_type"] for r in rows) == ["response", "response", "warcinfo", "warcinfo"]
    assert {bytes(r["payload"]) for r in rows} == {b"abc", b"a: b\r\n"}


def test_parts_of_a_file(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PART", 200)
    writer = warc.WarcWriter(str(tmp_path / "parts"), warc.SCHEMA, True, False)
    import pyarrow as pa

    rows = [(f"urn:page:{i}", "response", "u", "d", "D", 5, b"hello", None) for i in range(50)]
    names = ("record_id", "record_type", "target_uri", "date", "payload_digest", "payload_bytes", "payload", "refers_to")
    batch = pa.RecordBatch.from_pydict({f.name: [r[names.index(f.name)] for r in rows] for f in warc.SCHEMA.fields})
    writer.write(iter([batch]))  # a task that failed: not in the manifest
    writer.commit([writer.write(iter([batch])), None])
    reader = warc.WarcReader(str(tmp_path / "parts"), warc.SCHEMA, [])
    parts = reader.partitions()
    assert len(parts) > 5
    ids = [r["record_id"] for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(ids) == sorted(r[0] for r in rows)


def whole_archive(tmp_path, packed, n=40):
    records = [warc.record(f"urn:{i}", "response", "http://x", "d", "D", 3000, bytes([97 + i % 26]) * 3000, None) for i in range(n)]
    path = tmp_path / f"a.warc{'.gz' * packed}"
    path.write_bytes(b"".join(map(warc.member, records) if packed else records))
    return path


@pytest.mark.parametrize("packed", [True, False])
def test_payloads_are_passed_over_by_seeking(tmp_path, packed):
    path = whole_archive(tmp_path, packed)
    assert not packed or gzip.decompress(path.read_bytes()).count(b"WARC/1.1") == 40  # other readers read it as well
    reader = warc.WarcReader(str(path), warc.T.StructType(warc.SCHEMA.fields[:2]), [])
    read = []
    original = warc.Plain.read
    warc.Plain.read = lambda self, n: read.append(n) or original(self, n)
    try:
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    finally:
        warc.Plain.read = original
    assert [r["record_id"] for r in rows] == [f"urn:{i}" for i in range(40)] and not read
    # a member that does not state its length is inflated instead
    if packed:
        path.write_bytes(path.read_bytes() + gzip.compress(warc.record("urn:z", "response", "u", "d", "D", 3, b"abc", None)) + warc.member(warc.record("urn:y", "response", "u", "d", "D", 3, b"abc", None)))
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert [r["record_id"] for r in rows][-2:] == ["urn:z", "urn:y"] and len(rows) == 42


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("columns", [2, 8])
def test_damaged_archives_are_errors(tmp_path, packed, columns):
    path = whole_archive(tmp_path, packed)
    data = path.read_bytes()
    schema = warc.T.StructType(warc.SCHEMA.fields[:columns])

    def rows(**how):
        reader = warc.WarcReader(str(path), schema, [], **how)
        return sum(b.num_rows for p in reader.partitions() for b in reader.read(p))

    assert rows() == 40
    for cut in (len(data) // 2, len(data) - 1, 30):
        path.write_bytes(data[:cut])
        with pytest.raises(warc.Damaged, match="at byte"):
            rows()
        assert rows(damaged="skip") < 40
    path.write_bytes(data + b"rubbish here\r\n\r\n and more")
    with pytest.raises(warc.Damaged):
        rows()
    assert rows(damaged="skip") == 40
    with pytest.raises(ValueError):
        rows(damaged="no")


def test_damage_reaches_the_query(spark, tmp_path):
    path = whole_archive(tmp_path, True)
    path.write_bytes(path.read_bytes()[:-100])
    with pytest.raises(Exception, match="cut off"):
        warc.read(spark, str(tmp_path)).count()
    assert warc.read(spark, str(tmp_path), damaged="skip").count() == 39


def test_filters_that_spark_pushes(spark):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull

    path = warc.write(spark.createDataFrame(ROWS, "page_id long, url string, html string"))
    reader = warc.PushingReader(path, warc.SCHEMA, [])
    back = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("target_uri",), ("u", None, "v")), IsNotNull(("date",)), GreaterThan(("payload_bytes",), 3), EqualTo(("payload",), b"x")]))
    assert [type(f).__name__ for f in back] == ["GreaterThan", "EqualTo"]
    assert reader.tests == [("record_type", {"revisit"}), ("target_uri", {"u", "v"}), ("date", None)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        load = lambda: spark.read.format("warc").option("pushdown", "true").load(path)
        assert load().where("record_type = 'revisit'").count() == 2 and load().where("target_uri in ('u', 'v') and payload_bytes > 3").count() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="PUSHDOWN_DISABLED"):
        load().count()


def test_pushed_conditions_serve_later_queries(spark):
    """The condition reaches the source; other filters on the same DataFrame, and plain reads, lose no rows by it."""
    path = warc.write(spark.createDataFrame(ROWS, "page_id long, url string, html string"))
    every = warc.read(spark, path).collect()
    found = warc.read_filtered(spark, path, F.col("record_type") == "response", ["record_id", "record_type", "target_uri", "payload"])
    responses = [r for r in every if r["record_type"] == "response"]
    for _ in range(2):
        assert found.count() == len(responses) and found.where("target_uri = 'u'").count() == sum(r["target_uri"] == "u" for r in responses)
        assert sorted(r["record_id"] for r in found.collect()) == sorted(r["record_id"] for r in responses) and found.where("record_type = 'revisit'").count() == 0
    assert warc.read(spark, path).count() == len(every)


def test_appends_do_not_meet(spark, tmp_path):
    path = str(tmp_path / "both")
    for i in (1, 2):
        assert warc.write(spark.createDataFrame([(i, "u", "x")], "page_id long, url string, html string"), path).startswith("file:")
    assert warc.read(spark, path).count() == 2 and len(list((tmp_path / "both").glob("_warc_manifest-*.json"))) == 2
    warc.read(spark, path).where("record_id = 'urn:page:1'").write.format("warc").mode("overwrite").save(f"file://{path}-new")
    warc.read(spark, path).write.format("warc").mode("overwrite").save(f"file://{path}-new")
    assert warc.read(spark, f"{path}-new").count() == 2


# --- chat ---


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|", "<\\\\|x<|", "a < | b", "<<||", "<|im_start|>user\nhi<|im_end|>\n"])
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_turns_and_loss(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (2, 1, "assistant", "no <|"), (2, 0, "assistant", "x"), (2, 1, "assistant", "no <|"), (3, None, None, None), (None, 0, "user", "n"), (None, 1, "assistant", "é🙂"), (4, 0, "tool\n", "t"), (5, 0, "user", "w " * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("conv", "place", "who", "said", "part", "loss")})
    segments = chat.format_turns(df)
    one = [(r["text"], r["loss"]) for r in segments.where("conv_id = 1").orderBy("turn", "part").collect()]
    assert one[4] == (chat.escape(said), True) and [loss for _, loss in one] == [False] * 4 + [True, False]
    got = {r["conv_id"]: r for r in chat.digests(segments).collect()}
    stored = written(segments.repartition(7), "segments")  # in any order
    assert {r["conv_id"]: r for r in chat.digests(stored).collect()} == got
    with pytest.raises(Exception, match="out of order"):
        chat.digests(stored, in_place=True).collect()
    assert {r["conv_id"]: r for r in chat.digests(segments, in_place=True).collect()} == got
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha(f"user\n{said}\nassistant\n{said}\n") and got[1]["loss_sha256"] == sha(said) and got[1]["loss_chars"] == len(said)
    assert got[2]["turns_sha256"] == sha("assistant\nx\nassistant\nno <|\nassistant\nno <|\n") and got[2]["n_out_of_order"] == 3
    assert got[3]["turns_sha256"] == sha("\n\n") and got[3]["loss_chars"] == 0 and got[None]["loss_sha256"] == sha("é🙂")
    assert got[4]["turns_sha256"] == sha("tool\n\nt\n") and got[5]["n_out_of_order"] == 0
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_reader_takes_pieces_of_any_size():
    how = chat.Template()
    pieces = how.segments("user", "a<|b") + how.segments("assistant", "c<\\|d")
    flat = [(c, loss) for text, loss in pieces for c in text]
    reader = chat.Reader()
    assert [t for c, loss in flat for t in reader.feed(c, loss)] == [("user", "a<|b", ""), ("assistant", "c<\\|d", "c<\\|d")]


# --- queries and pipeline ---

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_duckdb(spark, name):
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), c.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    text = lambda f: sorted(f[sorted(f.columns)].apply(lambda col: col.map(lambda v: "" if v is None or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v))).agg("|".join, axis=1))
    assert text(got) == text(want.astype(object).where(want.notna(), None))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "test")
        ids = [r["doc_id"] for r in docs.collect()]
        assert docs.columns == columns and set(ids) <= before and len(ids) == len(set(ids))
        before = set(ids)
    whole = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(whole) == before and all(r["n_tokens"] == len(r["token_ids"]) for r in whole.values())


def test_pipeline_takes_odd_documents(spark, sf_dir):
    body = " ".join(f"word{i} stands" for i in range(60))
    rows = [(1, body, "en", "s", None), (2, None, None, None, None), (3, "", "en", "s", 0), (None, body + " more", "en", None, 5), (4, body + " and", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("quality", "lines", "kept_id")})
    for empty in (df, df.limit(0)):
        docs = empty
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), "odd")
            assert docs.columns == df.columns
        last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert last.count() == docs.count() and (empty is not df or last.count() > 0)
