import json

import pytest
from pyspark.sql import functions as F

from quire.sources import journal
from quire.streaming.journal import compact, journal_stream, keep_latest, latest_rows


def test_torn_and_broken_lines():
    read = lambda b: [(n, s) for n, s, _ in journal.journal_lines(b)]
    assert read(b'\xef\xbb\xbf{"a":1}\n\n{"a":2}') == [(1, "ok"), (3, "ok")]
    assert read(b'{"a":1}\n{"a"') == [(1, "ok"), (2, "torn")]
    assert read(b'{"a":1}\n{"a"\n') == [(1, "ok"), (2, "broken")]
    assert read(b'{"a"\n{"a":1}\n') == [(1, "broken"), (2, "ok")]
    assert read(b"\xff\n") == [(1, "broken")] and read(b"") == []


def test_journal_round_trip(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"id":"x","n":1}\n{"id":"x","n":2}\n{"id":')
    got = journal.read_journal(spark, f"file://{tmp_path}/*.jsonl", "id string, n int").collect()
    assert [(r["n"], r["_line_no"]) for r in got] == [(1, 1), (2, 2)]
    assert journal.read_journal(spark, f"file://{tmp_path}/none*", "id string").count() == 0
    (tmp_path / "a.jsonl").write_bytes(b'{"id":\n{"id":"x"}\n')
    with pytest.raises(Exception, match="line 1"):
        journal.read_journal(spark, f"file://{tmp_path}/*.jsonl", "id string").collect()


def test_snapshot_survives_failure(spark, tmp_path):
    path = f"file://{tmp_path}/snap"
    journal.write_snapshot(spark.createDataFrame([(1, None)], "a int, b string"), path)
    with pytest.raises(Exception):
        journal.write_snapshot(spark.createDataFrame([(float("nan"),)], "a double"), path)
    rows = journal.read_snapshot(spark, path, "a int, b string").collect()
    assert [tuple(r) for r in rows] == [(1, None)]
    journal.write_snapshot(spark.createDataFrame([(2, "x")], "a int, b string"), path)
    journal.append(spark.createDataFrame([(3, "y")], "a int, b string"), path)
    assert sorted(r["a"] for r in journal.read_snapshot(spark, path, "a int, b string").collect()) == [2, 3]


def test_lists_and_guards(spark, tmp_path):
    (tmp_path / "l.txt").write_text('a.png\t"quoted\nb.png\n\nc.png\t \nd.png\tx\ty\n')
    got = {r["image"]: (r["text"], r["bad"] is None) for r in journal.read_labels(spark, f"file://{tmp_path}/l.txt").collect()}
    assert got == {"a.png": ('"quoted', True), "b.png": (None, False), "c.png": (None, False), "d.png": (None, False)}
    out = f"file://{tmp_path}/data"
    journal.guarded_output(spark, out, "f1")
    journal.guarded_output(spark, out, "f1")
    with pytest.raises(FileExistsError):
        journal.guarded_output(spark, out, "f2")
    (tmp_path / "w.txt").write_text("The 10\nbad line here\ncat 2\n")
    assert {(r["word"], r["count"]) for r in journal.read_lexicon(spark, f"file://{tmp_path}/w.txt").collect()} == {("the", 10), ("cat", 2)}
    (tmp_path / "t.json").write_text(json.dumps([{"a": 1}]))
    assert journal.read_training(spark, f"file://{tmp_path}/t.json", "a int").count() == 1


def test_stream_keeps_latest(spark, tmp_path):
    src, store, check = (f"file://{tmp_path}/{n}" for n in ("src", "store", "check"))
    schema = spark.createDataFrame([("a", 1, "error")], "id string, at int, status string")
    schema.write.parquet(src)
    keep_latest(journal_stream(spark, src, schema.schema), ["id"], ["at"], store, check).awaitTermination()
    spark.createDataFrame([("a", 2, "ok"), ("b", 1, "ok")], schema.schema).write.mode("append").parquet(src)
    keep_latest(journal_stream(spark, src, schema.schema), ["id"], ["at"], store, check).awaitTermination()
    assert sorted(tuple(r) for r in latest_rows(spark, store, ["id"], ["at"]).select("id", "at").collect()) == [("a", 2), ("b", 1)]
    # merged into a base, also twice, the store reads the same and holds one piece
    for _ in range(2):
        compact(spark, store, ["id"], ["at"], 1)
        assert sorted(tuple(r) for r in latest_rows(spark, store, ["id"], ["at"]).select("id", "at").collect()) == [("a", 2), ("b", 1)]
    spark.createDataFrame([("b", 5, "ok")], schema.schema).write.mode("append").parquet(src)
    keep_latest(journal_stream(spark, src, schema.schema), ["id"], ["at"], store, check, compact_every=1).awaitTermination()
    assert sorted(tuple(r) for r in latest_rows(spark, store, ["id"], ["at"]).select("id", "at").collect()) == [("a", 2), ("b", 5)]
    pieces = list((tmp_path / "store").iterdir()) if (tmp_path / "store").exists() else [None]
    assert len(pieces) == 1 and latest_rows(spark, f"file://{tmp_path}/nowhere", ["id"], ["at"]) is None


def test_no_endless_number_is_written_however_deep(spark, tmp_path):
    bad = {
        "a array<double>": ([1.0, float("inf")],), "m map<string,struct<x:array<float>>>": ({"k": ([float("nan")],)},), "s struct<d:double,t:string>": ((float("-inf"), "x"),),
    }
    for i, (kind, row) in enumerate(bad.items()):
        with pytest.raises(Exception, match="finite"):
            journal.write_snapshot(spark.createDataFrame([row], kind), f"file://{tmp_path}/n{i}")
    fine = spark.createDataFrame([([1.0, None], None, (None, "x"))], "a array<double>, m map<string,double>, s struct<d:double,t:string>")
    journal.write_snapshot(fine, f"file://{tmp_path}/fine")
    assert spark.read.json(f"file://{tmp_path}/fine").count() == 1


def test_labels_and_evidence_round_trip(spark, tmp_path):
    labels = spark.createDataFrame([("a.png", 'say "hi"'), ("b.png", "two words")], "image string, text string")
    journal.write_labels(labels, f"file://{tmp_path}/labels")
    assert sorted(map(tuple, journal.read_labels(spark, f"file://{tmp_path}/labels").select("image", "text").collect())) == sorted(map(tuple, labels.collect()))
    for row in (("a", "x\ty"), ("a", " "), (None, "x"), ("a", None)):
        with pytest.raises(Exception, match="no label"):
            journal.write_labels(spark.createDataFrame([row], "image string, text string"), f"file://{tmp_path}/bad")
    kind = "line_id string, source string, probs array<array<double>>, alphabet array<string>, blank_id int, excluded_mass array<double>"
    good = [("l", "rec:out", [[0.5, 0.5], [0.9, 0.1]], ["", "a"], 0, [0.0, 0.0])]
    journal.write_evidence(spark.createDataFrame(good, kind), f"file://{tmp_path}/evidence")
    with pytest.raises(ValueError, match="range"):
        journal.write_evidence(spark.createDataFrame([("l", "s", [[1.5, -0.5]], ["", "a"], 0, None)], kind), f"file://{tmp_path}/evidence")
    assert journal.read_evidence(spark, f"file://{tmp_path}/evidence").count() == 1


def test_model_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.bin").write_bytes(b"1")
    (tmp_path / "m" / "b.bin").write_bytes(b"22")
    stamp = journal.model_stamp(spark, f"file://{tmp_path}/m").collect()
    assert sorted(r["length"] for r in stamp) == [1, 2]
    before = journal.adapter_signature(spark, f"file://{tmp_path}/m")
    assert before == journal.adapter_signature(spark, f"file://{tmp_path}/m")
    (tmp_path / "m" / "b.bin").write_bytes(b"23")
    assert journal.adapter_signature(spark, f"file://{tmp_path}/m") != before
