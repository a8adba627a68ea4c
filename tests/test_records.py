import pytest
from pyspark.sql import functions as F

from quire.operators import assemble, partition, resume, validate


def test_latest_takes_failures_and_whole_rows(spark):
    df = spark.createDataFrame([("a", 1, "ok"), ("a", 2, "error"), ("b", 1, "review"), (None, 1, "ok")], "id string, at int, status string")
    got = {r["id"]: r["status"] for r in resume.latest(df, ["id"], [F.col("at")]).collect()}
    assert got == {"a": "error", "b": "review", None: "ok"}
    assert [r["id"] for r in resume.reusable(df, ["id"], [F.col("at")], ("ok", "review")).filter("id is not null").collect()] == ["b"]
    jobs = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    done = resume.reusable(df, ["id"], [F.col("at")], ("ok", "review"))
    assert sorted(r[0] for r in resume.pending(jobs, done, ["id"]).collect()) == ["a", "c"]


def test_fingerprint_is_canonical(spark):
    assert resume.canonical_json({"b": None, "a": "é"}) == '{"a":"é","b":null}'
    df = spark.createDataFrame([(1, None, {"k": "v"})], "x int, y string, m map<string,string>")
    got = df.select(resume.fingerprint(F.col("x"), F.col("y"), F.col("m")).alias("f")).first()["f"]
    assert got == resume.fingerprint_of({"x": 1, "y": None, "m": {"k": "v"}})
    with pytest.raises(ValueError):
        resume.canonical_json(float("nan"))


def test_cache_needs_every_asset(spark):
    pages = spark.createDataFrame([("a", "ocr", 3, "ok", {"p": "1"}), ("b", "ocr", 3, "ok", {"p": "1", "q": "2"}), ("c", "ocr", 3, "error", {"p": "1"})], "id string, stage string, schema_version int, status string, assets map<string,string>")
    assets = spark.createDataFrame([("p", "1"), ("q", "x")], "path string, sha256 string")
    assert [r[0] for r in resume.cache_valid(pages, assets).collect()] == ["a"]


def test_final_block_sizes(spark):
    pages = spark.createDataFrame([("x", i) for i in range(74)] + [("y", 1), ("z", 1), ("z", 2)], "d string, p int")
    got = {(r[0], r[2]): r[1] for r in partition.final_block(pages, "d", "p").groupBy("d", "role").count().select("d", "count", "role").collect()}
    assert got == {("x", "validation"): 15, ("x", "train"): 59, ("y", "train"): 1, ("z", "validation"): 1, ("z", "train"): 1}


def test_rules_name_the_first_violation(spark):
    rows = [("1_1", "1", "train", "run", None, "o"), ("1_1", "1", "test", "run", "odd", "o"), ("2_1", " ", "nowhere", "run", None, "o"), ("4_1", "4", "train", "run", None, None)]
    df = spark.createDataFrame(rows, "id string, document_id string, split string, deblur_run string, stage2_split string, out string")
    found = validate.manifest_violations(df, ["out"])
    rules = {r["rule"] for r in found.collect()}
    assert rules == {"required:document_id", "required:out", "unique:id", "domain:split", "held_out", "document_in_one_split", "domain:stage2_split"}
    with pytest.raises(validate.Violated, match="required"):
        validate.enforce(found)
    validate.enforce(found.limit(0))
    with pytest.raises(ValueError):
        validate.check_views([])


def test_label_lines(spark):
    size = [100, 100]
    rows = [("ok", "word", True, [1.0, 1.0, 20.0, 9.0], size), ("dup", "word", True, [1.2, 1.0, 19.5, 8.5], size), ("open", "word", None, [1.0, 20.0, 20.0, 29.0], size), ("bad", "wörd", True, None, size), ("long", "e" * 21, True, [1.0, 40.0, 20.0, 49.0], size), ("thin", "a", True, [3.0, 50.0, 4.0, 60.0], size)]
    df = spark.createDataFrame(rows, "id string, text string, complete boolean, box array<double>, page_size array<int>")
    got = {(r["rule"], r["key"]) for r in validate.label_line_violations(df).collect()}
    assert got == {("complete", "open"), ("text", "bad"), ("box", "bad"), ("capacity", "long"), ("box_size", "thin")}


def test_evidence_rules(spark):
    schema = "line_id string, probs array<array<double>>, alphabet array<string>, blank_id int, excluded_mass array<double>"
    rows = [("good", [[0.5, 0.4]], ["", "a"], 0, [0.1]), ("mass", [[0.9, 0.4]], ["", "a"], 0, None), ("shape", [[1.0]], ["", "a"], 0, None), ("blank", [[0.5, 0.5]], ["a", ""], 0, None), ("short", [[0.5, 0.4]], ["", "a"], 0, [0.2])]
    got = {(r["rule"], r["key"]) for r in validate.evidence_violations(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("mass", "mass"), ("shape", "shape"), ("blank", "blank"), ("alphabet", "blank"), ("excluded", "short")}


def test_assembly(spark):
    df = spark.createDataFrame([("p", 2, 0, "b", "ok"), ("p", 0, 0, "a", "ok"), ("p", 1, 1, None, "review"), ("q", 0, 0, "x", "strange")], "id string, o int, c int, t string, s string")
    assert {r["id"]: r["text"] for r in assemble.ordered_text(df, ["id"], ["o"], "t", "\n", "[unread block]").collect()} == {"p": "a\n[unread block]\nb", "q": "x"}
    assert {r["id"]: r["status"] for r in assemble.status_rollup(df, ["id"], "s").collect()} == {"p": "review", "q": "pending"}
    near = {(r["id"], r["o"]): r["context"] for r in assemble.context(df, "id", "o", "c", "t", 1).collect()}
    assert near[("p", 0)] == [] and near[("q", 0)] == []
    lifted = assemble.status_rollup(df.filter("id='p' and s='ok'"), ["id"], "s", F.bool_or(F.lit(True))).first()["status"]
    assert lifted == "review"


def test_limits_fingerprints_and_runs(spark):
    from pyspark.sql import functions as F

    from quire.operators import resume, validate

    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 1), (None, 3)], "k string, n int")
    assert [tuple(r) for r in resume.first_rows(df, 2, [F.col("k").asc_nulls_last(), F.col("n")]).collect()] == [("a", 1), ("a", 2)]
    for bad in (0, -1, True, 1.0):
        try:
            resume.first_rows(df, bad, [F.col("n")])
        except ValueError:
            continue
        raise AssertionError(bad)
    prints = {r["k"]: (r["members"], r["fingerprint"]) for r in resume.set_fingerprint(df.union(df), ["k"], F.col("n")).collect()}
    assert prints == {r["k"]: (r["members"], r["fingerprint"]) for r in resume.set_fingerprint(df.orderBy("n"), ["k"], F.col("n")).collect()}
    assert prints["a"][0] == 2 and len({v for _, v in prints.values()}) == 3
    keys = df.select(resume.line_key(*[F.col("k")] * 9).alias("a"), resume.block_key(*[F.col("n")] * 5).alias("b")).distinct().collect()
    assert len(keys) == 4 and all(len(r["a"]) == len(r["b"]) == 64 for r in keys)
    kind = "id string, document_id string, deblur_run string, split string, stage2_split string, out string"
    two_runs = spark.createDataFrame([("1", "9", "r1", "train", None, "o"), ("2", "8", "r2", "test", "odd", " ")], kind)
    found = {(r["rank"], r["rule"]) for r in validate.manifest_violations(two_runs, ["out"]).collect()}
    assert found == {(10, "required:out"), (60, "domain:stage2_split"), (70, "one_run")}


def test_names_with_control_characters(spark):
    import hashlib
    import json

    from pyspark.sql import functions as F

    from quire.functions import names

    ids = ["a\tb", 'q"\\\n', "\x01\x1f", "CON", "fine-1"]
    got = {r["n"]: r["f"] for r in spark.createDataFrame([(i,) for i in ids], "n string").select("n", names.safe_filename(F.col("n")).alias("f")).collect()}
    for i in ids[:-1]:
        assert got[i] == "sample-" + hashlib.sha256(json.dumps(i).encode()).hexdigest()[:16]
    assert got["fine-1"] == "fine-1"
