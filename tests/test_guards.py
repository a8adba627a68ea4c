from pyspark.sql import functions as F

from quire.operators import guards as g
from quire.operators.resume import fingerprint_of


def rules(df):
    return {(r["rule"], r["key"]) for r in df.collect()}


def test_paths(spark):
    df = spark.createDataFrame([("/a/b",), ("b\\c",), ("/data/x/y",), (None,)], "p string")
    got = df.select(g.resolved(F.col("p"), "/data/").alias("r"), g.relative(F.col("p"), "/data").alias("l")).collect()
    assert [tuple(r) for r in got] == [("/a/b", "/a/b"), ("/data/b\\c", "b/c"), ("/data/x/y", "x/y"), (None, None)]
    assert rules(g.missing_files(df.withColumnRenamed("p", "path"), spark.createDataFrame([("/a/b",)], "path string"))) == {("missing_file", "b\\c"), ("missing_file", "/data/x/y")}


def test_evidence(spark):
    samples = spark.createDataFrame([("1_1", "1", "h"), ("1_2", "1", "k"), ("1_3", "1", "m")], "id string, document_id string, out_sha256 string")
    schema = "id string, document_id string, status string, schema_version int, out_sha256 string, page_size array<int>, alphabet string, lines array<struct<line_id:string,order:int,box:array<int>>>"
    good = [("l1", 0, [0, 0, 5, 5]), ("l2", 1, [0, 5, 5, 9])]
    pages = [("1_1", "1", "ok", 3, "h", [10, 10], "abc", good), ("1_2", "2", "error", 3, "x", [10, 10], "ab", [("l2", 0, [0, 0, 50, 5]), ("l4", 0, [0, 0, 5, 5])])]
    got = rules(g.evidence_guards(samples, spark.createDataFrame(pages, schema), "cba"))
    assert got == {("unmatched", "1_3"), ("page_not_read", "1_2"), ("other_document", "1_2"), ("other_image", "1_2"), ("other_alphabet", "1_2"), ("repeated_order", "1_2"), ("box_outside", "1_2"), ("unique:line_id", "l2")}


def test_detections_exports_roles(spark):
    cached = spark.createDataFrame([("f", 3, "h", "d", "s", "out", "new"), ("f", 1, "h", "d", "s", "out", "old"), ("e", 0, "h", "d", "s", "blur", "x"), ("c", 0, "z", "d", "s", "out", "x")], "fingerprint string, position int, image_sha256 string, detector string, settings string, view string, content string")
    got = g.compatible_detections(cached, spark.createDataFrame([("h", "d", "s")], "image_sha256 string, detector string, settings string")).collect()
    assert [(r["fingerprint"], r["position"], r["content"]) for r in got] == [("f", 1, "new")]
    assert g.export_guard({"a": 1}, fingerprint_of({"a": 1}), {"w": "1"}, {"w": "1"}) == []
    assert g.export_guard({"a": 2}, fingerprint_of({"a": 1}), {"w": "1"}, {"w": "2"}) == ["training_fingerprint", "file:w"]
    rows = spark.createDataFrame([("a", "train", "1"), ("b", "train", "2")], "id string, stage2_split string, out_sha256 string")
    assert rules(g.role_guard(rows, spark.createDataFrame([("a", "train", "1"), ("b", "validation", "3")], rows.schema))) == {("role_changed", "b"), ("image_changed", "b")}


def test_sets(spark):
    pages = spark.createDataFrame([("4_1", "4", "train"), ("14_1", "14", "evaluation"), ("5_1", "5", "train")], "id string, document_id string, role string")
    crops = spark.createDataFrame([("c/4_1_0.png", "train", "word", "h"), ("c/4_1_0.png", "train", "word", "h"), ("../9_1_0.png", "train", "é", "h"), ("c/14_1_0.png", "evaluation", "e" * 30, "h")], "image string, role string, text string, sha256 string")
    assert rules(g.dataset_guards(crops, pages)) == {
        ("empty_role", "validation"), ("adaptation_document", "5_1"), ("crop_without_page", "../9_1_0.png"), ("path", "../9_1_0.png"), ("unique:image", "c/4_1_0.png"),
        ("characters", "../9_1_0.png"), ("capacity", "c/14_1_0.png"), ("picture_in_one_role", "h"),
    }
    schema = "id string, document_id string, deblur_run string, split string, image array<string>, conversations array<struct<`from`:string,value:string>>"
    good = ("a", "7", "r", "train", ["/x", "/y"], [("human", "Say this"), ("gpt", "ok")])
    bad = ("b", "4", " ", None, ["x"], [("gpt", "no"), ("human", " ")])
    assert rules(g.training_guards(spark.createDataFrame([good, bad], schema), "Say")) == {(r, "b") for r in ("split", "held_out", "run", "images", "turns", "prompt", "answer")}
    ref = spark.createDataFrame([("a", True, True, 0, "1", "1", "p", "p", "g", "g", "s", "s"), ("b", None, False, 3, "1", "2", "p", "q", "g", "h", "s", None)], "id string, exact_render boolean, body_preserved boolean, pixels_changed_outside int, crop_box string, reference_crop_box string, pdf_sha256 string, reference_pdf_sha256 string, gt_sha256 string, reference_gt_sha256 string, page_size string, reference_page_size string")
    assert {k for _, k in rules(g.reference_guards(ref))} == {"b"} and g.reference_guards(ref).count() == 7


def test_rendering_and_masks(spark):
    samples = spark.createDataFrame([("a", "x", "1"), ("b", "x", "2"), ("c", None, "3")], "id string, role string, out_sha256 string")
    schema = "id string, stage string, role string, out_sha256 string, status string, lines array<struct<line_id:string,text:string,status:string>>"
    records = spark.createDataFrame([("a", "recovery", "x", "1", "ok", [("l", "t", "ok")]), ("b", "ocr", "y", "0", "ok", [("l", " ", "ok")])], schema)
    assert rules(g.render_guards(samples, records)) == {("unmatched", "c"), ("one_stage", "all"), ("role", "b"), ("image", "b"), ("incomplete", "b")}
    masked = spark.createDataFrame([([5, 6, 7], 2)], "t array<int>, n int").select(g.supervised_mask(F.col("t"), F.col("n")).alias("m")).first()["m"]
    assert masked == [-100, -100, 7]
    assert g.stage_key({"a": 1}, {}, {}, {"id": "x"}) != g.stage_key({"a": 2}, {}, {}, {"id": "x"})


def test_labelled_pages(spark):
    from quire.operators import validate

    samples = spark.createDataFrame([("4_1", "4", "h", [512, 768]), ("9_1", "9", "h", [512, 768])], "id string, document_id string, out_sha256 string, page_size array<int>")
    good = [([1.0, 1.0, 50.0, 20.0], "a line", True)]
    kind = "id string, out_sha256 string, page_size array<int>, label_status string, provenance struct<method:string,source_sha256:string>, lines array<struct<box:array<double>,text:string,complete:boolean>>"
    rows = [
        ("4_1", "h", [512, 768], "human_checked", ("pdf", "0" * 64), good), ("9_1", "x", [1, 2], "new", (" ", "zz"), []), ("7_1", "h", None, None, None, None),
        ("4_1", "h", [512, 768], "geometry_checked", ("pdf", "a" * 64), [([1.0, 1.0, 50.0, 20.0], " a", None), ([1.0, 1.0, 900.0, 20.0], "b", True)]),
    ]
    df = spark.createDataFrame(rows, kind)
    assert validate.label_page_violations(df.limit(1), samples).count() == 0
    found = {(r["key"], r["rule"]) for r in validate.label_page_violations(df, samples).collect()}
    assert {("9_1", r) for r in ("document", "picture", "page_size", "label_status", "provenance", "lines")} <= found
    assert {("7_1", r) for r in ("unknown_page", "label_status", "provenance", "lines")} <= found and ("7_1", "picture") not in found
    assert {("4_1", "complete"), ("4_1", "text"), ("4_1", "box")} <= found and not {("4_1", "picture"), ("4_1", "provenance")} & found


def test_totals_and_sources(spark):
    from quire.operators import guards

    crops = spark.createDataFrame([("train", "abc", 40, 10), ("train", "abcd", 20, 10), ("validation", "x", 10, 10)], "role string, text string, width int, height int")
    assert guards.total_guards(crops, {"train": 2, "validation": 1}, 4, 4.0).count() == 0
    found = {r["rule"] for r in guards.total_guards(crops, {"train": 1, "evaluation": 3}, 5, 2.0).collect()}
    assert found == {"count", "max_text_length", "max_aspect_ratio"} and guards.total_guards(crops.limit(0), {}, 0, 0.0).count() == 0
    kind = "id string, document_id string, deblur_run string, split string, image array<string>, conversations array<struct<from:string,value:string>>, prompt string, source_hashes map<string,string>, known_hashes map<string,string>"
    turns = [("human", "Read: a"), ("gpt", "a")]
    rows = [("1", "9", "r", "train", ["/a", "/b"], turns, "Read: a", {"out": "1", "blur": "2"}, {"blur": "2", "out": "1"}), ("2", "8", "r", "train", ["/a", "/b"], turns, "Read: b", {"out": "1"}, None)]
    got = {(r["key"], r["rule"]) for r in guards.training_guards(spark.createDataFrame(rows, kind), "Read").collect()}
    assert got == {("2", "whole_prompt"), ("2", "sources")}
