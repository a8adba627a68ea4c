import json

import pytest
from pyspark.sql import functions as F

from quire.operators import candidates as c
from quire.operators import selection as sel
from quire.sources.backends import FirstChoice

LETTERS = ["", *"abcdefghijklmnopqrstuvwxyz ."]


def soft(text):
    out = []
    for i in range(2 * len(text) + 1):
        row = [0.2 / len(LETTERS)] * len(LETTERS)
        row[LETTERS.index(text[i // 2]) if i % 2 else 0] += 0.8
        out.append(row)
    return out


SOURCE = "array<struct<name:string,view:string,text:string,probs:array<array<double>>,letters:array<string>,blank:int>>"


@pytest.fixture(scope="module")
def planned(spark):
    rows = [(1, [("rec", "out", "the cat", soft("the cat"), LETTERS, 0), ("rec", "blur", "the car", soft("the car"), LETTERS, 0)]), (2, [("rec", "out", "a b", None, None, None)]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, f"k int, sources {SOURCE}")
    return df.withColumn("plan", c.plans(F.col("sources"))).withColumn("context", F.lit(None).cast("array<string>"))


def test_plans_carry_evidence(planned):
    got = {r["k"]: r["plan"] for r in planned.collect()}
    span = got[1]["spans"][1]
    by = {x["text"]: x for x in span["candidates"]}
    assert by["car"]["origin"] == "rec:blur" and by["car"]["visual_support"] and by["car"]["scores"].keys() == {"rec:out", "rec:blur"}
    assert by["cat"]["scores"]["rec:out"] > by["car"]["scores"]["rec:out"] and by["cat"]["scores"]["rec:blur"] < by["car"]["scores"]["rec:blur"]
    assert any(x["origin"].startswith("ctc_beam:") for s in got[1]["spans"] for x in s["candidates"])
    # without evidence nothing is shown; without sources there is an error and no span
    assert not any(x["visual_support"] for s in got[2]["spans"] for x in s["candidates"])
    assert got[3]["error"] and got[4]["error"] and got[3]["spans"] == got[4]["spans"] == []


def test_columns_agree_with_one_line(spark, planned):
    reply = json.dumps({"choices": [{"span_id": "s0", "candidate_id": "c0"}, {"span_id": "s1", "candidate_id": "c1"}], "proposals": [{"span_id": "s1", "text": "can"}, {"span_id": "s0", "text": " x"}]})
    df = planned.filter("k < 3").withColumn("r", sel.replies(F.lit(reply), F.col("plan"))).withColumn("a", sel.applied(F.col("plan"), F.col("r.choices"))).withColumn("m", sel.admitted(F.col("plan"), F.col("r.proposals"), F.col("sources")))
    got = {r["k"]: r for r in df.collect()}
    assert got[1]["r"]["ok"] and got[1]["a"]["text"] == "the car" and got[1]["r"]["proposals"] == {"s1": "can", "s0": " x"}
    assert [x["reason"] for x in got[1]["m"]["rejected"]] == ["blank_or_padded"] and len(got[1]["m"]["accepted"]) == 1
    added = got[1]["m"]["plan"]["spans"][1]["candidates"][-1]
    assert (added["text"], added["origin"]) == ("can", "qwen_proposal") and added["id"] == got[1]["m"]["accepted"][0]["candidate_id"]
    # the second line has no evidence: its alternative isn't offered
    assert not got[2]["r"]["ok"]
    shown = json.loads(planned.filter("k = 1").select(sel.offers(F.col("plan"))).first()[0])
    assert shown.keys() == {"base_text", "spans"} and all(x.keys() == {"id", "text", "origin", "edit_cost", "scores"} for s in shown["spans"] for x in s["candidates"])
    scores = planned.select("k", sel.final_scores(F.lit("the cat"), F.col("sources")).alias("s")).collect()
    assert {r["k"] for r in scores if r["s"]} == {1}


def test_null_replies_and_plans(spark, planned):
    df = planned.withColumn("raw", F.when(F.col("k") > 1, F.lit("{}")))
    got = {r["k"]: r["r"] for r in df.select("k", sel.replies(F.col("raw"), F.col("plan")).alias("r")).collect()}
    assert got[1] is None and not any(got[k]["ok"] for k in (2, 3, 4))
    assert df.limit(0).select(sel.offers(F.col("plan"))).count() == 0


def test_states_of_lines(planned):
    got = {r["k"]: r["line"] for r in sel.recover(planned, FirstChoice).collect()}
    assert (got[1]["status"], got[1]["text"], got[1]["flags"]) == ("ok", "the cat", []) and got[1]["final_scores"]["rec:out"] < 0
    assert got[2]["status"] == "review" and got[2]["flags"] == ["no_feasible_source"]
    assert got[3]["status"] == "error" and got[3]["text"] == "" and "spans" in got[3]["error"]


def plan():
    span = lambda i, a, b, text: {"id": i, "start": a, "end": b, "original": text, "candidates": [{"id": "c0", "text": text, "origin": "original", "edit_cost": 0.0, "scores": {}, "visual_support": True}]}
    return {"base_text": "one two", "alphabet": c.PRINTABLE, "spans": [span("s0", 0, 3, "one"), span("s1", 4, 7, "two")]}


def test_plans_are_checked():
    sel.check_plan(plan())
    for change in ({"start": -1}, {"start": 3}, {"end": 99}, {"original": "twx"}, {"start": 4.0}):
        bad = plan()
        bad["spans"][1 if "start" in change and change["start"] == 3 else 0] |= change
        with pytest.raises(ValueError):
            sel.check_plan(bad)
    twice = plan()
    twice["spans"][1]["id"] = "s0"
    with pytest.raises(ValueError):
        sel.check_plan(twice)
    out_of_order = plan()
    out_of_order["spans"].reverse()
    with pytest.raises(ValueError):
        sel.check_plan(out_of_order)


def test_refusals_come_in_order():
    p = plan()
    for text, reason in ((" ", "blank_or_padded"), (" a", "blank_or_padded"), ("é", "alphabet"), ("x" * 16, "growth"), ("a b c d e", "local_limits"), ("ten", None)):
        assert sel.refusal(p, p["spans"][0], text, 12) == reason


def test_word_groups():
    assert c.word_groups(4, [], 3) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert c.word_groups(4, [(0, 1), (1, 2), (2, 3)], 3) == [(0, 2), (3, 3)]
    assert c.word_groups(5, [(1, 2), (3, 4), (2, 3)], 3) == [(0, 0), (1, 2), (3, 4)]
    assert c.word_groups(0, [], 3) == []


def test_facts_of_lines_agree_with_a_lexicon_in_memory(spark):
    counts = {"upstream": 2, "up": 9, "stream": 5, "moment": 4, "Iowa": 1, "in": 7, "to": 8, "into": 3}
    lexicon = spark.createDataFrame([(w, n) for w, n in counts.items()] + [(None, 1)], "word string, count long")
    lines = ["go up stream (upstream), now", "a rnornent in to it", "1owa.", "", "-- ..", "Up-to it"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(lines)] + [("n", None)], "line_id string, base string")
    got = {r["line_id"]: c.facts_of(r["facts"].asDict(True)) for r in c.line_facts(df, lexicon).collect()}
    local = c.Lexicon(counts)
    for i, text in enumerate(lines):
        facts = got.get(str(i), c.Facts())
        sources = [c.Source("rec", "out", text)]
        assert c.build_plan(sources, facts) == c.build_plan(sources, local)
    assert got["0"].merged == {"upstream"} and got["0"].splits("upstream") == [2] and got["1"].near("rnornent", c.Limits())[0] == "moment"
    assert c.line_facts(df.limit(0), lexicon).count() == 0
