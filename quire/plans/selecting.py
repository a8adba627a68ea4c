"""Queries of the selection protocol, with their SQL.

Orders stand in for lines: the priority and a clerk named after the customer are two spans, each with an
alternative, and the order's key tells how the reply to its plan is formed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import candidates, selection, spelling
from quire.plans.decoding import LETTERS, evidence
from quire.session import settle
from quire.sources.tables import spread, table


def _candidate(no: int, text: Column, origin: str, shown: bool) -> Column:
    return F.struct(F.lit(f"c{no}").alias("id"), text.alias("text"), F.lit(origin).alias("origin"), F.lit(float(no)).alias("edit_cost"), F.create_map().cast("map<string,double>").alias("scores"), F.lit(shown).alias("visual_support"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """(o_orderkey, plan, raw): a plan of two spans and a reply, of which two in eight are in order."""
    o = spread(table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", F.concat(F.lit("Clerk#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("o_clerk")))
    a, b = F.col("o_orderpriority"), F.col("o_clerk")
    zero, n = F.lit(0), F.length(a)
    one = F.struct(F.lit("s0").alias("id"), zero.alias("start"), n.alias("end"), a.alias("original"), F.array(_candidate(0, a, "original", True), _candidate(1, F.lower(a), "lexicon", True)).alias("candidates"))
    two = F.struct(F.lit("s1").alias("id"), (n + 1).alias("start"), (n + 1 + F.length(b)).alias("end"), b.alias("original"), F.array(_candidate(0, b, "original", True), _candidate(1, F.upper(b), "lexicon", False)).alias("candidates"))
    plan = F.struct(F.concat_ws(" ", a, b).alias("base_text"), F.lit("rec:out").alias("base_source"), F.lit(candidates.PRINTABLE).alias("alphabet"), F.lit(None).cast("string").alias("error"), F.array(one, two).alias("spans"))

    def reply(first: str, second: str | None, proposals: list | None = None, **more: str) -> Column:
        choices = [{"span_id": s, "candidate_id": c} for s, c in (("s0", first), ("s1", second)) if c]
        return F.lit(json.dumps({"choices": choices, "proposals": proposals or []} | more))

    kinds = [
        reply("c1", "c0"), reply("c0", "c0"), reply("c0", None), reply("c0", "c1"), reply("c0", "c0", note="sure"), reply("c9", "c0"),
        reply("c1", "c0", [{"span_id": "s1", "text": " padded"}]), F.lit("Sorry, I can't."),
    ]
    return o.select("o_orderkey", "o_clerk", plan.alias("plan"), F.get(F.array(*kinds), (F.col("o_orderkey") % 8).cast("int")).alias("raw"))


def offered_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The candidates that a selector is shown, by what its JSON says."""
    shown = _lines(spark, folder).select("o_orderkey", F.from_json(selection.offers(F.col("plan")), "base_text string, spans array<struct<id:string,candidates:array<struct<id:string,visual_support:boolean>>>>").alias("j"))
    ids = F.transform("j.spans", lambda s: F.concat_ws(":", s["id"], F.array_join(F.transform(s["candidates"], lambda c: c["id"]), ",")))
    leaks = F.exists("j.spans", lambda s: F.exists(s["candidates"], lambda c: c["visual_support"].isNotNull()))
    return shown.select("o_orderkey", F.col("j.base_text").alias("base_text"), F.array_join(ids, " ").alias("ids"), leaks.alias("leaks"))


def _read(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).select("o_orderkey", "o_clerk", "plan", selection.replies(F.col("raw"), F.col("plan")).alias("r"))


def reply_parse(spark: SparkSession, folder: str) -> DataFrame:
    r = _read(spark, folder)
    return r.select("o_orderkey", F.col("r.ok").alias("ok"), F.coalesce(F.size("r.choices"), F.lit(-1)).alias("choices"), F.coalesce(F.size("r.proposals"), F.lit(-1)).alias("proposals"))


def apply_choices(spark: SparkSession, folder: str) -> DataFrame:
    """The line of each reply, and what comes of a choice that no source can show."""
    r = _read(spark, folder)
    done, forced = selection.applied(F.col("plan"), F.col("r.choices")), selection.applied(F.col("plan"), F.create_map(F.lit("s1"), F.lit("c1")))
    return r.select("o_orderkey", F.when(F.col("r.ok"), done["text"]).alias("text"), forced["error"].isNotNull().alias("refused"))


def proposal_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Proposed texts for the clerk, by what is wrong with them."""
    texts = [F.lit(" padded"), F.lit("café"), F.lit("x" * 60), F.lit("a b c d e"), F.col("o_clerk"), F.lit("Clerk#1")]
    wanted = F.create_map(F.lit("s1"), F.get(F.array(*texts), (F.col("o_orderkey") % 6).cast("int")))
    none = F.array().cast("array<struct<name:string,view:string,text:string>>")
    r = _lines(spark, folder).select("o_orderkey", selection.admitted(F.col("plan"), wanted, none).alias("a"))
    return r.select("o_orderkey", F.get("a.rejected", F.lit(0))["reason"].alias("reason"), F.size("a.accepted").alias("accepted"))


def _selector() -> Callable[[str], dict]:
    """A selector whose reply follows from the last digit of the line it is shown."""

    def ask(prompt: str) -> dict:
        data = json.loads(prompt)
        digit = int(data["base_text"][-1])
        if digit == 8:
            return {"status": "error", "raw": None}
        choices = [{"span_id": s["id"], "candidate_id": s["candidates"][-1 if digit < 4 else 0]["id"]} for s in data["spans"]]
        proposals = [{"span_id": "s0", "text": " "}] if digit in (6, 7) else []
        return {"status": "ok", "raw": "no" if digit == 9 else json.dumps({"choices": choices, "proposals": proposals})}

    return ask


def line_states(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder).select("o_orderkey", "plan", F.array().cast("array<struct<name:string,view:string,text:string>>").alias("sources"), F.array().cast("array<string>").alias("context"))
    done = selection.recover(lines, _selector)
    return done.select("o_orderkey", "line.status", "line.text", F.array_join("line.flags", ",").alias("flags"), F.col("line.error").isNotNull().alias("failed"))


def scored_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Plans of lexicon words with evidence of two views: of the word, and of the first form
    in which a confused group may make it appear; candidates with the scores of both."""
    words = table(spark, folder, "lexicon").select("word").filter(F.col("word").rlike(r"\A[\x21-\x7E]+\z"))
    seen = spelling.confusion_variants(words, "word").groupBy("word").agg(F.min("variant").alias("seen"))
    lines = spread(words.join(seen, "word", "left").withColumn("seen", F.coalesce("seen", "word")))
    source = lambda view, text: F.struct(F.lit("rec").alias("name"), F.lit(view).alias("view"), F.col(text).alias("text"), evidence(F.col(text)).alias("probs"), F.array(*map(F.lit, LETTERS)).alias("letters"), F.lit(0).alias("blank"))
    lines = settle(lines.select("word", "seen", F.array(source("out", "seen"), source("blur", "word")).alias("sources")), "evidence")
    planned = lines.select("word", "seen", candidates.plans(F.col("sources")).alias("p"))
    rows = planned.select("word", "seen", F.explode("p.spans").alias("s")).select("word", "seen", F.explode("s.candidates").alias("c"))
    return rows.select("word", "seen", "c.id", "c.text", "c.origin", F.round(F.col("c.scores")["rec:out"], 4).alias("out_score"), F.round(F.col("c.scores")["rec:blur"], 4).alias("blur_score"), "c.visual_support")


def scored_best(spark: SparkSession, folder: str) -> DataFrame:
    """Which candidate of each word the evidence of the clear view likes best: always the word."""
    rows = scored_plan(spark, folder)
    return rows.groupBy("word").agg(F.max_by("text", "blur_score").alias("best"), F.bool_and("visual_support").alias("shown"))


_KIND = "o_orderkey % 8"
_ORDERS = "WITH o AS (SELECT o_orderkey, o_orderpriority, 'Clerk#' || lpad(o_custkey::VARCHAR, 9, '0') AS o_clerk FROM orders)"
SQL = {
    "offered_ids": f"{_ORDERS} SELECT o_orderkey, o_orderpriority || ' ' || o_clerk AS base_text, 's0:c0,c1 s1:c0' AS ids, false AS leaks FROM o",
    "reply_parse": f"{_ORDERS} SELECT o_orderkey, {_KIND} IN (0, 1, 6) AS ok, CASE WHEN {_KIND} IN (0, 1, 6) THEN 2 ELSE -1 END AS choices, CASE {_KIND} WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 6 THEN 1 ELSE -1 END AS proposals FROM o",
    "apply_choices": f"{_ORDERS} SELECT o_orderkey, CASE WHEN {_KIND} IN (0, 6) THEN lower(o_orderpriority) || ' ' || o_clerk WHEN {_KIND} = 1 THEN o_orderpriority || ' ' || o_clerk END AS text, upper(o_clerk) <> o_clerk AS refused FROM o",
    "proposal_verdicts": f"""{_ORDERS} SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'blank_or_padded' WHEN 1 THEN 'alphabet' WHEN 2 THEN 'growth' WHEN 3 THEN 'local_limits'
        WHEN 5 THEN CASE WHEN o_clerk <> 'Clerk#1' THEN 'no_visual_support' END END AS reason, 0 AS accepted FROM o""",
    "line_states": f"""{_ORDERS}, d AS (SELECT *, right(o_clerk, 1)::INT AS d, o_orderpriority || ' ' || o_clerk AS base FROM o)
        SELECT o_orderkey, CASE WHEN d IN (8, 9) THEN 'error' WHEN d IN (6, 7) THEN 'review' ELSE 'ok' END AS status, CASE WHEN d < 4 THEN lower(o_orderpriority) || ' ' || o_clerk ELSE base END AS text,
          CASE WHEN d IN (6, 7) THEN 'rejected_proposals' ELSE '' END AS flags, d IN (8, 9) AS failed FROM d""",
    "scored_best": "SELECT word, word AS best, true AS shown FROM lexicon WHERE regexp_full_match(word, '[!-~]+')",
}

ALL = (offered_ids, reply_parse, apply_choices, proposal_verdicts, line_states, scored_plan, scored_best)
