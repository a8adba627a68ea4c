"""Queries over character evidence and candidate plans, with their SQL.

The tables hold no whole matrices of probabilities of lines, so squared embedding values stand in for
frames, and evidence of lexicon words is made the way a recognizer would emit it: a
blank between letters, and a fifth of the mass spread over all classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import candidates, ctc
from quire.session import settle
from quire.sources.tables import spread, table

#: The blank and all printable characters, by code from the blank on.
LETTERS = ["", *map(chr, range(32, 127))]


def _frames(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("label", F.col("vec_id").alias("t"), F.posexplode("embedding").alias("class_id", "x"))
    square = e.select("label", "t", "class_id", (F.col("x").cast("double") * F.col("x").cast("double")).alias("q"))
    total = square.groupBy("label", "t").agg(F.sum("q").alias("s"))
    return square.join(total, ["label", "t"]).select("label", "t", "class_id", (F.col("q") / F.col("s")).alias("p"))


def restrict_mass(spark: SparkSession, folder: str) -> DataFrame:
    mass = ctc.restrict(_frames(spark, folder), "label", spark.range(32).select(F.col("id").cast("int").alias("class_id")))[1]
    return mass.groupBy("label").agg(F.count(F.lit(1)).alias("frames"), F.round(F.avg("excluded_mass"), 6).alias("mean_excluded_mass"))


def greedy_decode(spark: SparkSession, folder: str) -> DataFrame:
    out = ctc.greedy(_frames(spark, folder), "label")
    return out.select("label", F.array_join(F.col("classes").cast("array<string>"), " ").alias("decoded"))


def evidence(word: Column) -> Column:
    """Frames of a word: 0.8 on the blank or the letter, 0.2 spread evenly."""
    n = len(LETTERS)
    share = 0.2 / n

    def frame(t: Column) -> Column:
        meant = F.when(t % 2 == 0, F.lit(0)).otherwise(F.ascii(F.substring(word, F.floor(t / 2).cast("int") + 1, F.lit(1))) - 31)
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(k == meant, F.lit(0.8 + share)).otherwise(F.lit(share)))

    return F.transform(F.sequence(F.lit(0), F.length(word) * 2), frame)


def _words(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "lexicon")).filter(F.col("word").rlike(r"\A[\x20-\x7E]+\z")).select("word", evidence(F.col("word")).alias("probs"))


def ctc_forward(spark: SparkSession, folder: str) -> DataFrame:
    texts = F.array(F.col("word"), F.reverse("word"), F.lit(""), F.concat("word", "word", F.lit("xx")))
    w = _words(spark, folder).withColumn("texts", texts)
    w = w.select("word", F.explode(F.arrays_zip("texts", ctc.score_texts(F.col("probs"), LETTERS, F.col("texts")).alias("scores"))).alias("s"))
    return w.select("word", F.col("s.texts").alias("text"), F.round("s.scores", 6).alias("log_p")).distinct()


def beam_topk(spark: SparkSession, folder: str) -> DataFrame:
    w = _words(spark, folder).select("word", F.posexplode(ctc.beams(F.col("probs"), LETTERS)).alias("rank", "b"))
    return w.select("word", "rank", F.col("b.text").alias("text"), F.round("b.log_p", 6).alias("log_p"))


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    """(line_id, sources) of every line with a reading, from its newest page record."""
    rows = table(spark, folder, "ocr_lines").filter(F.size("lines") > 0)
    age = F.struct(*[F.col(c) for c in ("written_at", "fingerprint") if c in rows.columns], F.lit(0).alias("_"))
    text = lambda s: F.coalesce(s["restricted_text"], s["raw_text"])
    read = F.transform(F.filter("l.sources", lambda s: text(s).isNotNull()), lambda s: F.struct(s["name"].alias("name"), s["view"].alias("view"), text(s).alias("text")))
    rows = rows.select(age.alias("_age"), F.explode("lines").alias("l")).select("_age", F.col("l.line_id").alias("line_id"), read.alias("sources")).filter(F.size("sources") > 0)
    return rows.groupBy("line_id").agg(F.max(F.struct("_age", "sources")).alias("r")).select("line_id", F.col("r.sources").alias("sources"))


def _base(sources: Column) -> Column:
    blank = lambda x: F.trim(x["text"]) == ""
    return F.coalesce(F.get(F.filter(sources, lambda x: (x["view"] == "out") & ~blank(x)), F.lit(0)), F.get(F.filter(sources, lambda x: ~blank(x)), F.lit(0)), F.get(sources, F.lit(0)))


def _planned(spark: SparkSession, lines: DataFrame, lexicon: DataFrame) -> DataFrame:
    """`lines` (line_id, sources) plus `plan`, with what the lexicon says of their words."""
    read = settle(lines.withColumn("base", candidates.plain(_base(F.col("sources"))["text"])), "read")
    facts = candidates.line_facts(read.select("line_id", "base"), lexicon)
    # Planning costs far more than an exchange, and small partitions aren't to be joined before it.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return read.join(facts, "line_id", "left").repartition(tasks, "line_id").select("line_id", "sources", candidates.plans(F.col("sources"), F.col("facts")).alias("plan"))


def candidate_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Spans and candidates of all lines with a reading, one row a candidate. A line without
    spans is one row, with its error if it couldn't be planned; the error also names sources
    that were left out of a plan."""
    lexicon = table(spark, folder, "lexicon").select("word", F.col("n_seen").alias("count"))
    planned = _planned(spark, _sources(spark, folder), lexicon)
    spans = planned.select("line_id", "plan.base_source", "plan.error", F.explode_outer("plan.spans").alias("s"))
    rows = spans.select("line_id", "base_source", "error", F.col("s.id").alias("span_id"), F.col("s.original").alias("original"), F.explode_outer("s.candidates").alias("c"))
    return rows.select("line_id", "base_source", "error", "span_id", "original", F.col("c.id").alias("candidate_id"), F.col("c.text").alias("text"), F.col("c.origin").alias("origin"), F.round("c.edit_cost", 4).alias("edit_cost"))


def base_readings(spark: SparkSession, folder: str) -> DataFrame:
    rows = _sources(spark, folder).withColumn("b", _base(F.col("sources")))
    return rows.select("line_id", F.concat_ws(":", "b.name", "b.view").alias("source"), F.col("b.text").alias("text"))


def plan_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Of each planned line: how many words of its base its spans hold, and whether every span
    starts with its original and keeps to the budget."""
    lexicon = table(spark, folder, "lexicon").select("word", F.col("n_seen").alias("count"))
    p = _planned(spark, _sources(spark, folder), lexicon).filter(F.size("plan.spans") > 0)
    words = F.flatten(F.transform("plan.spans", lambda s: F.split(s["original"], r"\s+")))
    sound = F.forall("plan.spans", lambda s: (s["candidates"][0]["text"] == s["original"]) & (s["candidates"][0]["origin"] == "original") & (F.size(s["candidates"]) <= 6))
    return p.select("line_id", F.size(words).cast("bigint").alias("words"), sound.alias("sound"))


def _budget_rows(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    origin = F.when(F.col("l_linenumber") == 1, "original").when(F.col("l_returnflag") == "A", "rec-med:blur").when(F.col("l_returnflag") == "R", "ctc_beam:rec-med:out").otherwise("lexicon")
    return li.select(F.col("l_orderkey").alias("span"), (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("position"), origin.alias("origin"), F.col("l_quantity").alias("edit_cost"))


def candidate_budget(spark: SparkSession, folder: str) -> DataFrame:
    return candidates.within_budget(_budget_rows(spark, folder), ["span"], 4)


_READ = """rows AS (SELECT line_id, s FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY written_at DESC, fingerprint DESC) AS k FROM every_ WHERE len(s) > 0) WHERE k = 1)"""
_READ = """every_ AS (SELECT written_at, fingerprint, l.line_id AS line_id, list_transform(list_filter(l.sources, lambda s: coalesce(s.restricted_text, s.raw_text) IS NOT NULL), lambda s: {'name': s.name, 'view': s."view", 'text': coalesce(s.restricted_text, s.raw_text)}) AS s
      FROM (SELECT written_at, fingerprint, unnest(lines) AS l FROM ocr_lines WHERE len(lines) > 0)), """ + _READ
_SQUARES = """q AS (SELECT label, vec_id AS t, unnest(range(len(embedding))) AS class_id, unnest(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS q FROM embeddings),
    p AS (SELECT label, t, class_id, q / sum(q) OVER (PARTITION BY label, t) AS p FROM q)"""

SQL = {
    "restrict_mass": f"WITH {_SQUARES}, m AS (SELECT label, t, sum(CASE WHEN class_id >= 32 THEN p ELSE 0 END) AS o FROM p GROUP BY label, t) SELECT label, count(*) AS frames, round(avg(o), 6) AS mean_excluded_mass FROM m GROUP BY label",
    "greedy_decode": f"""WITH {_SQUARES}, b AS (SELECT label, t, class_id FROM (SELECT *, row_number() OVER (PARTITION BY label, t ORDER BY p DESC, class_id) AS k FROM p) WHERE k = 1),
        c AS (SELECT *, lag(class_id) OVER (PARTITION BY label ORDER BY t) AS before FROM b)
        SELECT label, coalesce(string_agg(class_id::VARCHAR, ' ' ORDER BY t) FILTER (WHERE class_id <> 0 AND class_id IS DISTINCT FROM before), '') AS decoded FROM c GROUP BY label""",
    "base_readings": f"""WITH {_READ}, b AS (SELECT line_id, coalesce(list_filter(s, lambda x: x."view" = 'out' AND trim(x.text) <> '')[1], list_filter(s, lambda x: trim(x.text) <> '')[1], s[1]) AS b FROM rows WHERE len(s) > 0)
        SELECT DISTINCT line_id, b.name || ':' || b."view" AS source, b.text AS text FROM b""",
    "plan_spans": f"""WITH {_READ}, b AS (SELECT line_id, coalesce(list_filter(s, lambda x: x."view" = 'out' AND trim(x.text) <> '')[1], list_filter(s, lambda x: trim(x.text) <> '')[1], s[1]) AS b, s FROM rows)
        SELECT line_id, len(list_filter(string_split_regex(b.text, '[\\s\\x{{a0}}]+'), lambda w: w <> '')) AS words, true AS sound FROM b WHERE trim(b.text) <> '' """,
    "candidate_budget": """WITH o AS (SELECT l_orderkey AS span, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS position, l_quantity AS edit_cost,
          CASE WHEN l_linenumber = 1 THEN 'original' WHEN l_returnflag = 'A' THEN 'rec-med:blur' WHEN l_returnflag = 'R' THEN 'ctc_beam:rec-med:out' ELSE 'lexicon' END AS origin FROM lineitem),
        k AS (SELECT *, CASE WHEN origin = 'original' THEN 0 WHEN origin = 'rec-med:blur' THEN 1 WHEN origin = 'lexicon' THEN 2 ELSE 3 END AS kind FROM o),
        t AS (SELECT *, row_number() OVER (PARTITION BY span, kind ORDER BY CASE WHEN kind = 0 THEN 0 ELSE edit_cost END, position) - 1 AS place FROM k),
        n AS (SELECT *, row_number() OVER (PARTITION BY span ORDER BY least(kind, 2), CASE WHEN kind < 2 THEN place ELSE 2 * place + kind - 2 END) - 1 AS no FROM t)
        SELECT span, position, origin, edit_cost, 'c' || no AS id FROM n WHERE no < 4""",
}

ALL = (restrict_mass, greedy_decode, ctc_forward, beam_topk, candidate_plan, plan_spans, base_readings, candidate_budget)
