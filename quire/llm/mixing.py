"""Mixing sources to target weights by weighted fair queueing.

Every document gets a virtual finish time: the tokens its source has sent up to and with
it, in a shuffled order, divided by the source's weight. A repeat of a source is a second
pass behind the first. All copies in order of finish time, cut where the budget is used
up, are the mix: at any point of that order the sources stand at their weights, as far as
they haven't run dry.

Running totals are kept within hash bins, so a source that holds a third of all documents
is summed by as many tasks as any other share of the rows. Copies that start behind the
latest time at which the budget can end are never made. The others are sorted globally by
sampled ranges of finish time; ranges before the cut are taken whole, and only the range
in which the budget ends is summed row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import strip_blanks
from quire.llm.tokens import DEFAULT_VOCABULARY, token_count
from quire.operators.running import hash_bin, running_total
from quire.session import settle

#: Targets up to this many rows are broadcast; more are joined by exchange.
BROADCAST_ROWS = 10_000
#: Rows of a source that share a hash bin, about.
BIN_ROWS = 250_000


def source_name(raw):
    """A source as targets name it: letter case and outer blanks don't matter."""
    return F.lower(strip_blanks(raw))


def sized_documents(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of every document, kept in the scratch folder."""
    rows = documents.select("doc_id", source_name(F.col("source")).alias("source"), token_count(F.col("text"), vocabulary).cast("bigint").alias("tokens"))
    return settle(rows, "sized")


def source_supply(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: supply, its largest document, target tokens (share as given, of all
    documents together) and what the source can give with all its repeats. Targets without
    documents have 0. Of a source that is named twice the larger figures count."""
    everything = sized.agg(F.sum("tokens")).first()[0] or 0
    t = targets.groupBy(source_name(F.col("source")).alias("source")).agg(
        F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats")
    )
    have = sized.groupBy("source").agg(F.sum("tokens").alias("supply_tokens"), F.max("tokens").alias("largest"), F.count(F.lit(1)).alias("documents"))
    t = t.join(have, "source", "left").na.fill({"supply_tokens": 0, "largest": 0, "documents": 0})
    t = t.withColumn("target_tokens", F.col("target_share") * F.lit(everything))
    return t.withColumn("available_tokens", F.col("supply_tokens") * F.col("max_repeats"))


def latest_finish(supply: DataFrame, budget: int) -> float:
    """A virtual time behind which no copy can be in a mix of `budget` tokens; infinity if
    the sources can't fill it.

    Up to a time V a source has sent as much as weight * V, but no more than it has and less
    by a document at most. The time at which that makes up for the budget and for one
    largest document of each source is the bound; there is one row a source to sum.
    """
    t = supply.filter("target_share > 0 and available_tokens > 0").select("available_tokens", "largest", F.col("target_share").alias("w"), (F.col("available_tokens") / F.col("target_share")).alias("dry"))
    line = Window.orderBy("dry", "w", "available_tokens")
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(0, Window.unboundedFollowing)
    t = t.select("dry", F.coalesce(F.sum("available_tokens").over(before), F.lit(0)).alias("gone"), F.sum("w").over(after).alias("open"), F.sum("largest").over(Window.partitionBy()).alias("slack"))
    need = F.lit(budget) + F.col("slack")
    met = t.filter(F.col("gone") + F.col("dry") * F.col("open") >= need).withColumn("at", (need - F.col("gone")) / F.col("open"))
    # Of the sources that run dry first behind the bound; the later of two that do so at once.
    found = met.agg(F.max_by("at", F.struct(-F.col("dry"), F.col("at")))).first()[0]
    return math.inf if found is None else found


ORDER = ["finish", "source", "copy", "doc_id"]


def queue(sized: DataFrame, supply: DataFrame, budget: int, seed: int = 7) -> DataFrame:
    """The copies that may be in the mix, with their finish times, sorted globally: `_range`
    numbers sampled ranges of ORDER, ascending. Kept in the scratch folder."""
    spark = sized.sparkSession
    end = latest_finish(supply, budget)
    lines = supply.filter("target_share > 0 and max_repeats > 0").select("source", "target_share", "max_repeats", "supply_tokens")
    if supply.count() <= BROADCAST_ROWS:
        lines = F.broadcast(lines)
    bins = max(16, -(-sized.count() // BIN_ROWS))
    rows = sized.filter("tokens > 0").join(lines, "source").withColumn("_hash", F.xxhash64("doc_id", F.lit(seed)))
    rows = rows.withColumn("_bin", hash_bin(F.col("_hash"), bins))
    rows = running_total(rows, "tokens", "_bin", ["_hash", "doc_id"], "_sent", ["source"])
    if math.isfinite(end):
        passes = F.ceil((F.lit(end) * F.col("target_share") - F.col("_sent") + F.col("tokens")) / F.col("supply_tokens"))
        rows = rows.withColumn("max_repeats", F.least("max_repeats", passes))
    rows = rows.filter("max_repeats > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("max_repeats").cast("int"))))
    sent = F.col("_sent") + (F.col("copy") - 1) * F.col("supply_tokens")
    rows = rows.select("doc_id", "source", "copy", "tokens", (sent / F.col("target_share")).alias("finish"))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return settle(rows.repartitionByRange(ranges, *ORDER).withColumn("_range", F.spark_partition_id()), "queue")


def mix(sized: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 7) -> DataFrame:
    """The mix as (doc_id, source, copy, tokens, finish): one row for each use of a document.

    `budget` is in tokens; by default it is the sum, over all targets, of the target or
    of what the source can give if that is less, so that no source exceeds its target to
    make up for another. A larger budget lets the others fill in, still by weight.
    Sources without a target, and null sources, aren't used. Documents of null or zero
    size have no place in the order and are left out. Repeated rows are separate
    documents. A target of 0 is never drawn from.
    """
    supply = settle(source_supply(sized, targets), "supply")
    if budget is None:
        budget = int(supply.agg(F.coalesce(F.sum(F.least("target_tokens", F.col("available_tokens").cast("double"))), F.lit(0.0))).first()[0])
    rows = queue(sized, supply, budget, seed)
    # One row a range: where it starts and ends in the line of all copies.
    line = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    spans = rows.groupBy("_range").agg(F.sum("tokens").alias("_size")).select("_range", F.sum("_size").over(line).alias("_end"), "_size")
    spans = settle(spans.select("_range", "_end", (F.col("_end") - F.col("_size")).alias("_start")), "spans")
    columns = ["doc_id", "source", "copy", "tokens", "finish"]
    within = rows.join(spans.filter(F.col("_end") <= budget).select("_range"), "_range", "left_semi").select(*columns)
    last = rows.join(spans.filter((F.col("_start") < budget) & (F.col("_end") > budget)), "_range")
    inside = Window.partitionBy("_range").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    cut = last.withColumn("_total", F.col("_start") + F.sum("tokens").over(inside)).filter(F.col("_total") <= budget)
    return within.unionByName(cut.select(*columns))


def mix_report(mixed: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target what the mix reached: tokens, share of the mix, wished share scaled to
    one, most uses of a document, and whether the source fell `short`: the mix holds all
    that it can give with its repeats and is below the target."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("mix_tokens"), F.max("copy").alias("repeats_used"))
    t = settle(source_supply(sized, targets).join(got, "source", "left").na.fill({"mix_tokens": 0, "repeats_used": 0}), "report")
    mix_tokens, wish = t.agg(F.sum("mix_tokens"), F.sum("target_share")).first()
    return t.select(
        "source", "documents", "supply_tokens", "max_repeats", "target_share", "target_tokens", "mix_tokens", "repeats_used",
        (F.col("target_share") / F.lit(wish or None).cast("double")).alias("scaled_share"),
        (F.col("mix_tokens") / F.lit(mix_tokens or None).cast("double")).alias("actual_share"),
        ((F.col("mix_tokens") == F.col("available_tokens")) & (F.col("mix_tokens") < F.col("target_tokens"))).alias("short"),
    )
