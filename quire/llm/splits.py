"""Splits that keep related records together.

Records that share a value of any tie column, directly or through others, form one
group. Groups are the connected components of a graph whose vertices are tie *values*
(not records), found by random-mate contraction: each round every vertex draws a coin,
vertices with tails move into their smallest neighbour with heads, and the edges are
renamed, until no edge is left; the moves are then unwound in reverse. Before the coins of
a round, vertices with a single neighbour move into it, which needs no coin and takes away
most of the edges (pictures of one work, editions of one number). A value that a third of
all records hold is one vertex, and the records behind it are pre-aggregated into distinct
pairs before the first exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import strip_blanks
from quire.operators.running import hash_bin, running_total
from quire.session import discard, settle

# Words written where an edition is not known.
NO_EDITION = ["", "-", "n/a", "na", "none", "null", "nil", "unknown", "tbd", "tba", "pending", "?", "missing", "unassigned"]
# End of fixed values.

MAX_ROUNDS = 200


def document_number(raw: Column) -> Column:
    """The number in a document id however it is written: '00000113', 'Doc. 4', '#105',
    full-width digits and '132.0' all count; null where there is no digit."""
    digits = F.translate(raw, "０１２３４５６７８９．", "0123456789.")
    whole = F.regexp_replace(digits, r"(?<=[0-9])\.0+(?![0-9.])", "")
    number = F.regexp_replace(F.regexp_extract(whole, r"([0-9]+)", 1), r"^0+(?=[0-9])", "")
    return F.when(number != "", number)


def edition(raw: Column) -> Column:
    """The edition id, or null for nulls, blanks, filler words and strings of zeros."""
    word = F.lower(strip_blanks(raw))
    return F.when(~word.isin(NO_EDITION) & ~word.rlike(r"\A[0\-_.?*\s]+\z"), word)


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def leaf_moves(edges: DataFrame) -> DataFrame:
    """(node, root) of the vertices of `edges(u, v)`, u < v and distinct, that have one
    neighbour: each moves into it. Of two that have only each other the larger one moves."""
    single = _both(edges).groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v")).filter("n = 1")
    ends = single.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.max("u").alias("node"))
    return ends.select("node", F.when(F.col("node") == F.col("b"), F.col("a")).otherwise(F.col("b")).alias("root"))


def contract(edges: DataFrame, label: str = "contract") -> DataFrame:
    """Connected components of undirected `edges(u, v)` as (node, root), for every node
    that has an edge to another one; the root is one of the component's nodes.

    Loops and repeated edges are allowed. Every round's moves and edges are written to
    the scratch folder, so an executor's loss repeats one round at most.
    """
    spark = edges.sparkSession

    def coin(node: str, turn: int) -> Column:
        return F.pmod(F.xxhash64(F.col(node), F.lit(turn)), F.lit(2)) == 1

    now = settle(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), label)
    moves: list[DataFrame] = []
    for turn in range(MAX_ROUNDS):
        if now.isEmpty():
            break
        # A leaf's only edge goes with it; no other edge is renamed.
        moved = settle(leaf_moves(now), label)
        moves.append(moved)
        gone = moved.select(F.least("node", "root").alias("u"), F.greatest("node", "root").alias("v"))
        before, now = now, settle(now.join(gone, ["u", "v"], "left_anti"), label)
        discard(spark, before)
        if now.isEmpty():
            break
        # Tails move to the smallest neighbour with heads; min() combines on the map side.
        met = _both(now).filter(~coin("u", turn) & coin("v", turn))
        moved = settle(met.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")), label)
        moves.append(moved)
        end = now
        for side in ("u", "v"):
            step = moved.select(F.col("node").alias(side), F.col("root").alias("_to"))
            end = end.join(step, side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
        end = end.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        before, now = now, settle(end, label)
        discard(spark, before)
    else:
        raise RuntimeError(f"edges left after {MAX_ROUNDS} rounds")
    discard(spark, now)
    if not moves:
        return spark.createDataFrame([], "node string, root string")
    # Unwind: a vertex that moved in an early round ends where its goal ended later.
    known = moves[-1]
    for earlier in reversed(moves[:-1]):
        later = known.select(F.col("node").alias("root"), F.col("root").alias("_root"))
        known = settle(earlier.join(later, "root", "left").select("node", F.coalesce("_root", "root").alias("root")).union(known), label)
    return known


def tie_groups(df: DataFrame, ties: dict[str, Column], id_col: str) -> DataFrame:
    """`df` plus `group_id`: the smallest `id_col` of the record's group.

    `ties` maps a name to an expression whose equal non-null values tie records. A record
    whose ties are all null is tied to nothing and gets a null `group_id`. Any columns of
    `df` are kept; names starting with '_tie' are reserved.
    """
    nodes = {f"_tie_{k}": F.when(c.isNotNull(), F.concat(F.lit(f"{k}:"), c)) for k, c in ties.items()}
    tagged = df.select("*", *[c.alias(k) for k, c in nodes.items()])
    names = list(nodes)
    seen = tagged.select(*names).distinct()
    # A chain through the record's non-null values ties them all with fewest edges.
    links = []
    for i, a in enumerate(names[:-1]):
        nxt = F.coalesce(*names[i + 1 :])
        links.append(seen.select(F.col(a).alias("u"), nxt.alias("v")).filter("u is not null and v is not null"))
    roots = contract(reduce(DataFrame.union, links)) if links else None
    tagged = tagged.withColumn("_tie_node", F.coalesce(*names))
    if roots is not None:
        step = roots.select(F.col("node").alias("_tie_node"), F.col("root").alias("_tie_root"))
        tagged = tagged.join(step, "_tie_node", "left").withColumn("_tie_node", F.coalesce("_tie_root", "_tie_node")).drop("_tie_root")
    firsts = tagged.filter("_tie_node is not null").groupBy("_tie_node").agg(F.min(id_col).alias("group_id"))
    return tagged.join(firsts, "_tie_node", "left").drop("_tie_node", *names)


def assign_splits(
    groups: DataFrame, shares: dict[str, float], key: str, weight: str, bins: int = 256, large: float = 0.005
) -> DataFrame:
    """(key, split) for a table of groups (key, weight), by cumulative weight.

    Groups above the share `large` come first, heaviest first, then the others in hash
    order; each takes the split into which the middle of its span of the cumulative weight falls.
    Name the largest split first: then heavy groups land there and the cuts between
    splits fall among light ones, whose size bounds the error. Groups of weight 0 or
    null go where the line stands.
    """
    total = groups.agg(F.sum(weight)).first()[0] or 0
    t = groups.select(F.col(key).alias("_key"), F.coalesce(F.col(weight), F.lit(0)).cast("bigint").alias("_weight"))
    heavy = F.col("_weight") > F.lit(float(large) * total)
    t = t.withColumn("_hash", F.xxhash64("_key")).withColumn("_bin", F.when(heavy, F.lit(-1)).otherwise(hash_bin(F.col("_hash"), bins)))
    t = t.withColumn("_order", F.when(heavy, -F.col("_weight")).otherwise(F.col("_hash")))
    t = running_total(t, "_weight", "_bin", ["_order", "_key"], "_end")
    middle = (F.col("_end") - F.col("_weight") / F.lit(2.0)) / F.lit(max(total, 1))
    scale = sum(shares.values())
    edge, pick = 0.0, None
    for name, share in shares.items():
        edge += share / scale
        pick = F.when(middle < edge, name) if pick is None else pick.when(middle < edge, name)
    return t.select(F.col("_key").alias(key), pick.otherwise(list(shares)[-1]).alias("new_split"))


def sample_groups(samples: DataFrame) -> DataFrame:
    """Page manifest rows with `group_id`, tied by document number, edition and picture."""
    ties = {
        "number": document_number(F.col("document_id")),
        "edition": edition(F.col("document_uid")),
        "picture": F.when(strip_blanks(F.col("out_sha256")) != "", F.col("out_sha256")),
    }
    return tie_groups(samples, ties, "id")


def disagreeing(grouped: DataFrame) -> DataFrame:
    """(group_id, id) of all rows of groups with two or more different non-null splits."""
    per = grouped.filter("group_id is not null").groupBy("group_id").agg(F.min("split").alias("_lo"), F.max("split").alias("_hi"))
    mixed = per.filter("_lo < _hi").select("group_id")
    return grouped.select("group_id", "id").distinct().join(mixed, "group_id", "left_semi").select("group_id", "id")


def split_samples(samples: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """(id, document_id, group_id, old_split, new_split) for every row of `samples`.

    A row without any tie is a group of its own, known by its id.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    grouped = settle(sample_groups(samples).select("id", "document_id", "group_id", "split"), "split")
    grouped = grouped.withColumn("_group", F.coalesce(F.concat(F.lit("g:"), "group_id"), F.concat(F.lit("r:"), F.coalesce("id", F.lit("")))))
    sizes = grouped.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"))
    assigned = assign_splits(sizes, shares, "_group", "_rows")
    return grouped.join(assigned, "_group").select("id", "document_id", "group_id", F.col("split").alias("old_split"), "new_split")
