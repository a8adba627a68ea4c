"""Word alternatives: confusions, lexicon neighbours, splits and merges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letter groups that recognizers confuse, and edit costs.
CONFUSIONS = [("rn", "m"), ("cl", "d"), ("vv", "w"), ("1", "l"), ("1", "I"), ("0", "O")]
CONFUSED, CASE_ONLY = 0.35, 0.2
# Words meet on keys made of their first characters only, which misses nothing.
START = 7
# End of fixed values.

BOTH_WAYS = CONFUSIONS + [(b, a) for a, b in CONFUSIONS]
GOALS = {a: [b for x, b in BOTH_WAYS if x == a] for a, _ in BOTH_WAYS}


def edit_cost(source: str, target: str, most: float = float("inf")) -> float:
    """Cheapest way from one string to the other: a character inserted, deleted or replaced
    costs 1, a change of letter case 0.2, a confused group 0.35. Infinite where it is seen
    early to be above `most`."""
    goals = GOALS
    low = 0.0
    rows: list[list[float]] = [[float(j) for j in range(len(target) + 1)]]
    for i, a in enumerate(source, 1):
        row = [float(i)]
        for j, b in enumerate(target, 1):
            swap = 0.0 if a == b else CASE_ONLY if a.lower() == b.lower() else 1.0
            row.append(min(rows[i - 1][j] + 1, row[j - 1] + 1, rows[i - 1][j - 1] + swap))
            for k in (1, 2):
                for seen in goals.get(source[i - k : i], ()) if k <= i else ():
                    if target.endswith(seen, 0, j):
                        row[j] = min(row[j], rows[i - k][j - len(seen)] + CONFUSED)
        rows.append(row)
        before, low = low, min(row)
        if before > most and low > most:
            return float("inf")
    return rows[-1][-1]


@F.arrow_udf(T.DoubleType())
def _edit_costs(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else edit_cost(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def weighted_edit(source: Column, target: Column) -> Column:
    """edit_cost of two columns; null if either is."""
    return _edit_costs(source, target)


def case_like(word: Column, original: Column) -> Column:
    """`word` in the case of `original`: all upper, capitalised, or as it is."""
    titled = F.concat(F.upper(F.substring(original, 1, 1)), F.lower(F.substring(original, F.lit(2), F.length(original))))
    has = original.rlike("[A-Za-z]")
    return F.when(has & (original == F.upper(original)), F.upper(word)).when(has & (original == titled), F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))).otherwise(word)


def confusion_variants(words: DataFrame, col: str) -> DataFrame:
    """(col, variant): each single occurrence of a confused group replaced, both ways.
    Words without a letter (page numbers, years) have none."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in BOTH_WAYS])
    rows = words.filter(F.col(col).rlike("[A-Za-z]")).select(col, F.explode(pairs).alias("p"), F.length(col).alias("_n"))
    rows = rows.filter(F.contains(F.col(col), F.col("p.a"))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    k = F.length("p.a")
    rows = rows.filter(F.substring(F.col(col), F.col("i"), k) == F.col("p.a"))
    variant = F.concat(F.substring(F.col(col), F.lit(1), F.col("i") - 1), F.col("p.b"), F.substring(F.col(col), F.col("i") + k, F.col("_n")))
    return rows.select(col, variant.alias("variant")).distinct()


def word_splits(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, head, tail): every way to split a word into two words of the lexicon."""
    w = words.select("word").distinct().filter(F.length("word") > 1).withColumn("i", F.explode(F.sequence(F.lit(1), F.length("word") - 1)))
    halves = w.select("word", F.substring(F.col("word"), F.lit(1), F.col("i")).alias("head"), F.substring(F.col("word"), F.col("i") + 1, F.length("word")).alias("tail"))
    known = lexicon.select(F.lower("word").alias("k")).distinct()
    halves = halves.join(known, F.lower("head") == F.col("k"), "left_semi")
    return halves.join(known, F.lower("tail") == F.col("k"), "left_semi")


def word_merges(pairs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Neighbouring alphabetic words (a, b) that are one word of the lexicon, as `merged`."""
    both = pairs.filter(F.col("a").rlike(r"\A[A-Za-z]+\z") & F.col("b").rlike(r"\A[A-Za-z]+\z")).withColumn("merged", F.lower(F.concat("a", "b")))
    return both.join(lexicon.select(F.lower("word").alias("merged")).distinct(), "merged", "left_semi")


def left_out(start: str, depth: int) -> set[str]:
    """A string and all forms with up to `depth` characters left out."""
    out = layer = {start}
    for _ in range(depth):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        out = out | layer
    return out


def meeting_keys(low: str, most: float, depth: int, confused: int = 0) -> set[str]:
    """Keys on which a word meets every term within a cost of `most`, if terms are kept under
    left_out(start, depth): the word's first START characters, with `confused` or more
    confused groups replaced, and with what the cost leaves for characters left out."""
    keys: set[str] = set()
    todo, seen = [(0, "", 0)], set()
    while todo:
        at, made, n = todo.pop()
        if (at, made, n) in seen:
            continue
        seen.add((at, made, n))
        if at >= len(low) or len(made) >= START:
            if n >= confused:
                keys |= left_out(made[:START], min(depth, int(most - CONFUSED * n + 1e-9)))
            continue
        todo.append((at + 1, made + low[at], n))
        if CONFUSED * (n + 1) <= most:
            todo += [(at + k, made + b.lower(), n + 1) for k in (1, 2) if at + k <= len(low) for b in GOALS.get(low[at : at + k], ())]
    return keys


@F.arrow_udf(T.ArrayType(T.StringType()))
def _left_out(starts: pa.Array, depth: pa.Array) -> pa.Array:
    return pa.array([None if s is None else sorted(left_out(s, d)) for s, d in zip(starts.to_pylist(), depth.to_pylist())], pa.list_(pa.string()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _confused_keys(words: pa.Array, most: pa.Array) -> pa.Array:
    return pa.array([sorted(meeting_keys(w, m, int(m) - 1, 1)) for w, m in zip(words.to_pylist(), most.to_pylist())], pa.list_(pa.string()))


def near_terms(words: DataFrame, lexicon: DataFrame, max_edit: int = 3, confusions: bool = False) -> DataFrame:
    """(word, term, count): every term of `lexicon` (word, count) within `max_edit` unit edits
    of a distinct word, letter case aside, but for the word itself. With `confusions` also
    the terms within that cost (edit_cost) that confused groups bring there.

    Words and terms meet on a common form of their first START characters with at most
    `max_edit` of them left out of either, so that none is missed: whichever start ends first
    in the alignment, all but max_edit of its characters lie in the other. A confused group
    leaves less for other edits, so that words with groups replaced need one less left out,
    and only these pairs are weighed by more than built-in functions.
    """
    spark = words.sparkSession
    # Keys and costs are worth more tasks than the size of the words would give.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    start = lambda c: F.substring(F.lower(c), 1, START)
    asked = words.select("word").filter("word is not null").distinct().repartition(tasks, "word")
    terms = lexicon.select(F.col("word").alias("term"), "count").filter("term is not null")
    far = F.levenshtein(F.lower("word"), F.lower("term"), max_edit) < 0

    def met(keys: Column, depth: int) -> DataFrame:
        kept = terms.withColumn("_key", F.explode(_left_out(start("term"), F.lit(depth))))
        return asked.withColumn("_key", F.explode(keys)).join(kept, "_key").filter(F.lower("word") != F.lower("term")).drop("_key")

    pairs = met(_left_out(start("word"), F.lit(max_edit)), max_edit).filter(~far).distinct()
    if confusions and max_edit > 0:
        more = met(_confused_keys(F.lower("word"), F.lit(float(max_edit))), max_edit - 1).filter(far).distinct()
        pairs = pairs.union(more.repartition(tasks).filter(weighted_edit(F.lower("word"), F.lower("term")) <= max_edit))
    return pairs


def lexicon_lookup(words: DataFrame, lexicon: DataFrame, limit: int = 8, max_edit: int = 3, confusions: bool = False) -> DataFrame:
    """(word, term, cost, rank): up to `limit` of the near_terms of each distinct word,
    cheapest first, then by count, then by the term. With `confusions` letter case costs
    nothing."""
    cost = weighted_edit(F.lower("word"), F.lower("term")) if confusions else weighted_edit(F.col("word"), F.col("term"))
    pairs = near_terms(words, lexicon, max_edit, confusions).withColumn("cost", cost)
    rank = F.row_number().over(Window.partitionBy("word").orderBy("cost", F.desc("count"), "term"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= limit).select("word", "term", "cost", "rank")
