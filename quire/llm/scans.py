"""Repair of text from scanned pages.

Page lines are told from page furniture, words broken at line ends are found and joined
across lines, columns and pages, and misread words are found and repaired:

* furniture is told by repetition: of the lines that stand apart at a page's edges, those
  whose text recurs on other pages of the work, or that are page numbers as other pages of
  the work have them there; and the other lines that stand apart where, all over the corpus,
  most of such lines are repeated ones;
* a frequency lexicon is counted over the whole corpus (words inside lines, where none is
  broken) and joined with the fixed lexicon of ordinary words;
* a symmetric-delete index over the lexicon's confusion skeletons (a form in which easily
  confused characters are the same) generates candidates for every unknown word;
* a weighted edit distance, in which confused characters cost little and any other edit
  costs 1, keeps the candidates that misreading explains;
* bigram context picks among several repairs, and finds words that were misread into
  other words.

Lines are cut into words by built-in functions. The work is done on distinct words; lines
are touched when words are counted and when verdicts are joined back. Nothing grows with a
work: the line behind a page's last one is found by a join of pages, not by a window over
the work.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import BLANK, strip_blanks
from quire.operators.running import running_totals
from quire.session import settle

# Groups of characters that recognizers confuse, as skeleton rules in the
# order in which they apply, and digits as they are misread.
SEQUENCES = [("m", "rn"), ("h", "li"), ("u", "ii"), ("d", "cl"), ("w", "vv")]
SINGLES = {"o": "0", "l": "1|!i", "s": "5", "a": "@", "c": "(e", "b": "68", "g": "q9", "t": "f", "z": "2"}
ACCENTS = ("áàâäãåéèêëíìîïóòôöõúùûüçñýÿ", "aaaaaaeeeeiiiiooooouuuucnyy")
DIGIT_FORMS = {"0": "ODo", "1": "lI|!i", "2": "Zz", "5": "Ss", "6": "bG", "8": "B", "9": "gq"}
MARKS = "-‐‑¬~\u00ad"
# End of fixed values.

#: A line stands apart at a page's edge if it is so many line heights from the next one.
APART = 2.0
#: Places on a page, as shares of its height, are told apart in steps of this.
STEP = 0.02
#: Share of repeated lines at a place from which all lines that stand apart there are furniture.
PLACE_SHARE = 0.5
#: Letters that a recurring header or footer has at least.
LEAST_LETTERS = 4
CONFUSION_COST = 0.15
#: How many times more often a corpus word must occur than a word taken for its misreading.
RATIO = 3
#: An ordinary word counts as seen so many times more than it is, against its misreadings.
ORDINARY_SEEN = 12
#: Share of a word's occurrences that are taken to be misread as one other word.
MISREAD_SHARE = 0.005
#: Odds from bigrams at which a known word is taken for another one misread.
CONTEXT_ODDS = 20.0
#: Lines of a row of paragraph text; a longer paragraph comes in consecutive parts.
PART_LINES = 4_096

_EDGE = "\\.,;:?\"“”‘’'\\)\\]"
_STRIP = re.compile(f"^[{_EDGE}]+|[{_EDGE}]+$")
_MARK_END = re.compile(f"[{re.escape(MARKS)}]+$")


# ---------------------------------------------------------------- lines


def word_form(token: Column) -> Column:
    """A token as a word: lower case, without punctuation at its ends."""
    return F.lower(F.regexp_replace(token, f"^[{_EDGE}]+|[{_EDGE}]+$", ""))


_MARKED = f"[{re.escape(MARKS)}]"


def words_of(tokens: Column, mark: Column) -> Column:
    """The words of a line; those of one that ends in a hyphen mark end in the part before it."""
    cut = F.regexp_replace(F.try_element_at(tokens, F.lit(-1)), f"{_MARKED}+$", "")
    before = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.transform(F.when(mark, F.when(cut == "", before).otherwise(F.concat(before, F.array(cut)))).otherwise(tokens), word_form)


def first_word(line: Column) -> Column:
    """The first of words_of a line struct, null if it has none."""
    first = F.get(line["tokens"], F.lit(0))
    cut = F.regexp_replace(first, f"{_MARKED}+$", "")
    return word_form(F.when(line["mark"] & (F.size(line["tokens"]) == 1), F.when(cut != "", cut)).otherwise(first))


def _line(x: Column, height: Column) -> Column:
    """A line as the stages use it, in a form that sorts in reading order. A place is the
    middle of the line as a share of the page's height."""
    box = x["box"]
    sound = (F.size(box) == 4) & ~F.exists(box, lambda v: v.isNull()) & (height > 0)
    text = strip_blanks(F.coalesce(x["text"], x["raw_text"], F.lit("")))
    tokens = F.filter(F.split(text, rf"(?U){BLANK}+"), lambda t: t != "")
    mark = (text != "") & (text.rlike(rf"{_MARKED}\z") | F.coalesce(x["raw_text"].rlike(rf"{_MARKED}\z"), F.lit(False)))
    return F.struct(
        x["order"].isNull().alias("late"), x["order"].alias("order"), F.coalesce(x["line_id"], F.lit("")).alias("_id"), x["line_id"].alias("line_id"), tokens.alias("tokens"),
        x["text"].isNotNull().alias("has_text"), mark.alias("mark"), x["column_no"].alias("column_no"), F.get(box, F.lit(0)).alias("left"),
        F.when(sound, (F.get(box, F.lit(1)) + F.get(box, F.lit(3))) / 2 / height).alias("place"), F.when(sound, (F.get(box, F.lit(3)) - F.get(box, F.lit(1))) / height).alias("tall"),
    )


def page_readings(pages: DataFrame) -> DataFrame:
    """Every reading of a page, kept in the scratch folder: id, reading (a hash), written_at,
    work, page_no, its lines in reading order (by `order`, then by line_id; null members
    are dropped), and which of them stands apart at the top and at the bottom.

    Rows that agree in id, fingerprint, time and all of their lines are one reading. Pages
    whose id isn't `<work>_<number>` have no number and are works of their own.
    """
    needed = ["line_id", "order", "column_no", "box", "text", "raw_text"]
    slim = F.transform(F.filter("lines", lambda x: x.isNotNull()), lambda x: F.struct(*[x[c].alias(c) for c in needed]))
    rows = pages.filter(F.size("lines") > 0).select("id", "fingerprint", "written_at", "page_size", slim.alias("lines"))
    rows = rows.withColumn("reading", F.xxhash64("fingerprint", "written_at", "page_size", "lines"))
    rows = rows.groupBy("id", "written_at", "reading").agg(F.first(F.struct("lines", "page_size")).alias("p"))
    height = F.when(F.size("p.page_size") == 2, F.get("p.page_size", F.lit(1)))
    number = F.regexp_extract("id", r"_([0-9]{1,9})\z", 1)
    lines = F.array_sort(F.transform("p.lines", lambda x: _line(x, height)))
    rows = rows.select("id", "reading", "written_at", F.when(number != "", F.regexp_extract("id", r"\A(.*)_[0-9]{1,9}\z", 1)).otherwise(F.col("id")).alias("work"), F.when(number != "", number.cast("int")).alias("page_no"), lines.alias("lines"))
    # The outermost lines by place; without boxes the first and the last one.
    spots = F.array_sort(F.filter(F.transform("lines", lambda x, i: F.struct(x["place"].alias("place"), x["tall"].alias("tall"), i.alias("i"))), lambda x: x["place"].isNotNull()))
    n = F.size("spots")
    tall = F.get(F.array_sort(F.transform("spots", lambda x: x["tall"])), F.floor(n / 2).cast("int"))
    rows = rows.withColumn("spots", spots).withColumn("_tall", tall)
    first, second, last, before = (F.get("spots", i) for i in (F.lit(0), F.lit(1), n - 1, n - 2))
    top = F.when(n == 0, F.lit(0)).when((n > 1) & (second["place"] - first["place"] > APART * F.col("_tall")), first["i"])
    bottom = F.when(n == 0, F.size("lines") - 1).when((n > 1) & (last["place"] - before["place"] > APART * F.col("_tall")), last["i"])
    rows = rows.withColumns({"top": top, "bottom": bottom})
    rows = rows.withColumns({f"{side}_place": F.get("lines", F.col(side))["place"] for side in ("top", "bottom")})
    kept = ("line_id", "tokens", "has_text", "mark", "column_no", "left")
    return settle(rows.withColumn("lines", F.transform("lines", lambda x: F.struct(*[x[c].alias(c) for c in kept]))).drop("spots", "_tall"), "readings")


def _header_key(tokens: Column) -> Column:
    """The letters of a header or footer without its numbers, confused characters the same."""
    seen, same = "".join(DIGIT_FORMS.values()), "".join(k * len(v) for k, v in DIGIT_FORMS.items())
    core = F.transform(tokens, lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    named = F.filter(core, lambda t: (t != "") & ~t.rlike(r"(?i)\A[ivxlc]+\z") & ~(t.rlike("[0-9]") & F.translate(t, seen, same).rlike(r"\A[0-9]+\z")))
    return F.regexp_replace(F.array_join(F.transform(named, lambda t: skeleton(F.lower(t))), ""), "[^a-z]", "")


#: A page number, decorated or not, with digits as they are misread.
NUMBER_LINE = r"\A[^\p{L}\p{N}|!]*(?:[Pp](?:age|\.)?\s+)?(?:[0-9ODolI|!iZzSsbGBgq]{1,4}|[ivxlcIVXLC]+)(?:\s*(?:/|of)\s*[0-9]+)?[^\p{L}\p{N}|!]*\z"


def page_furniture(readings: DataFrame) -> DataFrame:
    """(id, reading, spots): which lines of a reading, by their position, are a running header,
    a running footer or a page number. Readings without any have no row.

    Evidence is a text that lines at this edge of several pages of the work share - those at
    its outermost place, as a work's title stands further in on its first page - or a number
    at a place where several pages of the work have one. Without a sound box a number is
    evidence enough. A line without evidence counts if most lines at its place have some.
    """
    edges = F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("i"), F.get("lines", F.col(side))["tokens"].alias("tokens"), F.col(f"{side}_place").alias("place")) for side in ("top", "bottom")])
    rows = readings.select("id", "reading", "work", F.explode(F.filter(edges, lambda e: e["i"].isNotNull())).alias("e"))
    text = F.array_join("e.tokens", " ")
    rows = rows.select("id", "reading", "work", "e.side", "e.i", "e.place", text.rlike(NUMBER_LINE).alias("number"), _header_key(F.col("e.tokens")).alias("key"))
    rows = rows.withColumns({"edge": F.when(F.col("side") == "top", F.col("place")).otherwise(1 - F.col("place")), "at": F.floor(F.col("place") / STEP)})
    rows = settle(rows, "edges")
    named = rows.filter(~F.col("number") & (F.length("key") >= LEAST_LETTERS)).groupBy("work", "side", "key").agg(F.min("id").alias("_a"), F.max("id").alias("_b"), F.min("edge").alias("outer"))
    named = named.filter("_a < _b").select("work", "side", "key", "outer", F.lit(True).alias("_named"))
    page = F.when(F.col("number"), F.col("id"))
    numbers = rows.groupBy("work", "side", "at").agg(F.min(page).alias("_a"), F.max(page).alias("_b"), F.avg(F.col("number").cast("double")).alias("_part"))
    numbers = numbers.filter((F.col("_a") < F.col("_b")) & (F.col("_part") >= PLACE_SHARE)).select("work", "side", "at", F.lit(True).alias("_numbers"))
    told = rows.join(named, ["work", "side", "key"], "left").join(numbers, ["work", "side", "at"], "left")
    text_again = F.coalesce(F.col("_named") & (F.col("outer").isNull() | (F.col("edge") - F.col("outer") < STEP)), F.lit(False))
    number_again = F.col("number") & (F.coalesce("_numbers", F.lit(False)) | F.col("place").isNull())
    told = told.select("id", "reading", "side", "at", "i", (text_again | number_again).alias("again"))
    places = told.filter("at is not null").groupBy("side", "at").agg(F.avg(F.col("again").cast("double")).alias("_share"))
    found = told.join(places, ["side", "at"], "left").filter(F.col("again") | (F.coalesce("_share", F.lit(0.0)) >= PLACE_SHARE))
    return found.groupBy("id", "reading").agg(F.collect_set("i").alias("spots"))


def page_lines(pages: DataFrame) -> DataFrame:
    """One row a line of every page reading, kept in the scratch folder: id, reading, work,
    page_no, the line as _line gives it and its words, whether it is furniture, its place among the body
    lines (`seq`), and the first word and the id of the next body line, on this page or on
    the newest reading of the next (`next_word`, `next_line`)."""
    readings = page_readings(pages)
    spots = page_furniture(readings)
    rows = readings.select("id", "reading", "written_at", "work", "page_no", "lines").join(spots, ["id", "reading"], "left")
    rows = rows.withColumn("spots", F.coalesce("spots", F.array().cast("array<int>")))
    body = F.filter("lines", lambda x, i: ~F.array_contains("spots", i))
    head = F.get(body, F.lit(0))
    firsts = rows.filter(F.col("page_no").isNotNull()).select("work", "page_no", "written_at", "reading", head.alias("h")).filter("h is not null")
    firsts = firsts.select("work", (F.col("page_no") - 1).alias("page_no"), F.struct("written_at", "reading", first_word(F.col("h")).alias("w"), F.col("h.line_id").alias("line_id")).alias("f"))
    firsts = firsts.groupBy("work", "page_no").agg(F.max("f").alias("f")).select("work", "page_no", F.col("f.w").alias("_w"), F.col("f.line_id").alias("_l"))
    rows = rows.join(firsts, ["work", "page_no"], "left").withColumn("body", body)
    flagged = F.transform("lines", lambda x, i: F.struct(x.alias("l"), F.array_contains("spots", i).alias("furniture"), (i - F.size(F.filter("spots", lambda s: s < i))).alias("at")))
    rows = rows.select("id", "reading", "written_at", "work", "page_no", "body", "_w", "_l", F.explode(flagged).alias("x"))
    follower, last, own = F.get("body", F.col("x.at") + 1), F.col("x.at") + 1 >= F.size("body"), ~F.col("x.furniture")
    kept = [F.col(f"x.l.{c}").alias(c) for c in ("line_id", "tokens", "has_text", "mark", "column_no", "left")]
    return settle(
        rows.select(
            "id", "reading", "written_at", "work", "page_no", *kept, words_of(F.col("x.l.tokens"), F.col("x.l.mark")).alias("words"), "x.furniture", F.when(own, F.col("x.at")).otherwise(F.lit(-1)).alias("seq"),
            F.when(own, F.when(last, F.col("_w")).otherwise(first_word(follower))).alias("next_word"), F.when(own, F.when(last, F.col("_l")).otherwise(follower["line_id"])).alias("next_line"),
        ),
        "lines",
    )


# ---------------------------------------------------------------- words


def skeleton(word: Column) -> Column:
    """A word in lower case with confused characters made the same."""
    out = F.translate(word, *ACCENTS)
    for a, b in SEQUENCES:
        out = F.replace(out, F.lit(a), F.lit(b))
    seen = "".join(SINGLES.values())
    same = "".join(k * len(v) for k, v in SINGLES.items())
    return F.translate(out, seen, same)


def deletes(key: Column) -> Column:
    """The key and all forms that lack one character, but for the empty one."""
    n = F.length(key)
    one = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, n)))
    return F.when(n > 1, F.array_distinct(F.concat(F.array(key), one))).otherwise(F.array(key))


def _confusions() -> set[tuple[str, str]]:
    pairs = set()
    for a, b in SEQUENCES:
        pairs |= {(a, b), (b, a)}
    pairs |= {("m", "ni"), ("ni", "m")}
    for k, v in SINGLES.items():
        group = k + v
        pairs |= {(x, y) for x in group for y in group if x != y}
    pairs |= {(x, y) for x, y in zip(*ACCENTS)} | {(y, x) for x, y in zip(*ACCENTS)}
    return pairs


#: Confused pairs beyond one character on either side follow from the skeleton's steps:
#: both sides of a sequence may themselves be misread (an 'm' as 'r' and 'n' as 'ri').
CONFUSIONS = _confusions()


def weighted_distance(a: str, b: str, limit: float = 1.0) -> float:
    """Edit distance in which a confused pair costs CONFUSION_COST and any other insertion,
    deletion or replacement costs 1; infinity from `limit` on."""
    inf = float("inf")
    # Ends that are the same leave the distance as it is; two characters of them stay, as a
    # confused pair may reach into them.
    n = min(len(a), len(b))
    k = next((i for i in range(n) if a[i] != b[i]), n)
    a, b = a[max(0, k - 2) :], b[max(0, k - 2) :]
    n = min(len(a), len(b))
    k = next((i for i in range(n) if a[-1 - i] != b[-1 - i]), n)
    if k > 2:
        a, b = a[: len(a) - k + 2], b[: len(b) - k + 2]
    best = [[inf] * (len(b) + 1) for _ in range(len(a) + 1)]
    best[0][0] = 0.0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            now = best[i][j]
            if now >= limit:
                continue
            if i < len(a) and j < len(b):
                step = now if a[i] == b[j] else now + 1
                best[i + 1][j + 1] = min(best[i + 1][j + 1], step)
            if i < len(a):
                best[i + 1][j] = min(best[i + 1][j], now + 1)
            if j < len(b):
                best[i][j + 1] = min(best[i][j + 1], now + 1)
            for x in (1, 2):
                for y in (1, 2):
                    if i + x <= len(a) and j + y <= len(b) and (a[i : i + x], b[j : j + y]) in CONFUSIONS:
                        best[i + x][j + y] = min(best[i + x][j + y], now + CONFUSION_COST)
    return best[-1][-1] if best[-1][-1] < limit else inf


def _cost(word: str, repair: str) -> float:
    """The distance of a word, or of it without '(' before and '!' behind, to a repair."""
    cost, bare = weighted_distance(word, repair), word.lstrip("(").rstrip("!")
    return cost if bare == word else min(cost, weighted_distance(bare, repair))


@F.arrow_udf(T.DoubleType())
def _distances(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([_cost(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def figure(word: Column) -> Column:
    """A figure with misread digits as it was printed; null for other words. At least one
    digit must have been read as one."""
    seen = "".join(DIGIT_FORMS.values())
    same = "".join(k * len(v) for k, v in DIGIT_FORMS.items())
    # Words are in lower case: a capital B (8) and a small b (6) are no longer told apart.
    fixed = F.translate(word, seen.lower() + "|!", same + "11")
    return F.when(word.rlike(r"[0-9]") & word.rlike(r"[^0-9.,/:%-]") & fixed.rlike(r"\A[0-9]+([.,][0-9]+)*\z"), fixed)


def count_words(lines: DataFrame) -> DataFrame:
    """(word, n_inner, n_all): how often each word occurs inside lines, and anywhere.

    Compounds count as a whole and in their parts. Furniture doesn't count.
    """
    n = F.size("words")
    whole = lines.filter("not furniture").select(n.alias("_n"), F.posexplode("words").alias("_i", "word"), "mark", "has_text")
    whole = whole.filter("word <> ''")
    inner = ((F.col("_i") > 0) & (F.col("_i") < F.col("_n") - 1)).cast("int").alias("_inner")
    parts = whole.filter(F.contains("word", F.lit("-"))).select(F.explode(F.split("word", "-")).alias("word"), inner).filter("word <> ''")
    return settle(whole.select("word", inner).union(parts).groupBy("word").agg(F.sum("_inner").alias("n_inner"), F.count(F.lit(1)).alias("n_all")), "words")


def lexicon_words(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Every word of the corpus or lexicon with: n (inside lines), `fixed` (an ordinary
    word or a figure) and its skeleton."""
    fixed = lexicon.filter("word is not null").select(F.lower("word").alias("word"), F.lit(True).alias("_fixed")).distinct()
    rows = counts.join(fixed, "word", "full").select(
        "word", F.coalesce("n_inner", F.lit(0)).alias("n"), (F.coalesce("_fixed", F.lit(False)) | F.col("word").rlike(r"\A[0-9]+([.,/:%-]+[0-9]*)*\z")).alias("fixed")
    )
    return rows.withColumn("skeleton", skeleton(F.col("word")))


def candidates(words: DataFrame) -> DataFrame:
    """(word, fixed, n, repair, repair_fixed, repair_n, cost): for each word the words it
    may be a misreading of, from the symmetric-delete index. Figures are never repaired
    into other figures."""
    plain = ~F.col("word").rlike(r"\A[0-9.,/:%-]+\z")
    # Few bytes, but much work for each: kept from being joined into one partition.
    spark = words.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keyed = words.repartition(tasks, "word").withColumn("_key", F.explode(deletes(F.col("skeleton"))))
    index = keyed.filter("fixed or n >= 2").select("_key", F.col("word").alias("repair"), F.col("fixed").alias("repair_fixed"), F.col("n").alias("repair_n"))
    asked = keyed.filter(plain).select("_key", "word", "fixed", "n")
    pairs = asked.join(index, "_key").filter((F.col("word") != F.col("repair")) & (F.col("fixed") | F.col("repair_fixed") | (F.col("repair_n") >= RATIO * F.col("n"))))
    pairs = pairs.filter(~F.col("fixed") | F.col("repair_fixed")).drop("_key").distinct()
    return pairs.repartition(tasks).withColumn("cost", _distances("word", "repair")).filter("cost < 1")


def verdicts(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, repair, cost) of the unknown words that are misreadings; several rows where
    several repairs cost the same. A figure's repair is the figure as printed."""
    # A word explains an unknown one unless that is seen too often for its misreading.
    unknown = pairs.filter(f"not fixed and repair_n + if(repair_fixed, {ORDINARY_SEEN}, 0) >= greatest(2, {RATIO} * n)")
    # '(' and '!' may be punctuation or a misread letter: what is known without them is itself.
    bare = words.filter("fixed or n >= 2").select(F.col("word").alias("_bare"))
    outer = unknown.select("word").distinct().withColumn("_bare", F.regexp_replace("word", r"^\(+|!+$", "")).filter("_bare <> word")
    unknown = unknown.join(outer.join(bare, "_bare", "left_semi").select("word"), "word", "left_anti")
    least = unknown.groupBy("word").agg(F.min("cost").alias("cost"))
    chosen = unknown.join(least, ["word", "cost"]).select("word", "repair", "repair_n", "cost")
    figures = words.filter("not fixed").withColumn("repair", figure(F.col("word"))).filter("repair is not null")
    printed = words.select(F.col("word").alias("repair"), F.col("n").alias("_printed"))
    # A code such as B12 is one because it is seen more often than the figure it resembles.
    figures = figures.join(printed, "repair", "left").filter(F.coalesce("_printed", F.lit(0)) * 2 + 1 >= F.col("n"))
    figures = figures.select("word", "repair", F.coalesce("_printed", F.lit(0)).alias("repair_n"), F.lit(CONFUSION_COST).alias("cost"))
    return settle(chosen.union(figures).groupBy("word", "repair").agg(F.max("repair_n").alias("repair_n"), F.min("cost").alias("cost")), "verdicts")


# ---------------------------------------------------------------- broken words


def broken_lines(lines: DataFrame, words: DataFrame, misread: DataFrame) -> DataFrame:
    """(line_id, next_line, joined): body lines whose last word goes on in the next line.

    With a hyphen mark the word is broken unless it is known with the hyphen, or its two
    parts are words and the joined form isn't. Without one it is broken if the joined form
    is known and one of the parts is not. A form counts as known if misreading explains it.
    """
    known = words.filter("fixed or n >= 2").select("word", "skeleton")
    known = known.join(misread.select("word").distinct(), "word", "left_anti")
    forms = known.select("word").withColumn("_known", F.lit(True))
    bones = known.select("skeleton").distinct().withColumn("_bone", F.lit(True))
    ends = lines.filter("not furniture and size(words) > 0").select("line_id", "next_line", "mark", F.try_element_at("words", F.lit(-1)).alias("head"), "next_word")
    ends = ends.filter("head <> ''").withColumn("tail", F.coalesce("next_word", F.lit("")))
    # Sentence ends can't be broken words; most lines leave here or are joined once.
    ends = ends.withColumn("joined", F.concat("head", "tail")).withColumn("compound", F.concat_ws("-", "head", "tail"))
    for col, out in (("head", "head_known"), ("tail", "tail_known")):
        ends = ends.join(forms.select(F.col("word").alias(col), F.col("_known").alias(out)), col, "left")
    for col, out in (("joined", "joined_known"), ("compound", "compound_known")):
        ends = ends.withColumn("_s", skeleton(F.col(col))).join(bones.select(F.col("skeleton").alias("_s"), F.col("_bone").alias(out)), "_s", "left").drop("_s")
    ends = ends.na.fill(False, ["head_known", "tail_known", "joined_known", "compound_known"])
    has_next = F.col("tail") != ""
    with_mark = F.col("mark") & ~F.col("compound_known") & (F.col("joined_known") | ~(F.col("head_known") & F.col("tail_known") & has_next))
    without = ~F.col("mark") & has_next & F.col("joined_known") & ~(F.col("head_known") & F.col("tail_known"))
    return settle(ends.filter(with_mark | without).select("line_id", "next_line", "joined", "mark").distinct(), "broken")


def mend(tokens: list[str], fixes: dict[int, str], whole: str | None, led: bool) -> str:
    """A line's text: repairs in the case of what they replace and with its punctuation,
    a word broken at the end as a whole, and without the rest of one from the line before."""
    out = list(tokens)
    for pos, repair in fixes.items():
        if not 0 <= pos < len(out):
            continue
        lead = re.match(f"^[{_EDGE}]*", out[pos]).group()
        core = _STRIP.sub("", out[pos])
        rest = out[pos][len(lead) + len(core) :]
        if "-" in core and "-" not in repair:
            pieces = core.split("-")
            near = min(range(len(pieces)), key=lambda i: weighted_distance(pieces[i].lower(), repair))
            pieces[near] = like(repair, pieces[near])
            core = "-".join(pieces)
        else:
            core = like(repair, core)
        out[pos] = lead + core + rest
    if whole is not None and out:
        if out[-1].strip(MARKS) == "" and len(out) > 1:
            out.pop()
        lead = re.match(f"^[{_EDGE}]*", out[-1]).group()
        out[-1] = lead + like(whole, out[-1][len(lead) :])
    if led and out:
        tail = re.search(f"[{_EDGE}]*$", out[0]).group()
        out = out[1:]
        if tail:
            out.insert(0, tail)
    return " ".join(out)


def like(word: str, model: str) -> str:
    """`word` in the letter case of `model`."""
    letters = [c for c in model if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if model[:1].isupper() or (model[:1] in "|!1" and word[:1] == "i" and len(word) == 1) else word


@F.arrow_udf(T.StringType())
def _mended(tokens: pa.Array, fixes: pa.Array, whole: pa.Array, led: pa.Array) -> pa.Array:
    rows = zip(tokens.to_pylist(), fixes.to_pylist(), whole.to_pylist(), led.to_pylist())
    return pa.array([mend(t or [], {f["key"]: f["value"] for f in fs or []}, w, e) for t, fs, w, e in rows], pa.string())


# ---------------------------------------------------------------- misread words


def line_words(lines: DataFrame, broken: DataFrame) -> DataFrame:
    """(line_id, pos, word, previous, next) of body lines that have a `text`, but for the
    parts of broken words; compounds as a whole and in parts (with null neighbours)."""
    body = lines.filter("not furniture and has_text")
    cut = broken.select("line_id").distinct().withColumn("_cut", F.lit(True))
    led = broken.filter("next_line is not null").select(F.col("next_line").alias("line_id")).distinct().withColumn("_led", F.lit(True))
    body = body.join(cut, "line_id", "left").join(led, "line_id", "left")
    n = F.size("words")
    rows = body.select("line_id", "_cut", "_led", n.alias("_n"), "words", F.posexplode("words").alias("pos", "word"))
    rows = rows.filter(~(F.coalesce("_cut", F.lit(False)) & (F.col("pos") == F.col("_n") - 1)) & ~(F.coalesce("_led", F.lit(False)) & (F.col("pos") == 0)))
    rows = rows.select("line_id", "pos", "word", F.when(F.col("pos") > 0, F.get("words", F.col("pos") - 1)).alias("previous"), F.get("words", F.col("pos") + 1).alias("next"))
    parts = rows.filter(F.contains("word", F.lit("-"))).select("line_id", "pos", F.explode(F.split("word", "-")).alias("word"), F.lit(None).cast("string").alias("previous"), F.lit(None).cast("string").alias("next"))
    return rows.unionByName(parts).filter("word <> ''")


def context_errors(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(line_id, pos, repair): known words that stand where another known word, of which
    they may be a misreading, is far likelier by its neighbours. The odds are those of the
    neighbours given either word, the occurrence itself not counted, times the odds that
    an occurrence of the one is misread as the other."""
    twins = settle(pairs.filter("fixed and repair_fixed").groupBy("word", "repair").agg(F.max("n").alias("n"), F.max("repair_n").alias("repair_n")), "twins")
    involved = twins.select("word").union(twins.select("repair")).distinct()
    near = settle(rows.join(involved, "word", "left_semi"), "near")
    asked = near.join(twins, "word")
    odds = F.lit(MISREAD_SHARE) * (F.col("repair_n") + 1) / F.greatest(F.col("n"), F.lit(1))
    for side in ("previous", "next"):
        seen = near.filter(F.col(side).isNotNull()).groupBy(side, "word").agg(F.count(F.lit(1)).alias("c"))
        for col, out in (("word", f"_{side}_own"), ("repair", f"_{side}_other")):
            asked = asked.join(seen.select(side, F.col("word").alias(col), F.col("c").alias(out)), [side, col], "left")
        own = (F.greatest(F.coalesce(f"_{side}_own", F.lit(1)) - 1, F.lit(0)) + 0.5) / F.greatest(F.col("n"), F.lit(1))
        other = (F.coalesce(f"_{side}_other", F.lit(0)) + 0.5) / (F.col("repair_n") + 1)
        odds = odds * F.when(F.col(side).isNull(), 1.0).otherwise(other / own)
    return asked.filter(odds >= CONTEXT_ODDS).select("line_id", "pos", "repair")


def starting(body: DataFrame) -> DataFrame:
    """Body lines with whether a paragraph starts there: at an indented line, at a heading, or
    behind one. A heading is a short line of capitalised words behind a sentence's end, or a
    further line of a heading. Windows hold the lines of one page."""
    page = Window.partitionBy("id", "reading")
    order = page.orderBy("seq", "line_id")
    first, last = F.get("tokens", F.lit(0)), F.try_element_at("tokens", F.lit(-1))
    capitals = F.forall("tokens", lambda t: t.rlike(r"\A\p{Lu}") | (F.length(t) < 4))
    formed = (F.size("tokens").between(1, 5)) & first.rlike(r"\A\p{Lu}") & last.rlike(r"\p{L}\z") & capitals
    rows = body.withColumns({"_formed": F.coalesce(formed, F.lit(False)), "_stops": (F.size("tokens") == 0) | F.coalesce(last.rlike(r"[.?!:]\z"), F.lit(False)), "_margin": F.min("left").over(Window.partitionBy("id", "reading", "column_no"))})
    # A run of lines of that form is a heading if what is before it ends a sentence.
    rows = rows.withColumn("_opens", F.col("_formed") & ~F.coalesce(F.lag("_formed").over(order), F.lit(False))).withColumn("_free", F.coalesce(F.lag("_stops").over(order), F.lit(True)))
    rows = rows.withColumn("_run", F.sum(F.col("_opens").cast("int")).over(order))
    rows = rows.withColumn("_heading", F.col("_formed") & F.max(F.when(F.col("_opens"), F.col("_free"))).over(Window.partitionBy("id", "reading", "_run")))
    indent = F.coalesce(F.col("left") - F.col("_margin") >= 8, F.lit(False))
    starts = indent | F.col("_heading") | F.coalesce(F.lag("_heading").over(order), F.lit(False))
    return rows.withColumn("starts", F.coalesce(starts, F.lit(False))).drop("_formed", "_stops", "_margin", "_opens", "_free", "_run", "_heading")


class Repairs:
    """The stages over one corpus, each made once."""

    def __init__(self, pages: DataFrame, lexicon: DataFrame) -> None:
        self.lines = page_lines(pages)
        self.words = settle(lexicon_words(count_words(self.lines), lexicon), "lexicon")
        self.pairs = settle(candidates(self.words), "pairs")
        self.misread = verdicts(self.words, self.pairs)
        self.broken = broken_lines(self.lines, self.words, self.misread)
        self.rows = line_words(self.lines, self.broken)

    def errors(self) -> DataFrame:
        """(line_id, pos, repair) of all misread words in `text`s, repairs picked by bigram."""
        return self._picked().unionByName(context_errors(self.rows, self.pairs))

    def _picked(self) -> DataFrame:
        found = self.rows.join(self.misread, "word")
        # Several repairs of one cost: the one met more often behind the word before.
        several = self.misread.groupBy("word").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("word")
        goals = self.misread.join(several, "word", "left_semi").select("repair").distinct()
        pairs = self.rows.join(goals, F.col("word") == F.col("repair"), "left_semi").filter("previous is not null").groupBy("previous", F.col("word").alias("repair")).agg(F.count(F.lit(1)).alias("_c"))
        scored = found.join(pairs, ["previous", "repair"], "left")
        best = F.max_by("repair", F.struct(F.coalesce("_c", F.lit(0)), "repair_n", "repair"))
        return scored.groupBy("line_id", "pos").agg(best.alias("repair"))

    def paragraphs(self) -> DataFrame:
        """(work, paragraph_no, part_no, first_line, n_lines, text): running paragraphs in
        reading order, across columns and pages, without furniture, broken words joined and
        misread words repaired. Of several readings of a page the newest counts, of those of
        one time the one of the largest hash.

        A paragraph starts at an indented line, at a heading, or behind one. Pages whose id
        has no number stand for themselves. A paragraph of more than PART_LINES lines comes
        in parts, in order, so that none is gathered by one task.
        """
        newest = self.lines.groupBy("id").agg(F.max(F.struct("written_at", "reading")).alias("_newest"))
        fixes = self.errors().groupBy("line_id").agg(F.map_from_entries(F.collect_set(F.struct("pos", "repair"))).alias("fixes"))
        # Parts of a broken word are mended as one.
        mended = self.broken.join(self.misread.groupBy(F.col("word").alias("joined")).agg(F.max_by("repair", "repair_n").alias("_whole")), "joined", "left")
        cut = mended.groupBy("line_id").agg(F.max(F.coalesce("_whole", "joined")).alias("whole"))
        led = self.broken.filter("next_line is not null").select(F.col("next_line").alias("line_id")).distinct().withColumn("led", F.lit(True))
        body = starting(self.lines.filter("not furniture").join(newest, "id").filter(F.struct("written_at", "reading").eqNullSafe(F.col("_newest"))))
        body = body.dropDuplicates(["id", "line_id"]).na.fill({"page_no": 0})
        body = body.join(fixes, "line_id", "left").join(cut, "line_id", "left").join(led, "line_id", "left")
        text = _mended("tokens", F.map_entries(F.coalesce("fixes", F.create_map().cast("map<int,string>"))), "whole", F.coalesce("led", F.lit(False)))
        body = body.select("work", "page_no", "seq", "line_id", text.alias("text"), F.col("starts").cast("bigint").alias("_start"), F.lit(1).cast("bigint").alias("_one"), (F.col("page_no") / 64).cast("int").alias("_bin"))
        numbered = settle(running_totals(body, {"paragraph_no": "_start", "_line": "_one"}, "_bin", ["page_no", "seq", "line_id"], ["work"]), "numbered")
        begins = numbered.groupBy("work", "paragraph_no").agg(F.min("_line").alias("_from"))
        numbered = numbered.join(begins, ["work", "paragraph_no"]).withColumn("part_no", F.floor((F.col("_line") - F.col("_from")) / PART_LINES))
        rows = F.array_sort(F.collect_list(F.struct("page_no", "seq", "line_id", "text")))
        whole = numbered.groupBy("work", "paragraph_no", "part_no").agg(rows.alias("r"))
        parts = F.filter(F.transform("r", lambda x: x["text"]), lambda t: t != "")
        joined = F.regexp_replace(F.array_join(parts, " "), r" (?=[.,;:?!](?: |$))|(?<=[a-z]-) (?=[a-z])", "")
        return whole.select("work", "paragraph_no", "part_no", F.get("r", F.lit(0))["line_id"].alias("first_line"), F.size("r").alias("n_lines"), joined.alias("text"))

    def found(self) -> DataFrame:
        """(line_id, kind) as the project asks for it."""
        furniture = self.lines.filter("furniture").select("line_id", F.lit("furniture").alias("kind"))
        hyphen = self.broken.select("line_id", F.lit("hyphen").alias("kind"))
        misread = self.errors().select("line_id", F.lit("misread").alias("kind"))
        return furniture.union(hyphen).union(misread).distinct()
