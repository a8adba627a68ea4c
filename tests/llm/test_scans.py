import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import scans

S, I = T.StringType(), T.IntegerType()
LINE = T.StructType([T.StructField("line_id", S), T.StructField("order", I), T.StructField("column_no", I), T.StructField("box", T.ArrayType(I)), T.StructField("text", S), T.StructField("raw_text", S), T.StructField("extra", S)])
PAGES = T.StructType([T.StructField("id", S), T.StructField("fingerprint", S), T.StructField("written_at", I), T.StructField("page_size", T.ArrayType(I)), T.StructField("lines", T.ArrayType(LINE))])
ORDINARY = "the old garden was quiet and modern farmers relied on every system of water they carried through these fields of barley before winter came".split()


def page(name, texts, header="The Old Book", footer="- 7 -", at=1):
    rows = [(header, [80, 20, 400, 36])] + [(t, [30 if i else 44, 120 + 40 * i, 400, 136 + 40 * i]) for i, t in enumerate(texts)] + [(footer, [240, 738, 270, 752])]
    lines = [(f"{name}:l{i:04d}", i, 0, b, t if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], None) for i, (t, b) in enumerate(rows)]
    random.Random(1).shuffle(lines)
    return (name, f"f{name}{at}", at, [512, 768], lines)


@pytest.fixture(scope="module")
def repairs(spark):
    good = " ".join(ORDINARY)
    body = [page(f"2_{i:03d}", [good + f" Vortiv B12 {100 + i} long-term"] * 6) for i in range(1, 6)]
    pages = [
        page("1_001", ["the o1d gar-", "den was quiet and rnodern farmers re", "the system was quiet and long-", "term water carried by the sys-"]),
        page("1_002", ["tem of farmers in 18S0 was q", (None, "uiet and modern"), "on B12 Vort1v th~"]),
        page("1_003", ["ese fields (of barley) w@ter! end"]),
        page("1_003", ["ese fields (of barley) w@ter! end"]),
        ("bad", "f", 1, None, [(None, None, None, None, None, None, None), None]), ("void", "f", 1, None, None), ("none", "f", 1, [512, 768], []),
    ]
    df = spark.createDataFrame([*body, *pages], PAGES)
    lexicon = spark.createDataFrame([(w, 1) for w in [*ORDINARY, "by", "in", "long", "term", "end", "b", "system"]] + [(None, 1)], "word string, n_seen long")
    return scans.Repairs(df, lexicon)


def test_found(repairs):
    got = {tuple(r) for r in repairs.found().collect() if r["line_id"] and r["line_id"].startswith("1_")}
    body = {x for x in got if x[1] != "furniture"}
    assert {x[0] for x in got if x[1] == "furniture"} == {f"1_00{p}:l{n:04d}" for p, n in ((1, 0), (1, 5), (2, 0), (2, 4), (3, 0), (3, 2))}
    want = {("1_001:l0001", "misread"), ("1_001:l0001", "hyphen"), ("1_001:l0002", "misread"), ("1_001:l0004", "hyphen"), ("1_002:l0001", "misread"), ("1_002:l0001", "hyphen"), ("1_002:l0003", "misread"), ("1_002:l0003", "hyphen"), ("1_003:l0001", "misread")}
    # 're' | 'the system' isn't a broken word, 'long-' | 'term' keeps its hyphen
    assert body == want


def test_paragraphs(repairs):
    text = " ".join(r["text"] for r in repairs.paragraphs().filter("work = '1'").orderBy("paragraph_no").collect())
    assert "the old garden was quiet and modern farmers" in text and "long-term water carried by the system of farmers in 1850 was quiet" in text
    assert "on B12 Vortiv these fields (of barley)" in text and "Old Book" not in text and "- 7 -" not in text


def boxed(name, lines, at=1):
    """A page of (text, y) lines."""
    rows = [(f"{name}:l{i:04d}", i, 0, [30, y - 8, 400, y + 8] if y is not None else None, t, t, None) for i, (t, y) in enumerate(lines)]
    return (name, f"f{name}{at}", at, [512, 768], rows)


BODY = [(f"the old garden was quiet {k} and modern", 150 + 24 * k) for k in range(10)]


def furniture(spark, pages):
    df = spark.createDataFrame(pages, PAGES)
    return {(r["id"], i) for r in scans.page_furniture(scans.page_readings(df)).collect() for i in r["spots"]}


def test_furniture_is_told_by_repetition(spark):
    head = ["Winter Fields", "Winter Fie1ds", "Winter F", "Barley and Oats", "Barley and 0ats"]
    pages = [boxed("7_001", [("Winter Fields", 90), *BODY, ("- 1 -", 745)])]
    pages += [boxed(f"7_{i + 2:03d}", [(f"{h} {i + 2}", 30), *BODY, (n, 745)]) for i, (h, n) in enumerate(zip(head, ["- 2 -", "- B -", "p. 4", "[S]", "- 6 -"]))]
    # the title on the first page stays; cut and misread headers count by their place
    assert furniture(spark, pages) == {("7_001", 11)} | {(f"7_{i:03d}", k) for i in range(2, 7) for k in (0, 11)}
    # body lines that stand in the same bands, without a gap or without recurring, are body
    full = [boxed(f"8_{i:03d}", [(f"{w} was carried by farmers", 20 + 24 * k) for k, w in enumerate(f"one{i} two{i} three{i} four{i} five{i}".split())]) for i in range(1, 5)]
    alone = [boxed(f"9_{i:03d}", [(f"{w} of every winter", 20), *BODY]) for i, w in enumerate(["Water", "System", "Relied", "Quiet"], 1)]
    assert furniture(spark, full + alone) == set()
    # figures at a place where the work mostly has text are no page numbers
    figures = [boxed(f"5_{i:03d}", [("1871" if i in (2, 4) else f"{w} came before", 90), *BODY]) for i, w in enumerate("water fields barley winter carried system".split(), 1)]
    assert furniture(spark, figures) == set()


def test_furniture_without_boxes(spark):
    pages = [boxed(f"6_{i:03d}", [("Winter Fields", None), ("the old garden", None), (f"word{i} was quiet", None), (f"- {i} -", None)]) for i in (1, 2)]
    assert furniture(spark, pages) == {(f"6_{i:03d}", k) for i in (1, 2) for k in (0, 3)}
    assert furniture(spark, [("x", "f", 1, None, None), ("y", "f", 1, [512, 768], []), ("z_1", "f", 1, [512], [(None, None, None, [1, 2], None, None, None)])]) == set()


def test_readings_of_one_key_but_other_lines_both_count(spark):
    a, b = boxed("3_001", [("the garden", 200)]), boxed("3_001", [("the fields", 200)])
    df = spark.createDataFrame([a, b, a], PAGES)
    assert scans.page_readings(df).count() == 2
    whole = scans.Repairs(df, spark.createDataFrame([("the", 1)], "word string, n_seen long")).paragraphs()
    assert whole.count() == 1 and whole.first()["n_lines"] == 1


def test_context_tells_words_misread_into_words(spark):
    """'burn' misread as 'bum', which is a word too, stands out by its neighbours."""
    lines = ["men burn the old wood now"] * 300 + ["a poor bum sat in town"] * 40
    pages = [boxed(f"2_{i:03d}", [(t, 150 + 24 * k) for k, t in enumerate(lines[i * 20 : i * 20 + 20])]) for i in range(17)]
    pages.append(boxed("2_900", [("men bum the old wood now", 150), ("a poor bum sat in town", 174)]))
    lexicon = spark.createDataFrame([(w, 1) for w in "men burn the old wood now a poor bum sat in town".split()], "word string, n_seen long")
    repairs = scans.Repairs(spark.createDataFrame(pages, PAGES), lexicon)
    assert [tuple(r) for r in repairs.errors().collect()] == [("2_900:l0000", 1, "burn")]


def test_context_picks_among_repairs_of_one_cost(spark):
    lines = ["the cat came home again"] * 30 + ["an oat field grew tall"] * 30
    pages = [boxed(f"2_{i:03d}", [(t, 150 + 24 * k) for k, t in enumerate(lines[i * 10 : i * 10 + 10])]) for i in range(6)]
    pages.append(boxed("2_900", [("the ca7 came home again", 150), ("an 0at field grew tall", 174), ("the @at of c@t", 198)]))
    lexicon = spark.createDataFrame([(w, 1) for w in "the cat came home again an oat field grew tall of".split()], "word string, n_seen long")
    got = {tuple(r) for r in scans.Repairs(spark.createDataFrame(pages, PAGES), lexicon).errors().collect()}
    assert ("2_900:l0001", 1, "oat") in got and ("2_900:l0002", 3, "cat") in got


def test_long_paragraphs_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(scans, "PART_LINES", 16)
    pages = [boxed(f"2_{i:03d}", [(f"word{i} and more{k} of the same", 150 + 24 * k) for k in range(10)]) for i in range(1, 6)]
    rows = scans.Repairs(spark.createDataFrame(pages, PAGES), spark.createDataFrame([("the", 1)], "word string, n_seen long")).paragraphs().orderBy("part_no").collect()
    assert [(r["part_no"], r["n_lines"]) for r in rows] == [(0, 16), (1, 16), (2, 16), (3, 2)] and len({r["paragraph_no"] for r in rows}) == 1
    assert " ".join(r["text"] for r in rows).split()[:3] == ["word1", "and", "more0"] and sum(r["text"].count("same") for r in rows) == 50


def test_deletes_and_skeletons(spark):
    df = spark.createDataFrame([("modern",), ("modem",), ("o1d",), ("old",), ("",), ("a",)], "w string")
    got = {r["w"]: (r["s"], r["d"]) for r in df.select("w", scans.skeleton(F.col("w")).alias("s"), scans.deletes(F.col("w")).alias("d")).collect()}
    assert got["modern"][0] == got["modem"][0] and got["o1d"][0] == got["old"][0]
    assert set(got["modem"][1]) == {"modem", "odem", "mdem", "moem", "modm", "mode"} and set(got["old"][1]) == {"old", "od", "ld", "ol"} and got[""][1] == [""] and got["a"][1] == ["a"]


def test_the_index_meets_confused_words_of_all_lengths(spark):
    """Recall of the candidate index against weighing all pairs, short words included."""
    rng = random.Random(12)
    words = {"".join(rng.choices("rnmlihcdovweats", k=k)) for k in (2, 3, 3, 4, 4, 5, 6, 7, 8, 9) for _ in range(12)}
    pairs = sorted(p for p in scans.CONFUSIONS if p[0].isascii() and p[1].isascii())

    def misread(w):
        for _ in range(rng.randint(1, 2)):
            fits = [(i, a, b) for a, b in pairs for i in range(len(w)) if w.startswith(a, i)]
            i, a, b = rng.choice(fits)
            w = w[:i] + b + w[i + len(a) :]
        return w

    asked = {misread(w) for w in words for _ in range(2) if any(a in w for a, _ in pairs)} - words
    df = spark.createDataFrame([(w, 0, w in words) for w in words | asked], "word string, n long, fixed boolean").withColumn("skeleton", scans.skeleton(F.col("word")))
    got = {(r["word"], r["repair"]) for r in scans.candidates(df).collect()}
    want = {(a, b) for a in asked for b in words if scans._cost(a, b) < 1 and re.search("[a-z]", a)}
    assert len(want) > 150
    short = {x for x in want if len(x[0]) < 5}
    assert len(got & want) >= 0.97 * len(want) and len(got & short) >= 0.97 * len(short)


def test_distance_is_a_shortest_path():
    d = scans.weighted_distance
    assert d("rnodern", "modern") == pytest.approx(0.15) and d("th@t", "that") == pytest.approx(0.15) and d("urbamsation", "urbanisation") == pytest.approx(0.15)
    assert d("abc", "abd") == float("inf") and d("", "") == 0 and d("same", "same") == 0

    def brute(a, b):
        if not a or not b:
            return len(a) + len(b)
        best = min(brute(a[1:], b) + 1, brute(a, b[1:]) + 1, brute(a[1:], b[1:]) + (a[0] != b[0]))
        for x in (1, 2):
            for y in (1, 2):
                if len(a) >= x and len(b) >= y and (a[:x], b[:y]) in scans.CONFUSIONS:
                    best = min(best, brute(a[x:], b[y:]) + scans.CONFUSION_COST)
        return best

    rng = random.Random(6)
    for _ in range(60):
        a, b = ("".join(rng.choices("rnmli1he", k=rng.randint(0, 4))) for _ in range(2))
        assert d(a, b, 99) == pytest.approx(brute(a, b))


def test_empty(spark):
    none = scans.Repairs(spark.createDataFrame([], PAGES), spark.createDataFrame([], "word string, n_seen long"))
    assert none.found().count() == 0 and none.paragraphs().count() == 0
