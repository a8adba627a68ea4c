import random

from pyspark.sql import functions as F

from quire.functions import names
from quire.functions import text as tx
from quire.operators import phrases, spelling


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_blanks_as_python_knows_them(spark):
    odd = "  \t\x1c\x85 a​ \n"
    assert one(spark, odd, tx.strip_blanks) == odd.strip()
    assert one(spark, " ", tx.is_blank) and one(spark, None, tx.is_blank) and not one(spark, "a", tx.is_blank)


def test_ascii_form_and_steps(spark):
    assert one(spark, "“x”—ﬁ… é­", tx.ascii_form) == '"x"-fi... é-'
    assert one(spark, "aab  b", tx.ctc_steps) == 8 and one(spark, None, tx.ctc_steps) == 0
    assert one(spark, " a   b\n", tx.one_line) == "a b"
    assert not one(spark, "a\n", tx.printable_ascii) and one(spark, "a ~", tx.printable_ascii) and not one(spark, "", tx.printable_ascii)


def test_packing_phrases():
    assert phrases.pack("a few words that go on for longer than one phrase".split()) == ["a few words that go on for", "longer than one phrase"]
    assert phrases.pack(["a", "ü", "b"]) == ["a", "b"]
    assert phrases.pack(["x" * 3, "ab" * 20, "c"]) == ["xxx", "ab" * 20, "c"]
    assert phrases.pack(["z" * 30]) == [] and phrases.pack([]) == []
    rng = random.Random(1)
    for _ in range(200):
        words = ["".join(rng.choices("ab", k=rng.randint(1, 12))) for _ in range(rng.randint(0, 20))]
        packed = phrases.pack(words)
        kept = [w for w in words if phrases.steps_of(w) <= phrases.CAPACITY]
        assert " ".join(packed).split() == kept
        assert all(" " not in p or (len(p) <= 32 and phrases.steps_of(p) <= 40) for p in packed)


def test_edit_cost_properties():
    assert spelling.edit_cost("modern", "modem") == 0.35 and spelling.edit_cost("A", "a") == 0.2 and spelling.edit_cost("", "abc") == 3
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choices("rnmcldvw1lI0O", k=rng.randint(0, 7))) for _ in range(2))
        d = spelling.edit_cost(a, b)
        assert abs(d - spelling.edit_cost(b, a)) < 1e-9 and (d == 0) == (a == b) and d <= max(len(a), len(b))


def test_lexicon_lookup_matches_brute_force(spark):
    terms = ["cat", "cart", "coat", "dog", "modem", "modern"]
    lexicon = spark.createDataFrame([(w, len(w)) for w in terms], "word string, count long")
    words = ["cat", "modem", "cot", "zzz", "Carf"]
    got = {(r["word"], r["term"]): r["cost"] for r in spelling.lexicon_lookup(spark.createDataFrame([(w,) for w in words], "word string"), lexicon, max_edit=2).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {(w, t): spelling.edit_cost(w, t) for w in words for t in terms if lev(w.lower(), t) <= 2 and w.lower() != t}
    assert got == want


def unit_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_lexicon_lookup_as_registered_misses_nothing(spark):
    rng = random.Random(4)
    terms = sorted({"".join(rng.choices("abcdel", k=rng.randint(1, 12))) for _ in range(150)} | {"canvass", "moment"})
    words = ["cxnvxsx", "rnoment", "cnvs"]
    for t in rng.sample(terms, 60):
        w = list(t)
        for _ in range(rng.randint(1, 4)):
            at = rng.randint(0, len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "x"])
        words.append("".join(w) or "q")
    lexicon = spark.createDataFrame([(t, 1) for t in terms], "word string, count long")
    out = spelling.lexicon_lookup(spark.createDataFrame([(w,) for w in words], "word string"), lexicon, limit=1000)
    got = {(r["word"], r["term"]): r["cost"] for r in out.collect()}
    want = {(w, t): spelling.edit_cost(w, t) for w in set(words) for t in terms if unit_edits(w, t) <= 3 and w != t}
    assert got == want and ("cxnvxsx", "canvass") in got


def test_every_token_with_a_letter_is_looked_up(spark, tmp_path):
    from quire.plans.words import lexicon_topk

    texts = ["C0urt, 1ittle c@nvass 1832 - (Tha) court. zo", "the \u201cCourt\u201d c0urt\tof", None]
    kind = "id string, fingerprint string, written_at long, lines array<struct<line_id:string,text:string,order:int,column_no:int,box:array<int>,raw_text:string,status:string>>"
    spark.createDataFrame([("p", "f", 1, [(f"l{i}", t, i, 0, None, None, "ok") for i, t in enumerate(texts)])], kind).write.parquet(f"{tmp_path}/ocr_lines.parquet")
    spark.createDataFrame([(w, 1) for w in ("court", "little", "canvass", "the", "of", "to")], "word string, n_seen long").write.parquet(f"{tmp_path}/lexicon.parquet")
    got = {r["word"]: r["term"] for r in lexicon_topk(spark, str(tmp_path)).filter("rank = 1").collect()}
    assert got == {"c0urt": "court", "1ittle": "little", "c@nvass": "canvass", "tha": "the", "zo": "to"}


def test_names_and_flags(spark):
    assert one(spark, "ok.v1", names.safe_filename) == "ok.v1"
    for odd in ("con.txt", "a/b", "x.", "#1", ""):
        assert one(spark, odd, names.safe_filename).startswith("sample-")
    assert one(spark, "Here is the transcription [unclear] " + "一" * 21, names.review_flags) == ["possible_explanation", "unclear_spans", "unexpected_language"]
    cycle = [f"w{i}" for i in range(12)]
    assert one(spark, ["x"] + cycle * 4, names.repeat_tail, "array<string>") and not one(spark, cycle * 3, names.repeat_tail, "array<string>")
    assert not one(spark, None, names.repeat_tail, "array<string>")


def test_strict_replies():
    keys = {"text": "str"}
    assert names.read_strict('```json\n{"text": "a"}\n```', keys) == '{"text":"a"}'
    for bad in (None, "", '{"text": 1}', '{"text": "a"} x', '{"text": "a", "more": 1}', "{}", "```"):
        assert names.read_strict(bad, keys) is None
    assert names.read_strict('{"k": true}', {"k": "int"}) is None


def test_exclusion_reasons(spark):
    df = spark.createDataFrame([("ok", False, False), ("é", False, True), ("in", True, False), ("x" * 30, False, False), ("edge", False, True), ("quote“", None, None)], "w string, s boolean, o boolean")
    got = [r["r"] for r in df.select(phrases.exclusion(F.col("w"), F.col("s"), F.col("o")).alias("r")).collect()]
    assert got == [None, "unsupported_character", "watermark_geometry", "word_exceeds_ctc_capacity", "outside_or_partial_word", "outside_or_partial_word"]
    assert one(spark, "Downloaded BY x", phrases.is_watermark) and not one(spark, "downloads", phrases.is_watermark)
    stamp = spark.createDataFrame([([(0, 0, 5, 5)],)], "s array<struct<x0:int,y0:int,x1:int,y1:int>>")
    inside = stamp.select(phrases.in_stamp(F.lit(5), F.lit(0), F.col("s")).alias("a"), phrases.in_stamp(F.lit(6), F.lit(0), F.col("s")).alias("b")).first()
    assert (inside["a"], inside["b"]) == (True, False)


def test_near_terms_with_confusions_miss_nothing_within_the_cost(spark):
    rng = random.Random(5)
    terms = sorted({"".join(rng.choices("rnmcldvwaei", k=rng.randint(1, 14))) for _ in range(150)} | {"moment", "canvass"})
    words = {"rnornent", "cxnvxsy", "vvvvrnrnclcl", "q", "1owa"}
    for t in rng.sample(terms, 60):
        for a, b in rng.sample(spelling.BOTH_WAYS, 6):
            t = t.replace(a, b, rng.randint(0, 2))
        w = list(t)
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "x"])
        words.add("".join(w).lower() or "q")
    lexicon = spark.createDataFrame([(t, 1) for t in terms], "word string, count long")
    found = {(r["word"], r["term"]) for r in spelling.near_terms(spark.createDataFrame([(w,) for w in words] + [(None,)], "word string"), lexicon, confusions=True).collect()}
    want = {(w, t) for w in words for t in terms if w != t and (unit_edits(w, t) <= 3 or spelling.edit_cost(w, t) <= 3)}
    assert found == want and ("rnornent", "moment") in found


def test_phrases_with_places(spark):
    rng = random.Random(3)
    for _ in range(200):
        words = ["".join(rng.choices("ab", k=rng.randint(1, 12))) if rng.random() > 0.1 else None for _ in range(rng.randint(0, 20))]
        got = phrases.pack_places(words)
        assert all(text == " ".join(words[a : b + 1]) for text, a, b in got)
        assert [i for _, a, b in got for i in range(a, b + 1)] == [i for i, w in enumerate(words) if w is not None]
    kind = "document_number int, web_page string, block int, line int, word_no int, text string, x0 double, y0 double, x1 double, y1 double"
    w = lambda line, no, text, x: (4, "1", 0, line, no, text, x, 10.0 * line, x + 9.0, 10.0 * line + 8)
    rows = [w(1, 1, "two", 10.0), w(1, 0, "one", 0.0), w(1, 2, "一", 20.0), w(1, 3, "“x”", 30.0), w(2, 0, "Downloaded", 0.0), w(2, 1, "by me", 10.0), w(3, 0, "far", 95.0), w(4, 0, "stamped", 50.0), w(5, 0, None, 0.0), w(6, 0, "z" * 21, 0.0)]
    rows.append((14, "1", 0, 1, 0, "other", 0.0, 0.0, 1.0, 1.0))
    refs = spark.createDataFrame([("4", "1", 100.0, [(45.0, 50.0, 60.0, 60.0)], (0.0, 0.0, 100.0, 100.0))], "document_number string, web_page string, pdf_height double, stamps array<struct<x0:double,y0:double,x1:double,y1:double>>, crop struct<x0:double,y0:double,x1:double,y1:double>")
    page = phrases.page_words(spark.createDataFrame(rows, kind), refs)
    reasons = {(r["line"], r["word_no"]): r["reason"] for r in page.collect()}
    assert reasons == {(1, 0): None, (1, 1): None, (1, 2): "unsupported_character", (1, 3): None, (2, 0): "watermark_line", (2, 1): "watermark_line", (3, 0): "outside_or_partial_word", (4, 0): "watermark_geometry", (5, 0): "unsupported_character", (6, 0): "word_exceeds_ctc_capacity"}
    got = [tuple(r) for r in phrases.supervised_phrases(page).orderBy("phrase_no").collect()]
    assert got == [("4", "1", 0, "one two", [0.0, 10.0, 19.0, 18.0], 2), ("4", "1", 1, '"x"', [30.0, 10.0, 39.0, 18.0], 1)]
    assert {r["reason"] for r in phrases.word_audit(page).collect()} >= {"normalized_punctuation_or_ligature", "watermark_line"}
