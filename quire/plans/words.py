"""Queries over words and texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import names
from quire.functions import text as tx
from quire.operators import phrases, spelling
from quire.plans.records import _LINES, _lines
from quire.sources.tables import spread, table


def phrase_audit(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of all texts fall to each reason, and how many are kept as they are
    or in ASCII form."""
    w = phrases.words_of(spread(table(spark, folder, "documents").select("doc_id", "text")), ["doc_id"], "text")
    reason = F.coalesce(phrases.exclusion(F.col("word")), F.when(tx.ascii_form(F.col("word")) != F.col("word"), "normalized_punctuation_or_ligature").otherwise("kept"))
    return w.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("words"))


def phrase_pack(spark: SparkSession, folder: str) -> DataFrame:
    out = phrases.phrases(spread(table(spark, folder, "documents").select("doc_id", "text")), ["doc_id"], "text")
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("phrases"), F.max(F.length("phrase")).alias("longest"), F.sum(tx.ctc_steps(F.col("phrase"))).alias("steps"))


def alphabet_gate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter(F.col("text").rlike(r"\A[\x20-\x7E\n]*\z")).select("doc_id")


def word_steps(spark: SparkSession, folder: str) -> DataFrame:
    w = phrases.words_of(table(spark, folder, "labels").select("text").distinct(), ["text"], "text").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return w.select("word", "n", tx.ctc_steps(F.col("word")).alias("steps"))


def review_flags(spark: SparkSession, folder: str) -> DataFrame:
    d = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.array_join(names.review_flags(F.col("text")), ",").alias("flags"))


def safe_filename(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "samples").select(F.col("document_id").alias("raw")).filter("raw is not null").distinct()
    return s.select("raw", names.safe_filename(F.col("raw")).alias("name"))


def page_number(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "samples").select("id", "page").distinct()
    return s.select("id", "page", names.page_number(F.col("id"), F.col("page")).alias("number"))


def repeat_tail(spark: SparkSession, folder: str) -> DataFrame:
    """Texts whose last words run in a cycle, among all texts and four-fold ones."""
    d = spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", F.filter(F.split("text", r"[ \n]+"), lambda w: w != "").alias("w"))
    looped = d.filter(F.size("w").between(12, 100)).select("doc_id", F.flatten(F.array_repeat("w", 4)).alias("w"), F.lit(True).alias("repeated"))
    both = d.select("doc_id", "w", F.lit(False).alias("repeated")).union(looped)
    return both.filter(names.repeat_tail(F.col("w"))).select("doc_id", "repeated")


def strict_props(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_id", names.strict_reply(F.col("props"), {"k": "int"}).alias("r"))
    return e.select("event_id", F.col("r.ok").alias("ok"), F.get_json_object("r.value", "$.k").cast("bigint").alias("k"))


def word_split(spark: SparkSession, folder: str) -> DataFrame:
    lexicon = table(spark, folder, "lexicon").select("word")
    return spelling.word_splits(lexicon, lexicon)


def word_merge(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _neighbours(spark, folder)
    return spelling.word_merges(pairs, table(spark, folder, "lexicon").select("word")).groupBy("merged").agg(F.count(F.lit(1)).alias("n"))


def _neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring words of page lines, and the halves of lexicon words that are words."""
    w = F.split(F.col("text"), " ")
    lines = _lines(spark, folder).filter("text is not null").select(w.alias("w")).filter(F.size("w") > 1)
    both = F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))
    halves = word_split(spark, folder).select(F.col("head").alias("a"), F.col("tail").alias("b"))
    return lines.select(F.explode(both).alias("p")).select(F.col("p.a").alias("a"), F.col("p.b").alias("b")).union(halves)


def confusion_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.confusion_variants(table(spark, folder, "lexicon").select("word"), "word")


def case_like(spark: SparkSession, folder: str) -> DataFrame:
    w = table(spark, folder, "lexicon").select("word")
    forms = w.select("word", F.explode(F.array(F.upper("word"), F.initcap("word"), F.col("word"))).alias("original"))
    return forms.distinct().select("word", "original", spelling.case_like(F.lit("sample"), F.col("original")).alias("out"))


def weighted_edit(spark: SparkSession, folder: str) -> DataFrame:
    v = spelling.confusion_variants(table(spark, folder, "lexicon").select("word"), "word")
    return v.select("word", "variant", spelling.weighted_edit(F.col("word"), F.col("variant")).alias("cost"))


def lexicon_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The lexicon words nearest to each word of the page lines that isn't one. Words are
    all tokens with a letter, in lower case and without signs at their ends."""
    lexicon = table(spark, folder, "lexicon").select("word", F.col("n_seen").alias("count"))
    tokens = _lines(spark, folder).filter("text is not null").select(F.explode(F.split("text", r"(?U)\s+")).alias("word")).filter(F.col("word").rlike(r"\p{L}")).distinct()
    words = tokens.select(F.lower(F.regexp_replace("word", r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$", "")).alias("word"))
    unknown = words.join(lexicon.select(F.lower("word").alias("word")), "word", "left_anti")
    return spelling.lexicon_lookup(unknown, lexicon)


def lexicon_near(spark: SparkSession, folder: str) -> DataFrame:
    """How many lexicon words are within three edits of each word of the page lines."""
    lexicon = table(spark, folder, "lexicon").select("word", F.col("n_seen").alias("count"))
    words = _lines(spark, folder).filter("text is not null").select(F.explode(F.split("text", " ")).alias("t")).select(F.lower("t").alias("word")).filter("word <> ''").distinct()
    return spelling.near_terms(words, lexicon).groupBy("word").agg(F.count(F.lit(1)).alias("terms"))


def _page_words(spark: SparkSession, folder: str) -> DataFrame:
    """Page lines as words with boxes: the box of a line shared out by characters, all pages with
    one stamp in the corner and a crop that leaves a margin. Some lines are marked."""
    lines = _lines(spark, folder).filter((F.size("box") == 4) & (F.coalesce("text", "raw_text") != ""))
    b = [F.get("box", F.lit(i)).cast("double") for i in range(4)]
    said = F.when(F.col("line_id").endswith("7"), F.concat(F.lit("Downloaded by "), F.coalesce("text", "raw_text"))).otherwise(F.coalesce("text", "raw_text"))
    rows = lines.select("id", "ord", said.alias("t"), *[x.alias(n) for x, n in zip(b, ("a", "y0", "z", "y1"))]).select("*", F.posexplode(F.split("t", " ")).alias("word_no", "text"))
    at = F.coalesce(F.length(F.array_join(F.slice(F.split("t", " "), F.lit(1), F.col("word_no")), " ")) + (F.col("word_no") > 0).cast("int"), F.lit(0))
    unit = (F.col("z") - F.col("a")) / F.length("t")
    return rows.select(
        F.split_part("id", F.lit("_"), F.lit(1)).alias("document_number"), F.split_part("id", F.lit("_"), F.lit(2)).alias("web_page"), F.lit(0).alias("block"), F.col("ord").alias("line"), "word_no", "text",
        (F.col("a") + at * unit).alias("x0"), "y0", (F.col("a") + (at + F.length("text")) * unit).alias("x1"), "y1",
    )


def _references(words: DataFrame) -> DataFrame:
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"))])
    return words.select("document_number", "web_page").distinct().select("*", F.lit(768.0).alias("pdf_height"), F.array(box(300, 568, 512, 768)).alias("stamps"), box(20, 0, 450, 768).alias("crop"))


def page_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document by what is said of them."""
    words = _page_words(spark, folder)
    return phrases.word_audit(phrases.page_words(words, _references(words))).groupBy("document_number", "reason").agg(F.count(F.lit(1)).alias("words"))


def page_phrases(spark: SparkSession, folder: str) -> DataFrame:
    words = _page_words(spark, folder)
    found = phrases.supervised_phrases(phrases.page_words(words, _references(words)))
    return found.select("document_number", "web_page", "phrase_no", "text", F.transform("box", lambda v: F.round(v, 4)).alias("box"), "n_words")


def phrase_words(spark: SparkSession, folder: str) -> DataFrame:
    """Words that phrases of each document hold: all that nothing is said against."""
    return page_phrases(spark, folder).groupBy("document_number").agg(F.sum("n_words").alias("words"), (F.max(F.length("text")) <= 40).alias("within"))


_T1 = "replace(replace(replace(replace(replace(replace(translate(word, '‘’‚‛“”„‟‐‑‒–—−' || chr(173) || chr(160), repeat(chr(39), 4) || repeat(chr(34), 4) || '------- '), '…', '...'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl')"
_PAIRS = "(VALUES ('rn','m'),('m','rn'),('cl','d'),('d','cl'),('vv','w'),('w','vv'),('1','l'),('l','1'),('1','I'),('I','1'),('0','O'),('O','0')) AS c(a, b)"

_BREAK = "chr(10)"
_STEPS = "length({x}) + len(list_filter(range(1, length({x})), lambda i: {x}[i] = {x}[i + 1]))"

_PAGE_WORDS = f"""WITH {_LINES}, t AS (SELECT id, line_id, ord, box, CASE WHEN ends_with(line_id, '7') THEN 'Downloaded by ' || coalesce(text, raw_text) ELSE coalesce(text, raw_text) END AS t
          FROM lines WHERE len(box) = 4 AND coalesce(text, raw_text) <> ''),
        s AS (SELECT *, string_split(t, ' ') AS ws, (box[3] - box[1])::DOUBLE / length(t) AS unit FROM t),
        w AS (SELECT *, ws[k] AS word, CASE WHEN k > 1 THEN length(array_to_string(ws[1:k - 1], ' ')) + 1 ELSE 0 END AS pos FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM s)),
        p AS (SELECT split_part(id, '_', 1) AS document_number, t, word, {_T1} AS plain, box[1] + pos * unit AS x0, box[1] + (pos + length(word)) * unit AS x1, box[2]::DOUBLE AS y0, box[4]::DOUBLE AS y1 FROM w),
        r AS (SELECT document_number, CASE WHEN contains(lower(t), 'downloaded by') OR contains(lower(t), 'document shared on') THEN 'watermark_line'
          WHEN (x0 + x1) / 2 BETWEEN 300 AND 512 AND 768 - (y0 + y1) / 2 BETWEEN 568 AND 768 THEN 'watermark_geometry'
          WHEN NOT regexp_full_match(plain, '[\\x20-\\x7E]+') THEN 'unsupported_character'
          WHEN NOT (x0 >= 20 AND y0 >= 0 AND x1 <= 450 AND y1 <= 768) THEN 'outside_or_partial_word'
          WHEN {_STEPS.format(x="plain")} > 40 THEN 'word_exceeds_ctc_capacity'
          WHEN plain <> word THEN 'normalized_punctuation_or_ligature' END AS reason FROM p)"""

SQL = {
    "page_audit": f"{_PAGE_WORDS} SELECT document_number, reason, count(*) AS words FROM r WHERE reason IS NOT NULL GROUP BY document_number, reason",
    "phrase_words": f"{_PAGE_WORDS} SELECT document_number, count(*) AS words, true AS within FROM r WHERE coalesce(reason, 'normalized_punctuation_or_ligature') = 'normalized_punctuation_or_ligature' GROUP BY document_number",
    "phrase_pack": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
        w AS (SELECT doc_id, n, unnest(regexp_extract_all(line, '[^ \\t\\n\\x0b\\f\\r]+')) AS word, generate_subscripts(regexp_extract_all(line, '[^ \\t\\n\\x0b\\f\\r]+'), 1) AS k FROM l),
        p AS (SELECT doc_id, n, k, {_T1} AS x FROM w),
        g AS (SELECT doc_id, n, list(CASE WHEN regexp_full_match(x, '[\\x20-\\x7E]+') AND {_STEPS.format(x="x")} <= 40 THEN x ELSE chr(1) END ORDER BY k) AS ws FROM p GROUP BY doc_id, n),
        f AS (SELECT doc_id, list_reduce(list_prepend('', ws), lambda acc, x: CASE WHEN x = chr(1) THEN acc || {_BREAK} WHEN split_part(acc, {_BREAK}, -1) = '' THEN acc || x
            WHEN length(split_part(acc, {_BREAK}, -1) || ' ' || x) <= 32 AND {_STEPS.format(x="(split_part(acc, chr(10), -1) || ' ' || x)")} <= 40 THEN acc || ' ' || x ELSE acc || {_BREAK} || x END) AS out FROM g),
        s AS (SELECT doc_id, unnest(list_filter(string_split(out, {_BREAK}), lambda s: s <> '')) AS x FROM f)
        SELECT doc_id, count(*) AS phrases, max(length(x)) AS longest, sum({_STEPS.format(x="x")})::BIGINT AS steps FROM s GROUP BY doc_id""",
    "repeat_tail": """WITH d AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\n]+'), lambda w: w <> '') AS w FROM documents),
        b AS (SELECT doc_id, w, false AS repeated FROM d UNION ALL SELECT doc_id, list_concat(list_concat(w, w), list_concat(w, w)), true FROM d WHERE len(w) BETWEEN 12 AND 100)
        SELECT doc_id, repeated FROM b WHERE len(list_filter(range(12, least(128, len(w) // 4) + 1), lambda p: w[len(w) - p + 1:len(w)] = w[len(w) - 2 * p + 1:len(w) - p]
            AND w[len(w) - p + 1:len(w)] = w[len(w) - 3 * p + 1:len(w) - 2 * p] AND w[len(w) - p + 1:len(w)] = w[len(w) - 4 * p + 1:len(w) - 3 * p])) > 0""",
    "weighted_edit": f"""SELECT DISTINCT word, left(word, i - 1) || b || substr(word, i + length(a)) AS variant, 0.35::DOUBLE AS cost FROM (SELECT word, a, b, unnest(range(1, length(word) + 1)) AS i FROM lexicon, {_PAIRS}) WHERE substr(word, i, length(a)) = a AND regexp_matches(word, '[A-Za-z]')""",
    "lexicon_near": f"""WITH {_LINES}, w AS (SELECT DISTINCT lower(t) AS word FROM (SELECT unnest(string_split(text, ' ')) AS t FROM lines WHERE text IS NOT NULL) WHERE t <> '')
        SELECT w.word, count(*) AS terms FROM w JOIN lexicon l ON w.word <> lower(l.word) AND levenshtein(w.word, lower(l.word)) <= 3 GROUP BY w.word""",
    "phrase_audit": f"""WITH w AS (SELECT unnest(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')) AS word FROM documents), p AS (SELECT word, {_T1} AS plain FROM w)
        SELECT CASE WHEN NOT regexp_full_match(plain, '[\\x20-\\x7E]+') THEN 'unsupported_character'
          WHEN length(plain) + len(list_filter(range(1, length(plain)), lambda i: plain[i] = plain[i + 1])) > 40 THEN 'word_exceeds_ctc_capacity'
          WHEN plain <> word THEN 'normalized_punctuation_or_ligature' ELSE 'kept' END AS reason, count(*) AS words FROM p GROUP BY 1""",
    "alphabet_gate": "SELECT doc_id FROM documents WHERE regexp_full_match(text, '[\\x20-\\x7E\\n]*')",
    "word_steps": "SELECT word, count(*) AS n, length(word) + len(list_filter(range(1, length(word)), lambda i: word[i] = word[i + 1])) AS steps FROM (SELECT unnest(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')) AS word FROM (SELECT DISTINCT text FROM labels)) GROUP BY word",
    "review_flags": """SELECT doc_id, array_to_string(list_filter([
        CASE WHEN regexp_matches(lower(text), 'i cannot|i can''t|i am unable|i''m unable|as an ai|the image is too|the text is too blurred|here is the transcription') THEN 'possible_explanation' END,
        CASE WHEN contains(lower(text), '[unclear]') THEN 'unclear_spans' END,
        CASE WHEN length(regexp_replace(text, '[^一-鿿]', '', 'g')) > 20 THEN 'unexpected_language' END], lambda x: x IS NOT NULL), ',') AS flags FROM documents""",
    "safe_filename": """SELECT raw, CASE WHEN regexp_full_match(raw, '[A-Za-z0-9][A-Za-z0-9_.-]{0,100}') AND NOT regexp_matches(raw, '[. ]$') AND NOT regexp_full_match(upper(split_part(raw, '.', 1)), 'CON|PRN|AUX|NUL|COM[0-9]|LPT[0-9]')
        THEN raw ELSE 'sample-' || left(sha256('"' || raw || '"'), 16) END AS name FROM (SELECT DISTINCT document_id AS raw FROM samples WHERE document_id IS NOT NULL)""",
    "page_number": "SELECT DISTINCT id, page, coalesce(CASE WHEN page > 0 THEN page END, CASE WHEN page IS NULL THEN nullif(try_cast(nullif(regexp_extract(id, '^[^_]*_([0-9]+)', 1), '') AS BIGINT), 0) END) AS number FROM samples",
    "strict_props": "SELECT event_id, true AS ok, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "word_split": "SELECT a.word AS word, b.word AS head, c.word AS tail FROM lexicon a JOIN lexicon b ON length(b.word) < length(a.word) AND starts_with(a.word, b.word) JOIN lexicon c ON a.word = b.word || c.word",
    "word_merge": f"""WITH {_LINES}, t AS (SELECT string_split(text, ' ') AS w FROM lines WHERE text IS NOT NULL), p AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: lower(w[i] || w[i + 1]))) AS merged, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS both_words FROM t
        UNION ALL SELECT a.word, b.word || ' ' || c.word FROM lexicon a JOIN lexicon b ON length(b.word) < length(a.word) AND starts_with(a.word, b.word) JOIN lexicon c ON a.word = b.word || c.word)
        SELECT merged, count(*) AS n FROM p WHERE merged IN (SELECT word FROM lexicon) AND regexp_full_match(both_words, '[A-Za-z]+ [A-Za-z]+') GROUP BY merged""",
    "confusion_variants": f"""SELECT DISTINCT word, left(word, i - 1) || b || substr(word, i + length(a)) AS variant FROM (SELECT word, a, b, unnest(range(1, length(word) + 1)) AS i FROM lexicon, {_PAIRS}) WHERE substr(word, i, length(a)) = a AND regexp_matches(word, '[A-Za-z]')""",
    "case_like": """SELECT DISTINCT word, original, CASE WHEN original = upper(original) THEN 'SAMPLE' WHEN original = upper(left(original, 1)) || lower(substr(original, 2)) THEN 'Sample' ELSE 'sample' END AS out
        FROM (SELECT word, unnest([upper(word), upper(left(word, 1)) || lower(substr(word, 2)), word]) AS original FROM lexicon)""",
}

ALL = (
    phrase_audit, phrase_pack, alphabet_gate, word_steps, review_flags, safe_filename, page_number, repeat_tail, strict_props, word_split, word_merge,
    confusion_variants, case_like, weighted_edit, lexicon_topk, lexicon_near, page_audit, page_phrases, phrase_words,
)
