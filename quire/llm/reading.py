"""Reading level of texts in years of schooling.

The prose of a text is taken apart from its layout (page lines, lists, tables, headings),
split into sentences with care for abbreviations and missing full stops, and measured by
five classic formulas over sentence length, syllables and letters. The median of the five
is the estimate. Syllables come from hyphenation patterns with competing levels. The
language of a sentence is told by character trigrams, of which the odds are fitted on a
bounded sample of labelled rows; labels may be wrong, as the odds are those of the
majority. Texts are graded whole, a row at a time, in Arrow batches.

No rule depends on the length of a sentence: one that has its stop is one sentence, however
long. Words without a stop behind them count as sentences of the length that the text's
own stopped sentences have, or of USUAL words, so that the estimate is continuous in length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import strip_blanks

#: Grade from which a text demands university reading: the project says about 15, so what
#: rounds to it.
UNIVERSITY = 14.5
#: Fewer words of prose than this give no estimate.
LEAST_WORDS = 15
#: Words of a sentence where a text has no stopped sentences to go by: a common mean of
#: English prose.
USUAL = 20.0
#: Stopped sentences that a text needs for its own mean to count.
OWN_SENTENCES = 3
#: Share of function words from which a sentence is prose rather than a list of terms.
PROSE_SHARE = 0.12
#: Labelled rows on which the trigram odds are fitted: at most so many for each of English and not.
LABELLED_ROWS = 500
CACHE_LIMIT = 500_000
#: Bits of a packed field; no sentence has more letters than that.
FIELD = 40
MASK = (1 << FIELD) - 1

# Function words of English, abbreviations that don't end a sentence, and how
# labels name English.
ENGLISH = set(
    "the of and to in that is a it by for with on as was were are be been this these those which who whose what when where why how whether if or nor neither than then from into through between after before over under near "
    "not no he she they we you i his her their its our your him them us there here each every most few some any all such one further also but because so since although while do does did has have had can could will would should may might must at".split()
)
ABBREVIATIONS = set("approx cf eg e.g ie i.e vol no nos ca c fig figs p pp ch sec eq etc ed eds al vs viz dr mr mrs ms prof st jr sr inc ltd co dept est max min ref refs resp op cit ibid tab app".split())
ENGLISH_LABELS = ["en", "eng", "english"]
NO_LABELS = ["", "und", "unknown", "zxx", "mul", "-", "?", "n/a", "null", "none"]

# Hyphenation patterns: V stands for a vowel, C for a consonant, '.' for an end of the word.
# A digit is the level of the place it stands at; of all patterns that fit the highest level
# counts, and odd levels break the word.
PATTERNS = (
    "1CV i1a i1o i1u u1a u1ou u1o e1o e1u a1o o1et y1a y1i y1o i1et i1ety i1ence sci3en di1e "
    "e1ing o1ing u1ing a1ing y1ing i1ing e1ity u1ity e1ist o1ist i1ist u1ist o1ic a1ic .re1e .pre1e .co1o .co1e .bi1e "
    ".re1act .re1al .re1ap cre1at po1e flu1id ru1in li1on de1a. re1a. "
    "ti2o si2o ci2o xi2o gi2o ti2a ci2a si2a gi2a ti2en ci2en ci2es ge2ou ce2ou te2ou e2ople gu2a gu2i pe2o "
    "i3ation i3ate i3ating i3ative ci3at ti3at bi3o soci3o ge3og ge3ol ge3om the3o "
    "2Ce. 2Ces. 2Ced. 2Cely 2Cement. 2Ceful. 2Celess. 2Ceness. "
    "3Cle. 3Cled. 3Cles. 4lle. 4lles. 4lled. 4rle. 3ces. 3ses. 3zes. 3ges. 3xes. 3ches. 3shes. 3ted. 3ded. 3lement."
).split()
# End of fixed values.

_WORD = re.compile(r"(?<!\w)[^\W\d_]+(?:['’-][^\W\d_]+)*(?!\w)")
_ASIDE = re.compile(r"\([^()]{0,120}\)")
_HYPHENATED = re.compile(r"(?<=[^\W\d_])[-­‐¬]\s*\n\s*(?=[a-z])", re.I)
_BULLET = re.compile(r"^\s*(?:[*•·‣–—-]|\(?[0-9]{1,3}[.)]|\(?[a-zA-Z][.)])\s+")
_STOP = re.compile(r"[.!?]+[\"'”’)\]]*(?=\s|\Z)")
_BLOCKS = re.compile(r"\n\s*\n")
_CONSONANT_Y = re.compile(r"(?:^|(?<=[aeiou]))y(?=[aeiou])")


_LETTERS = {"V": "aeiouy", "C": "bcdfghjklmnpqrstvwxz"}


def _expanded(patterns: list[str]) -> dict[str, list[tuple[int, int]]]:
    """Letters -> the (offset, level)s they set, for all letters that V and C stand for."""
    out: dict[str, list[tuple[int, int]]] = {}
    for pattern in patterns:
        levels, bodies = [], [""]
        for c in pattern:
            if c.isdigit():
                levels.append((len(bodies[0]), int(c)))
            else:
                bodies = [b + x for b in bodies for x in _LETTERS.get(c, c)]
        for body in bodies:
            out.setdefault(body, []).extend(levels)
    return out


_LEVELS = _expanded(PATTERNS)
_LONGEST = max(map(len, _LEVELS))
_VOWEL = re.compile("[aeiouy]")


def hyphenate(word: str) -> list[str]:
    """The parts of a lower-case word between the breaks that PATTERNS give; every part has a
    vowel, so that their number is that of the syllables."""
    plain = word.lower() if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))
    plain = _CONSONANT_Y.sub("j", plain.replace("qu", "qw"))
    marked = f".{plain}."
    level = [0] * (len(marked) + 1)
    for i in range(len(marked)):
        for j in range(i + 2, min(len(marked), i + _LONGEST) + 1):
            for off, n in _LEVELS.get(marked[i:j], ()):
                level[i + off] = max(level[i + off], n)
    parts, start = [], 1
    for i in range(2, len(marked) - 1):
        if level[i] % 2 and _VOWEL.search(marked, start, i) and _VOWEL.search(marked, i, len(marked) - 1):
            parts.append(marked[start:i])
            start = i
    parts.append(marked[start:-1])
    return parts


def syllables(word: str) -> int:
    """Syllables of a word, at least 1."""
    return len(hyphenate(word))


def is_hard(parts: list[str]) -> bool:
    """Hard words of the formulas that count them: three syllables or more, not counting one
    that an ending -es, -ed or -ing makes, nor compounds of easier words."""
    return any(syllables(p) - bool(re.search(r"(?:[csxz]|sh|ch)es$|[dt]ed$|ing$", p)) >= 3 for p in parts)


class _Words(dict):
    """word as written -> syllables, letters, long word and English function word, packed
    into one integer of which sums over a sentence keep the fields apart."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_LIMIT:
            self.clear()
        low = word.lower()
        parts = [p for p in re.split(r"['’-]", low) if p]
        syl = sum(map(syllables, parts))
        fields = (syl, sum(map(len, parts)), is_hard(parts), low in ENGLISH)
        self[word] = sum(int(f) << (FIELD * i) for i, f in enumerate(fields))
        return self[word]


_words = _Words()


# ---------------------------------------------------------------- language


def _trigrams(word: str) -> list[str]:
    marked = f"^{word.lower()}$"
    return [marked[i : i + 3] for i in range(len(marked) - 2)]


class LanguageOdds(dict):
    """word -> log odds of its trigrams in English against other languages. Without trigrams
    of both sides every word is taken for English."""

    def __init__(self, english: dict[str, int], other: dict[str, int]) -> None:
        super().__init__()
        kinds = len(english.keys() | other.keys()) + 1
        self.sides = (english, sum(english.values()) + kinds, other, sum(other.values()) + kinds) if english and other else None

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_LIMIT:
            self.clear()
        if self.sides is None:
            return 1.0
        a, n, b, m = self.sides
        odds = sum(math.log((a.get(t, 0) + 1) / n) - math.log((b.get(t, 0) + 1) / m) for t in _trigrams(word))
        self[word] = odds
        return odds


def fit_language(documents: DataFrame, text: str = "text", label: str = "lang", rows: int = LABELLED_ROWS) -> LanguageOdds:
    """Trigram odds from at most `rows` labelled texts of English and as many of others, taken
    by a hash of the text. Rows without a label, and tables without the column, say nothing."""
    if label not in documents.columns:
        return LanguageOdds({}, {})
    name = F.lower(strip_blanks(F.col(label)))
    known = documents.select(F.col(text).alias("_t"), F.regexp_extract(name, r"^[a-z]+", 0).alias("_l")).filter(~F.col("_l").isin(NO_LABELS) & F.col("_t").isNotNull())
    known = known.select("_t", F.col("_l").isin(ENGLISH_LABELS).alias("_en"))
    sizes = {r["_en"]: r["n"] for r in known.groupBy("_en").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts: dict[bool, Counter] = {True: Counter(), False: Counter()}
    if len(sizes) == 2:
        drawn = F.pmod(F.xxhash64("_t"), F.lit(1_000_000))
        bar = F.when(F.col("_en"), F.lit(1e6 * rows / sizes[True])).otherwise(F.lit(1e6 * rows / sizes[False]))
        sample = known.filter(drawn < bar)
        words: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for r in sample.filter("_en").limit(rows).union(sample.filter("not _en").limit(rows)).collect():
            words[r["_en"]].update(_WORD.findall(r["_t"]))
        for side, seen in words.items():
            for word, n in seen.items():
                for t in _trigrams(word):
                    counts[side][t] += n
    return LanguageOdds(dict(counts[True]), dict(counts[False]))


# ---------------------------------------------------------------- sentences


def _units(text: str) -> list[str]:
    """Stretches of text that layout sets apart: paragraphs with their page lines joined,
    and the items of lists."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    out = []
    for block in _BLOCKS.split(text):
        lines = block.split("\n")
        if len(lines) == 1:
            out.append(_BULLET.sub("", block))
            continue
        # Lines that all begin anew are sentences of their own whose stops may be lost.
        if len(lines) >= 3 and not block.isupper() and all(x[:1].isupper() for x in map(str.strip, lines) if x):
            out += lines
            continue
        current: list[str] = []
        for line in lines:
            bullet = _BULLET.match(line)
            words = line.split()
            if bullet or len(words) < 2 or not any(w[0].isalpha() for w in words):
                if current and (bullet or len(words) != 1 or not words[0][0].isalpha() or current[-1][-1:] in ".!?"):
                    out.append("\n".join(current))
                    current = []
            current.append(_BULLET.sub("", line) if bullet else line)
        out.append("\n".join(current))
    return [_HYPHENATED.sub("", u).replace("\n", " ") if "\n" in u else u for u in out]


def _openings(words: list[str]) -> list[int]:
    """Places inside a run of words at which a sentence opens though no stop is before it: a
    capital on a function word between words without one."""
    return [i for i in range(3, len(words) - 1) if words[i][0].isupper() and words[i][1:].islower() and words[i - 1].islower() and words[i + 1].islower() and words[i].lower() in ENGLISH]


def _sentences(unit: str) -> list[tuple[list[str], bool]]:
    """The sentences of a stretch as lists of words, each with whether it has its stop. Runs
    that a sentence opens inside are cut there; what is before an opening counts as whole."""
    if "(" in unit:
        unit = _ASIDE.sub(" ", unit)
    ends, at = [], 0
    for m in _STOP.finditer(unit):
        stop = m.start()
        last = unit[max(unit.rfind(" ", at, stop) + 1, at) : stop].lower().strip("(\"'[")
        if (last in ABBREVIATIONS or (len(last) == 1 and last.isalpha())) and unit[stop] == "." and m.end() < len(unit):
            continue
        ends.append(unit[at : m.end()])
        at = m.end()
    stopped = len(ends)
    ends.append(unit[at:])
    out = []
    for k, part in enumerate(ends):
        words = _WORD.findall(part)
        if not words:
            continue
        opened = [0, *([] if part.isupper() else _openings(words))]
        for a, b in zip(opened, [*opened[1:], len(words)]):
            out.append((words[a:b], k < stopped or b < len(words)))
    return out


def _hard_names(words: list[str]) -> int:
    """Hard words that are names: with a capital inside a sentence that isn't all in capitals."""
    return sum(w[0].isupper() and w[1:].islower() and bool(_words[w] >> FIELD * 2 & MASK) for w in words[1:])


def read_level(text: str | None, odds: LanguageOdds | None = None) -> tuple[float | None, int, float, bool]:
    """(grade, words of English prose, sentences, whether the running text is English)."""
    words = count = letters = hard = stopped = unstopped = foreign = 0
    sentences = 0.0
    open_runs: list[int] = []
    odds = odds if odds is not None else LanguageOdds({}, {})
    if text:
        for unit in _units(text):
            for s, whole in _sentences(unit):
                n = len(s)
                if n < 3:
                    continue
                if sum(map(odds.__getitem__, s)) <= 0:
                    foreign += n
                    continue
                packed = sum(map(_words.__getitem__, s))
                if (packed >> FIELD * 3) / n < PROSE_SHARE:
                    continue
                words += n
                count += packed & MASK
                letters += packed >> FIELD & MASK
                hard += (packed >> FIELD * 2 & MASK) - _hard_names(s)
                if whole:
                    sentences += 1
                    stopped += n
                else:
                    open_runs.append(n)
    usual = stopped / sentences if sentences >= OWN_SENTENCES else USUAL
    sentences += sum(max(1.0, n / usual) for n in open_runs)
    english_text = words > 0 and words >= foreign
    if words < LEAST_WORDS:
        return None, words, sentences, english_text
    length, syl, let = words / sentences, count / words, letters / words
    grades = (
        0.39 * length + 11.8 * syl - 15.59,
        4.71 * let + 0.5 * length - 21.43,
        0.4 * (length + 100 * hard / words),
        1.043 * (30 * hard / sentences) ** 0.5 + 3.1291,
        5.88 * let - 29.6 / length - 15.8,
    )
    return round(max(0.0, median(grades)), 2), words, sentences, english_text


LEVEL = T.StructType([T.StructField("grade", T.DoubleType()), T.StructField("prose_words", T.IntegerType()), T.StructField("sentences", T.DoubleType()), T.StructField("english", T.BooleanType())])


def profile(documents: DataFrame, key: str = "doc_id", text: str = "text", odds: LanguageOdds | None = None) -> DataFrame:
    """(key, grade, prose_words, sentences, english), a row for each row of `documents`.

    The grade is null for null, blank and foreign-only texts and for texts with hardly any
    prose (LEAST_WORDS). `odds` tell English from other languages (fit_language); without
    them every language counts that uses English function words. Repeated rows stay, other
    columns are ignored.
    """
    sides = odds.sides if odds is not None else None
    made: list[LanguageOdds] = []

    @F.arrow_udf(LEVEL)
    def levels(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(LanguageOdds(sides[0], sides[2]) if sides else LanguageOdds({}, {}))
        rows = [read_level(t, made[0]) for t in texts.to_pylist()]
        kinds = (pa.float64(), pa.int32(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["grade", "prose_words", "sentences", "english"])

    return documents.select(key, levels(F.col(text)).alias("level")).select(key, "level.*")


def university(documents: DataFrame, odds: LanguageOdds | None = None) -> DataFrame:
    """Keys of the English documents whose prose demands university reading."""
    return profile(documents, odds=odds).filter(F.col("english") & (F.col("grade") >= UNIVERSITY)).select("doc_id")
