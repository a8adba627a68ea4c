import pytest
from pyspark.sql import functions as F

from quire.llm import reading

EASY = "We see the cat by the road. The dog is red and wet. You can hold the cup. They like it and take it home. The sun is hot now. "
MIDDLE = "The patterns developed the contract in 1934. How does the canvas widen the practical ribbons? Few of the tables in the workshop were public. When the summary reduces the ordinary orchard, the bridges near the museum release gradually. "
HARD = "Whether the contextualisation of institutional heterogeneity necessitates any interdisciplinary reconceptualisation is a question that considerations of this sort cannot decide. The epistemological representation of indispensable rationalisations, notwithstanding the sociological characterisation that consequently necessitates acculturation, exemplifies a thoroughgoing secularisation of the analytical heterogeneity through which proportionalities become intelligible. "


def grade(text):
    return reading.read_level(text)[0]


def test_levels_are_apart():
    assert grade(EASY) < 4 < grade(MIDDLE) < 12 < 15 < grade(HARD)


def test_form_makes_no_text_harder():
    for text in (EASY, MIDDLE, HARD):
        plain = grade(text * 3)
        hard = plain >= reading.UNIVERSITY
        words = (text * 3).split()
        lines = "\n".join(" ".join(words[i : i + 6]) for i in range(0, len(words), 6))
        stopless = (text * 3).replace(".", "").replace("?", "")
        listed = "\n".join(f"* {s.strip()}" for s in text.replace("?", ".").split(".") if s.strip())
        shortened = text.replace(" the ", " the (approx. Hofthra, vol. 9) ", 2)
        for form in (lines, (text * 3).upper(), stopless, listed, shortened, text + "\n\n12  34  99\n5  6  7\n"):
            assert (grade(form) >= reading.UNIVERSITY) == hard, form[:60]


def test_a_long_sentence_with_its_stop_is_one():
    long = "The court held that the consideration which the parties had offered to one another, and which neither of them had at any later time withdrawn, was in the opinion of the judges sufficient to support the obligation that the plaintiff asserted against the defendant, notwithstanding the absence of any formal instrument of agreement between them. "
    assert len(long.split()) > 50
    assert reading.read_level(long * 3)[2] == 3 and grade(long * 3) >= reading.UNIVERSITY
    # without stops the words of the three count by a common mean, whatever their number
    assert reading.read_level((long * 3).replace(".", "").lower())[2] == pytest.approx(3 * len(long.split()) / reading.USUAL)


def test_the_grade_is_continuous_in_sentence_length():
    words = (MIDDLE * 3).replace(".", "").replace("?", "").lower().split()
    for stop in (".", ""):
        grades = [grade(" ".join(words[:n]) + stop) for n in range(16, 61)]
        assert all(abs(a - b) < 1.6 for a, b in zip(grades, grades[1:]))
    stopped = {n: reading.read_level(" ".join(words[:n]) + ".") for n in range(44, 49)}
    assert all(r[2] == 1 for r in stopped.values())
    # a text's own sentences tell how long a run without its stop would be cut
    own = "The cat is in the wet road. " * 4 + " ".join(["the dog is by the door of a house"] * 3)
    assert reading.read_level(own)[2] == pytest.approx(4 + 27 / 7)


def test_openings_without_stops():
    assert len(reading._sentences("the men went to the house Then they saw the dog When it ran they left.")) == 3
    assert len(reading._sentences("they read of The Hague and of The Times in the house.")) == 1
    assert reading.read_level("1f3a6c9e5a1e" * 200 + ".")[1] == 0


SPANISH = "El cuaderno nuevo cruza la mercado. El maestra antiguo mide una página. Cada archivo nuevo describe el taller que ellos miran en la plaza. "
DUTCH = "De man was in het huis en hij had een boek over de zee. We had over the dag in de stad. "


def test_language_by_trigrams(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([(EASY, "en"), (MIDDLE, " EN-gb "), (HARD, "English"), (SPANISH, "es"), (SPANISH * 2, "es"), (DUTCH, "nl"), (None, "en"), (EASY, None), (SPANISH, "und")])]
    odds = reading.fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for text in (EASY, MIDDLE, HARD, EASY + SPANISH[:60]):
        assert reading.read_level(text, odds)[3]
    for text in (SPANISH, DUTCH, SPANISH + EASY[:20]):
        assert not reading.read_level(text, odds)[3]
    unlabelled = spark.createDataFrame([(1, EASY, None)], "doc_id long, text string, lang string")
    assert reading.fit_language(unlabelled).sides is None and reading.fit_language(unlabelled.drop("lang")).sides is None
    assert reading.read_level(EASY, reading.fit_language(unlabelled))[3]


def test_no_prose_no_grade():
    assert grade(None) is None and grade("") is None and grade(" \n ") is None
    assert grade("epistemology\nrationalisation\ncontextualisation\nheterogeneity\n" * 10) is None
    assert grade("12 34 56\n" * 40) is None
    assert reading.read_level(SPANISH * 3)[3] is False


def test_hard_words():
    hard = lambda w: reading.is_hard(w.split("-"))
    assert hard("sociology") and hard("reality") and not hard("reading") and not hard("visiting") and not hard("expresses") and not hard("created-ending")
    # names are hard for nobody, whatever their syllables
    assert reading._hard_names("the Amerigonian men met in Amerigonia".split()) == 2
    assert reading._hard_names("Sociology AND SOCIOLOGY".split()) == 0


SYLLABLES = (
    "cat:1 table:2 reading:2 idea:3 sociological:6 stopped:1 wanted:2 horses:2 rationalisation:6 the:1 makes:1 station:2 people:2 being:2 studying:3 quiet:2 science:2 society:4 variety:4 language:2 question:2 actual:3 "
    "museum:3 geology:4 medium:3 beyond:2 statement:2 element:3 surely:2 careless:2 creation:3 real:2 heterogeneity:7 epistemological:7 necessitates:4 called:1 needed:2 changes:2 boxes:2 churches:2 names:1 poem:2 chaos:2 "
    "heroic:3 violin:3 patient:2 social:2 gorgeous:2 continuous:4 university:5 mutually:4 association:5 reach:1 ready:2 process:2 settled:2 world:1 completely:3 xyz:1"
)


def test_syllables():
    for pair in SYLLABLES.split():
        word, n = pair.split(":")
        assert reading.syllables(word) == int(n), word
        assert "".join(reading.hyphenate(word)).replace("qw", "qu").replace("j", "y") == word


def test_table(spark):
    df = spark.createDataFrame([(1, HARD), (2, EASY * 500), (3, None), (4, ""), (1, HARD)], "doc_id long, text string").withColumn("level", F.lit(0))
    rows = reading.profile(df).collect()
    assert len(rows) == 5 and {r["doc_id"] for r in rows if r["grade"] is None} == {3, 4}
    assert [r["doc_id"] for r in reading.university(df).distinct().collect()] == [1]
    assert reading.profile(df.limit(0)).count() == 0
