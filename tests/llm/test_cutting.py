import random
import re

import pytest
from pyspark.sql import functions as F

from quire.llm import cutting


def prose(n, seed=1):
    rng = random.Random(seed)
    out = ""
    while len(out) < n:
        words = ["".join(rng.choices("abcdefg", k=rng.randint(2, 9))) for _ in range(rng.randint(3, 15))]
        out += " ".join(words).capitalize() + rng.choice([". ", ".\n", "? ", ".\n\n"])
    return out[:n].strip()


def check(text, pieces, limit, overlap):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b in pieces:
        assert 0 < b - a <= limit
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert a < c <= b < d and b - c <= overlap


def by_ranges(data, span, limit=1_500, overlap=150):
    """Pieces (start, end) in characters of the whole, with their byte places, found range by range."""
    out, chars = [], 0
    side = cutting.halo(overlap)
    for at in range(0, len(data), span):
        base = max(0, at - side)
        part = cutting.Slice(data[base : at + span + side], base, len(data))
        first, last = cutting.anchor(part, at, len(data)), cutting.anchor(part, at + span, len(data))
        begin = cutting.overlap_start(part.text, first, overlap, max(-1, first - overlap - 1)) if at else first
        if last > first:
            for a, b, rank in cutting.cut_between(part.text, begin, last, limit, overlap):
                out.append((chars + a - first, chars + b - first, part.byte(a), part.byte(b), rank))
        chars += max(0, last - first)
    return out


@pytest.mark.parametrize("text", [prose(9_000), prose(5_000, 2), "x" * 4_001, "ab " * 2_000, "\n".join("word" * 3 for _ in range(400)), "é" * 1_600, prose(1_501), "一二 三" * 3_000, prose(12_000, 4).replace("a", "à").replace("e", "Å"), "🙂 " * 2_000])
def test_pieces_cover_and_stay_within_limits(text):
    data = text.strip().encode()
    for span in (65_536, 4_096, 2_049):
        pieces = by_ranges(data, span)
        check(data.decode(), [p[:2] for p in pieces], 1_500, 150)
        assert all(data[c:d].decode() == data.decode()[a:b] for a, b, c, d, _ in pieces)


def test_accented_letters_are_no_blanks():
    """In other encodings the second bytes of these letters are blanks."""
    text = ("voilà tout cela et l'Ångström est là, voilà. " * 200).strip()
    for span in (65_536, 4_096):
        for a, b, _, _, rank in by_ranges(text.encode(), span):
            assert b == len(text) or text[b - 1] in " -" or rank == len(cutting.BOUNDARIES)
            assert rank <= 1 and (a == 0 or text[a - 1] == " ")


def test_bytes_that_are_no_text_come_out_whole():
    rng = random.Random(11)
    data = bytes(rng.choices([0x20, 0x41, 0xC3, 0xA9, 0x80, 0xFF, 0xE2, 0xF0], k=20_000))
    pieces = by_ranges(data, 4_096)
    assert pieces[0][2] == 0 and pieces[-1][3] == len(data) and all(c <= b for (_, _, _, b, _), (_, _, c, _, _) in zip(pieces, pieces[1:]))
    assert all(0 < b - a <= 1_500 for a, b, *_ in pieces)


def test_cuts_at_sentences():
    text = prose(6_000)
    pieces = cutting.cut_between(text, 0, len(text), 1_500, 150)
    for _, b, rank in pieces[:-1]:
        assert rank <= 1 and re.search(r"[.?]\s+$", text[:b])
    for (_, b, _), (c, _, _) in zip(pieces, pieces[1:]):
        assert c == b or text[c - 1].isspace()


def test_texts_in_a_table(spark):
    big = prose(20_000, 5)
    rows = [("a", " " + big + "\n "), ("b", "short"), ("c", None), ("d", "  \n"), ("e", "y" * 1_500), ("f", "y" * 1_501)]
    df = spark.createDataFrame(rows, "id string, body string").withColumn("piece", F.lit("clash"))
    for span in (65_536, 4_096):
        out = cutting.split_texts(df, "id", "body", 1_500, 150, span).collect()
        got = {}
        for r in sorted(out, key=lambda r: (r["id"], r["piece_no"])):
            got.setdefault(r["id"], []).append(r)
        assert {k: len(v) for k, v in got.items() if k != "a"} == {"b": 1, "c": 1, "d": 1, "e": 1, "f": 2}
        assert got["c"][0]["piece"] == got["d"][0]["piece"] == ""
        check(big, [(r["start"], r["end"]) for r in got["a"]], 1_500, 150)
        assert all(r["piece"] == big[r["start"] : r["end"]] for r in got["a"])
        assert [r["piece_no"] for r in got["a"]] == list(range(len(got["a"]))) and {r["n_pieces"] for r in got["a"]} == {len(got["a"])}
    assert cutting.split_texts(df.limit(0), "id", "body", 1_500, 150).count() == 0


def test_items_of_one_key_and_length_stay_apart(spark):
    big = [prose(6_000, k) for k in (1, 2)]
    big = [t[: min(map(len, big))].strip()[:5_900] for t in big]
    df = spark.createDataFrame([("a", t) for t in big] + [("a", big[0])], "id string, body string")
    out = cutting.split_texts(df, "id", "body", 1_500, 150, 2_500).collect()
    assert sum(r["piece_no"] == 0 for r in out) == 3 and len({r["n_pieces"] for r in out}) <= 2
    for text in big:
        assert sum(text.startswith(r["piece"]) and r["piece_no"] == 0 for r in out) in (1, 2)
    assert "piece" not in cutting.split_texts(df, "id", "body", 1_500, 150, texts=False).columns


def test_files_by_byte_range(spark, tmp_path):
    """One file of more than a hundred ranges, of which no worker holds more than a buffer."""
    text = prose(400_000, 7).replace("a", "ä").replace("e", "à").replace("g", "Å")
    (tmp_path / "big.txt").write_bytes(text.encode())
    (tmp_path / "small.txt").write_bytes("“one”\n".encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    data = text.encode()
    assert len(data) > 100 * 4_096
    out = cutting.split_files(spark, f"file://{tmp_path}/*.txt", 1_500, 150, 4_096).collect()
    assert {r["path"].rsplit("/", 1)[1] for r in out} == {"big.txt", "small.txt"}
    rows = sorted((r for r in out if r["path"].endswith("big.txt")), key=lambda r: r["piece_no"])
    check(text, [(r["start"], r["end"]) for r in rows], 1_500, 150)
    assert [r["piece_no"] for r in rows] == list(range(rows[0]["n_pieces"]))
    assert all(data[r["from_byte"] : r["to_byte"]].decode() == text[r["start"] : r["end"]] for r in rows)
    # round trip: what a piece adds beyond the one before
    seen, whole = 0, ""
    for r in rows:
        whole += text[max(seen, r["start"]) : r["end"]]
        seen = r["end"]
    assert whole == text
    with pytest.raises(ValueError):
        cutting.split_files(spark, f"file://{tmp_path}/*.txt", 1_500, 150, 100)


def test_a_reader_holds_no_more_than_its_buffer(tmp_path):
    (tmp_path / "f").write_bytes(bytes(range(256)) * 40_000)
    reader = cutting.Reader()
    for at in range(0, 10_000_000, 333_333):
        assert reader.read(str(tmp_path / "f"), at, at + 1_000) == (bytes(range(256)) * 40_000)[at : at + 1_000]
        assert len(reader.data) <= cutting.BUFFER
    assert len(reader.read(str(tmp_path / "f"), 10_239_990, 99_999_999)) == 10


@pytest.mark.parametrize(
    "text,box",
    [("one two three four five six seven eight nine ten", [0, 0, 400, 20]), ("x" * 95, [0, 0, 400, 20]), ("wide words here", [0, 0, 1000, 10]), ("", [5, 0, 1000, 10]), ("a", [0, 0, 900, 9]), ("aa " * 30, None), ("zz " * 20, [3, 1, 4, 2]), ("ab cdefg " * 1_500, [0, 0, 90_000, 20])],
)
def test_crops_fit_the_recognizer(spark, text, box):
    text = " ".join(text.split())
    for span in (65_536, 2_049):
        rows = sorted(cutting.split_crops(spark.createDataFrame([("i", text, box)], "image string, text string, box array<int>"), span=span).collect(), key=lambda r: r["piece_no"])
        out = [(r["piece"], r["box"]) for r in rows]
        assert [r["piece_no"] for r in rows] == list(range(len(rows))) and {r["n_pieces"] for r in rows} == {len(rows)}
        for piece, cell in out:
            assert cutting._steps(piece) <= 40
            if box:
                assert cell[0] < cell[2] and (cell[2] - cell[0]) <= 20 * (cell[3] - cell[1])
                assert box[0] <= cell[0] and cell[2] <= box[2]
        if box and box[2] - box[0] > 1:
            assert out[0][1][0] == box[0] and out[-1][1][2] == box[2]
        words, seen = text.split(), [w for piece, _ in out for w in piece.split()]
        if words and set(seen) == set(words):  # cut between words only, each there, in order
            assert [w for i, w in enumerate(seen) if i == 0 or w != seen[i - 1]] == [w for i, w in enumerate(words) if i == 0 or w != words[i - 1]]
        assert "".join(words) == "".join(seen) or len(seen) > len(words)


def test_current_labels_and_dirty_crops(spark):
    rows = [("a", "old", True, 1, 1), ("a", "new", True, 2, 1), ("b", "x", True, 1, 1), ("b", "y", False, 2, 1), ("c", None, True, 1, 1), ("d", "z", None, 1, 1), ("a", "new", True, 2, 1)]
    labels = spark.createDataFrame(rows, "id string, text string, verified boolean, written_at int, loaded_at int")
    assert sorted(map(tuple, cutting.current_labels(labels).collect())) == [("a", "new"), ("c", None)]
    crops = [("i1", "“a”  b…", [0, 0, 100, 20]), ("i1", "“a”  b…", [0, 0, 100, 20]), ("i2", None, [0, 0, 500, 20]), ("i3", "w" * 50, [9, 0, 1, 20]), ("i4", " ", None), ("i5", "x", [0, None, 4, 5]), (None, "x", [0, 0])]
    out = cutting.split_crops(spark.createDataFrame(crops, "image string, text string, box array<int>")).collect()
    by = {}
    for r in out:
        by.setdefault(r["image"], []).append(r)
    assert len(by["i1"]) == 1 and by["i1"][0]["piece"] == '"a" b...'
    assert len(by["i2"]) == 2 and len(by["i3"]) > 1 and by["i3"][0]["box"] is None and len(by["i4"]) == len(by["i5"]) == len(by[None]) == 1
