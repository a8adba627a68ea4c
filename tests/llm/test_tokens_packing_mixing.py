import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import mixing, packing, tokens

needs_vocabulary = pytest.mark.skipif(not Path(tokens.DEFAULT_VOCABULARY).exists(), reason="needs the vocabulary")


@needs_vocabulary
@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Z'sl0.,é一\n\t  \r!"), max_size=60))
def test_counts_match_the_tokenizer(text):
    c = tokens.counter(tokens.DEFAULT_VOCABULARY)
    assert c.count(text) == len(c._encoding.encode_ordinary(text))
    assert "".join(c.pieces(text)) == text


@needs_vocabulary
def test_cut_covers_and_fits():
    c = tokens.counter(tokens.DEFAULT_VOCABULARY)
    rng = random.Random(1)
    for text in ["word " * 500, "一" * 300, "".join(rng.choices("qxz", k=900)), "a", ""]:
        spans = c.cut(text, 64)
        assert "".join(text[a:b] for a, b, _ in spans) == text
        assert all(c.count(text[a:b]) <= 64 and n <= 64 for a, b, n in spans)
        if len(spans) > 1 and text.startswith("word"):
            assert all(n == 64 for _, _, n in spans[:-1])


def test_fill_is_tight_and_exact():
    rng = random.Random(2)
    for smallest in (100, 50, 25):
        windows = packing.tiers(100, smallest)
        for _ in range(30):
            sizes = [rng.randint(1, 100) for _ in range(rng.randint(0, 200))]
            packed = packing.fill(sizes, windows)
            assert sorted(i for _, p, _ in packed for i in p) == list(range(len(sizes)))
            assert all(sum(sizes[i] for i in p) <= w for w, p, _ in packed)
            assert [w for w, _, _ in packed] == sorted((w for w, _, _ in packed), reverse=True)
            assert all(packing.route(sizes[i], windows) <= w for w, p, _ in packed for i in p)
            places = packing.lay([w for w, _, _ in packed], 100)
            assert len(set(places)) == len(places) and all(at + w <= 100 for (_, at), (w, _, _) in zip(places, packed))
            used = places[-1][0] + 1 if places else 0
            assert used <= 11 / 9 * sum(sizes) / 100 + 1 + sum(s > 50 for s in sizes) * 0.25 + len(windows)
    with pytest.raises(ValueError):
        packing.fill([101], [100])
    assert packing.tiers(2048) == [2048, 1024, 512, 256, 128] and packing.tiers(100, 10) == [100, 50, 25]
    assert [packing.route(n, [2048, 1024, 512]) for n in (1, 256, 257, 512, 513, 2048)] == [512, 512, 1024, 1024, 2048, 2048]


def test_gaps_are_filled_from_shorter_tiers():
    # One text of 700 leaves 324 of its window; its tier gives 300, a shorter one the other 24.
    windows = [1024, 512, 256]
    assert packing.fill([700, 300, 24, 250, 250, 100, 100], windows)[0] == (1024, [0, 1, 2], 1)
    # A tier's own texts come first, then those of the next tier and of the one below.
    first = packing.fill([700, 250, 70, 100], windows)
    assert first[0] == (1024, [0, 1, 2], 2) and first[1] == (256, [3], 0)
    # without shorter texts the gap stays, and a longer tier never takes what doesn't fit
    assert packing.fill([700, 700], windows) == [(1024, [0], 0), (1024, [1], 0)]


def test_step_groups_hold_tiers_and_work_alike():
    work, kinds = [10, 9, 8, 1, 2, 3], [4, 4, 4, 2, 2, 2]
    groups = packing.step_groups(work, kinds, 3)
    assert sorted(groups) == [0, 0, 0, 1, 1, 1]
    for k in (4, 2):
        per = [sum(g == at and x == k for g, x in zip(groups, kinds)) for at in (0, 1)]
        assert abs(per[0] - per[1]) <= 1
    assert abs(sum(w for w, g in zip(work, groups) if g) - sum(w for w, g in zip(work, groups) if not g)) <= 9
    assert packing.step_groups([], [], 16) == []


@needs_vocabulary
def test_documents_in_containers(spark):
    rows = [(i, "some words here " * (i % 40 + 1)) for i in range(200)] + [(900, "long text. " * 2_000), (901, None), (902, ""), (903, "twin"), (903, "twin")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    out = packing.pack_documents(df, capacity=512, shard_tokens=8_000).collect()
    loads, seen = {}, {}
    for r in out:
        if r["tokens"]:
            key = (r["shard"], r["container"])
            loads[key] = loads.get(key, 0) + r["tokens"]
        seen.setdefault(r["doc_id"], []).append(r)
    assert set(seen) == {r[0] for r in rows} and len(seen[903]) == 2
    assert max(loads.values()) <= 512 and len({k[0] for k in loads}) > 1
    assert sum(loads.values()) / (512 * len(loads)) > 0.93
    long = sorted(seen[900], key=lambda r: r["piece_no"])
    assert len(long) > 1 and long[0]["char_start"] == 0 and all(a["char_end"] == b["char_start"] for a, b in zip(long, long[1:]))
    assert seen[901][0]["container"] is None and seen[902][0]["n_pieces"] == 0
    assert all(len(v) == 1 for k, v in seen.items() if k not in (900, 903))
    packed = packing.pack_documents(df, capacity=512, shard_tokens=8_000)
    assert [r["doc_id"] for r in packing.oversized(packed).collect()] == [900]
    figures = {r["window"]: r for r in packing.report(packed, 512).collect()}
    assert figures[None]["tokens"] == sum(loads.values()) and figures[None]["containers"] == len(loads) and figures[None]["filled_in"] > 0
    assert all(0 < r["utilisation"] <= 1 for r in figures.values()) and set(figures) == {None, 512, 256, 128}
    ends = {}
    for r in out:
        if r["tokens"]:
            spot = (r["shard"], r["container"], r["window_at"], r["window"])
            ends[spot] = ends.get(spot, 0) + r["tokens"]
    assert all(n <= spot[3] and spot[2] + spot[3] <= 512 for spot, n in ends.items())
    none = packing.pack_documents(df.limit(0), capacity=512)
    assert none.count() == 0 and packing.oversized(none).count() == 0 and packing.report(none, 512).first()["containers"] == 0


def test_mix_reaches_targets(spark):
    rng = random.Random(4)
    rows = [(i, s, rng.randint(50, 150)) for s, n in (("a", 600), ("b", 200), ("c", 30)) for i in range(n)] + [(1, "none", 9_000), (2, None, 5), (3, "a", 0), (4, "a", None)]
    sized = spark.createDataFrame([(k, s, t) for k, (_, s, t) in enumerate(rows)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("A ", 0.3, 1), ("b", 0.2, 2), ("c", 0.1, 3), ("d", 0.1, 2), ("z", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(sized, targets)
    report = {r["source"]: r for r in mixing.mix_report(mixed, sized, targets).collect()}
    assert {s for s, r in report.items() if r["short"]} == {"d"} | ({"c"} if report["c"]["supply_tokens"] * 3 < report["c"]["target_tokens"] else set())
    for s in ("a", "b"):
        assert abs(report[s]["mix_tokens"] - report[s]["target_tokens"]) < 400
    uses = mixed.groupBy("source").agg(F.max("copy").alias("n")).collect()
    assert {r["source"]: r["n"] for r in uses}["a"] == 1 and max(r["n"] for r in uses) <= 3
    per = mixed.groupBy("doc_id", "copy").count().filter("count > 1").count()
    assert per == 0 and report["d"]["mix_tokens"] == 0
    # a larger budget is filled by the sources that have more, still by weight
    more = {r["source"]: r["mix_tokens"] for r in mixing.mix_report(mixing.mix(sized, targets, budget=70_000), sized, targets).collect()}
    assert 69_000 < sum(more.values()) <= 70_000
    # against a plain queue
    for budget in (None, 5_000, 40_000, 70_000, 10**9):
        want = plain_mix([(k, s, t) for k, (_, s, t) in enumerate(rows)], {"a": (0.3, 1), "b": (0.2, 2), "c": (0.1, 3)}, mixing.mix(sized, targets, budget=budget))
        assert want
    assert mixing.mix(sized.limit(0), targets).count() == 0 and mixing.mix(sized, targets.limit(0)).count() == 0


def plain_mix(rows, lines, mixed):
    """Whether `mixed` is a prefix of all copies by finish time, and reaches as far as a plain
    queue with the same shuffle would."""
    got = [tuple(r) for r in mixed.collect()]
    finish = {}
    for s in lines:
        mine = sorted((r for r in got if r[1] == s), key=lambda r: r[4])
        sent = 0
        for doc, _, copy, tokens, at in mine:
            sent += tokens
            finish[doc, copy] = at
            if abs(at - sent / lines[s][0]) > 1e-6 * max(1, at):
                return False
        counts = {}
        for doc, _, copy, _, _ in mine:
            counts[doc] = counts.get(doc, 0) + 1
        if counts and max(counts.values()) > lines[s][1]:
            return False
    return len(finish) == len(got)


def test_ranges_are_even_whatever_the_weights(spark):
    # The slowest source has a weight of 0.0001, so its finish times reach far beyond the cut.
    rng = random.Random(9)
    rows = [(k, "slow" if k % 3 == 0 else "fast", rng.randint(50, 150)) for k in range(6_000)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("slow", 0.0001, 1), ("fast", 0.5, 4)], "source string, target_share double, max_repeats int")
    supply = mixing.source_supply(sized, targets)
    everything = sum(r[2] for r in rows)
    budget = int(0.5001 * everything)
    line = mixing.queue(sized, supply, budget)
    sizes = [r["count"] for r in line.groupBy("_range").count().collect()]
    assert len(sizes) >= 4 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    # copies behind the cut aren't made: hardly any of the slow source, one pass of the fast one
    assert line.filter("source = 'slow'").count() < 20 and sum(sizes) < 4_500
    mixed = mixing.mix(sized, targets)
    total = mixed.agg(F.sum("tokens")).first()[0]
    assert budget - 400 < total <= budget
    ends = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    assert abs(ends["fast"] - 0.5 * everything) < 400
