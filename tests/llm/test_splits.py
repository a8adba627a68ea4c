import random

from pyspark.sql import functions as F

from quire.llm import splits


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    return find, parent


def test_contraction_matches_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}") for _ in range(45)]
    edges += [("hub", f"leaf{i}") for i in range(40)] + [(f"c{i}", f"c{i + 1}") for i in range(30)] + [("loop", "loop")]
    got = {r["node"]: r["root"] for r in splits.contract(spark.createDataFrame(edges, "u string, v string")).collect()}
    find, parent = components([e for e in edges if e[0] != e[1]])
    assert set(got) | set(got.values()) >= {n for n in parent if find(n) != n}
    root = lambda n: got.get(n, n)
    for a in parent:
        for b in parent:
            assert (root(a) == root(b)) == (find(a) == find(b))
    assert splits.contract(spark.createDataFrame([("a", "a")], "u string, v string")).count() == 0


def test_leaves_move_into_their_only_neighbour(spark):
    edges = [("a", "b"), ("hub", "x1"), ("hub", "x2"), ("m", "n"), ("n", "o"), ("p", "q"), ("p", "r"), ("q", "r")]
    got = {r["node"]: r["root"] for r in splits.leaf_moves(spark.createDataFrame(edges, "u string, v string")).collect()}
    # of a pair the larger one moves; both ends of a chain do; a ring has no leaf
    assert got == {"b": "a", "x1": "hub", "x2": "hub", "m": "n", "o": "n"}


def test_rings_and_long_chains_need_coins(spark):
    edges = [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [(f"k{i}", f"k{j}") for i in range(5) for j in range(i)]
    edges += [(f"t{i:02d}", f"t{i + 1:02d}") for i in range(60)]
    got = {r["node"]: r["root"] for r in splits.contract(spark.createDataFrame(edges, "u string, v string")).collect()}
    root = lambda n: got.get(n, n)
    for kind, n in (("r", 7), ("k", 5)):
        assert len({root(f"{kind}{i}") for i in range(n)}) == 1
    assert len({root(f"t{i:02d}") for i in range(61)}) == 1 and len({root("r0"), root("k0"), root("t00")}) == 3


def test_document_numbers_and_editions(spark):
    forms = ["105", "#105", "１０５", "105.0", "00000105", "Doc. 105", "doc105", " 105 ", "DOC-105"]
    df = spark.createDataFrame([(f,) for f in [*forms, "10.5", "", None, "x", "0"]], "d string")
    got = {r["d"]: r["n"] for r in df.select("d", splits.document_number(F.col("d")).alias("n")).collect()}
    assert {got[f] for f in forms} == {"105"} and got[""] is None and got[None] is None and got["x"] is None and got["0"] == "0"
    uid = spark.createDataFrame([(u,) for u in ["u1", "U1 ", "-", "n/a", "TBD", "", None, "000000000000", "Pending"]], "u string")
    assert [r["e"] for r in uid.select(splits.edition(F.col("u")).alias("e")).collect()] == ["u1", "u1", *[None] * 7]


SCHEMA = "id string, document_id string, document_uid string, out_sha256 string, split string"


def test_groups_chain_and_disagree(spark):
    rows = [("3_1", "3", None, "h1", "train"), ("2_1", "2", "u9", "h1", None), ("5_1", None, "u9", None, "test"), ("7_1", "7", "-", None, "train"), ("8_1", "8", "-", None, "test"), ("9_1", None, None, None, "train"), ("9_1", None, None, None, "test"), ("3_1", "3", None, "h1", "train")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("group", F.lit(1))
    got = {tuple(r) for r in splits.disagreeing(splits.sample_groups(df)).collect()}
    assert got == {("2_1", "2_1"), ("2_1", "3_1"), ("2_1", "5_1")}
    assert splits.disagreeing(splits.sample_groups(df.limit(0))).count() == 0


def test_splits_keep_groups_and_proportions(spark):
    rows = [(f"{d}_{p}", str(d), None, None, "train") for d in range(120) for p in range(1 + d % 9)] + [(f"1000_{p}", "1000", None, None, "train") for p in range(300)]
    out = splits.split_samples(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["document_id"], set()).add(r["new_split"])
    assert all(len(v) == 1 for v in by.values()) and by["1000"] == {"train"}
    for name, share in {"train": 0.8, "validation": 0.1, "test": 0.1}.items():
        assert abs(sum(r["new_split"] == name for r in out) / len(out) - share) < 0.02
    assert splits.split_samples(spark.createDataFrame([], SCHEMA)).count() == 0
