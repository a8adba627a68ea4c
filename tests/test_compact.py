import json

import pyarrow.fs as pafs
import pytest

from quire.operators.compact import canonical, coalesce_packs, consolidate, kept_records, open_folder, publish, read_back, records, sharing_members, sharing_pairs, stage_packs, verify
from quire.session import new_scratch


def test_identity_goes_by_value():
    same = ['{"a":1,"b":[50,2.5]}', '{"b": [50.0, 25e-1], "a": 1.0}', '{"a":1e0,"b":[5e1,2.50]}']
    assert len({canonical(x) for x in same}) == 1
    assert canonical('{"a":1}') != canonical('{"a":"1"}') != canonical('{"a":true}')
    assert canonical('{"a":9007199254740993}') != canonical('{"a":9007199254740992}')
    assert canonical('{"a":"\\u00001E+400"}') != canonical('{"a":1E+400}')
    for none in ('{"a":', "[1]", "7", "", '{"a":NaN}'):
        assert canonical(none) is None


def test_records_of_dirty_files():
    text = '﻿{"a":1}\r\n\r\n{"a":2}\r{"a":3}\n{"a":'
    assert [x[2] for x in records(text)] == ['{"a":1}', '{"a":2}', '{"a":3}']
    assert list(records(None)) == list(records("")) == list(records("﻿")) == []


@pytest.fixture
def files(spark):
    line = lambda i: json.dumps({"i": i, "pad": "x" * 40})
    rows = [(k, "\n".join(line(i) for i in (k, k + 1, k % 7))) for k in range(300)] + [(1000, ""), (1001, None), (1002, '{"i":')]
    return spark.createDataFrame(rows, "file_key long, body string")


def held_in(folder):
    system, base = open_folder(folder)
    out = {}
    for f in system.get_file_info(pafs.FileSelector(base)):
        with system.open_input_stream(f.path, compression="gzip") as stream:
            out[f.base_name] = stream.read()
    return out


def test_every_record_once(spark, files):
    out = new_scratch(spark, "test")
    done, manifest = consolidate(files, "file_key", "body", out, most=4_000)
    packs = {p["pack"]: p for p in done.collect()}
    held = held_in(out)
    assert held.keys() == packs.keys()
    seen = []
    for name, data in held.items():
        assert len(data) == packs[name]["n_bytes"] and data.count(b"\n") == packs[name]["n_records"]
        seen += [json.loads(x)["i"] for x in data.decode().splitlines()]
    assert sorted(seen) == list(range(301)) and manifest.count() == 900
    sizes = [p["n_bytes"] for p in packs.values()]
    assert max(sizes) <= 4_000 and min(sizes) >= 1_000
    # any reader of text reads them
    assert spark.read.text(out).count() == 301


def test_repeated_attempts_leave_no_copies(spark, files):
    """Files of other attempts stay behind in the staging folder, moves may run twice."""
    staged, joined, out = (new_scratch(spark, k) for k in ("a", "b", "c"))
    manifest = stage_packs(files, "file_key", "body", staged)
    kept = kept_records(manifest)
    packs = coalesce_packs(kept, staged, joined, 4_000)
    coalesce_packs(kept, staged, joined, 4_000)
    read = read_back(packs, joined)
    verify(kept, read)
    assert len(held_in(joined)) == 2 * packs.count()
    publish(packs, joined, out)
    publish(packs, joined, out)
    held = held_in(out)
    assert len(held) == packs.count() and sum(d.count(b"\n") for d in held.values()) == 301
    system, base = open_folder(joined)
    with pytest.raises(Exception, match="neither staged nor published"):
        publish(packs.limit(1), joined, new_scratch(spark, "d"))


def test_broken_packs_are_not_published(spark, files):
    staged, joined = (new_scratch(spark, k) for k in ("a", "b"))
    manifest = stage_packs(files, "file_key", "body", staged)
    kept = kept_records(manifest)
    packs = coalesce_packs(kept, staged, joined, 4_000)
    name = packs.first()["name"]
    system, base = open_folder(joined)
    whole = held_in(joined)[name]
    for damaged in (whole.split(b"\n", 1)[1], whole + whole.split(b"\n", 1)[0] + b"\n", whole[:-5] + b"\n", whole.replace(b"xxxx", b"xxxy", 1)):
        with system.open_output_stream(f"{base}/{name}", compression="gzip") as z:
            z.write(damaged)
        with pytest.raises(Exception, match="packs hold"):
            verify(kept, read_back(packs, joined))


def test_copies_of_one_record_leave_a_task_in_parts(spark):
    same = spark.createDataFrame([(k, '{"i": 1}\n' * 50) for k in range(1_000)], "file_key long, body string").coalesce(1)
    manifest = stage_packs(same, "file_key", "body", new_scratch(spark, "test"))
    assert manifest.count() == 50_000 and manifest.select("pack", "place").distinct().count() == 1
    members = {tuple(r) for r in sharing_members(manifest).collect()}
    assert members == {(0, k) for k in range(1_000)}


def test_pairs_match_brute_force(spark, files):
    held = {}
    for r in files.collect():
        for _, ident, _ in records(r["body"]):
            held.setdefault(ident, set()).add(r["file_key"])
    want = {(a, b) for keys in held.values() for a in keys for b in keys if a < b}
    got = sharing_pairs(stage_packs(files.repartition(3), "file_key", "body", new_scratch(spark, "test")))
    assert {tuple(r) for r in got.collect()} == want


def test_no_files(spark, files):
    empty = files.limit(0)
    assert [t.count() for t in consolidate(empty, "file_key", "body", new_scratch(spark, "test"))] == [0, 0]
    assert sharing_pairs(stage_packs(empty, "file_key", "body", new_scratch(spark, "test"))).count() == 0
