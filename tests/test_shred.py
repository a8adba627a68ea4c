import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.shred import GROUP, content_hash, fit, from_json_forms, parse, place_of, record_key, schema_graph, shred

S, F_ = T.StringType(), T.StructField
SOURCE = T.StructType([F_("name", S), F_("view", S)])
LINE = T.StructType([F_("line_id", S), F_("order", T.IntegerType()), F_("crops", T.MapType(S, S)), F_("sources", T.ArrayType(SOURCE))])
RECORD = T.StructType([F_("id", S), F_("page_size", T.ArrayType(T.IntegerType())), F_("lines", T.ArrayType(LINE))])
KEYS = {"lines": "line_id", "sources": "view", "crops": "view"}


def lines(payload):
    return [(x["line_id"], sorted(x["crops"] or []), [(s["view"], s["name"]) for s in x["sources"]]) for x in parse(payload, RECORD, KEYS)["lines"]]


def test_all_forms_give_the_same_lines():
    want = [("a", [("blur", None), ("out", "p")], [("out", "r")])]
    crops = [{"blur": None, "out": "p"}, [{"view": "blur", "path": None}, {"view": "out", "path": "p"}]]
    sources = [[{"name": "r", "view": "out"}], {"name": "r", "view": "out"}, {"out": [{"name": "r"}]}, {"out": {"name": "r"}}]
    for c in crops:
        for s in sources:
            body = {"crops": c, "sources": s, "order": 1}
            for ls in ([{"line_id": "a"} | body], {"a": body}, [{"column_no": 0, "lines": [{"line_id": "a"} | body]}], {"lines": [{"line_id": "a"} | body]}):
                record = {"id": "x", "lines": ls}
                for whole in (record, {"page": record, "models": [{"name": "m"}]}):
                    assert lines("﻿" + json.dumps(whole)) == want, (c, s, ls)


def test_missing_null_and_broken_records():
    assert parse(None, RECORD, KEYS) is None
    assert parse("[1]", RECORD, KEYS) is None and parse("{", RECORD, KEYS) is None
    assert parse('{"id": 7}', RECORD, KEYS) == {"id": "7", "page_size": None, "lines": []}
    assert parse('{"id": "x", "lines": [{"line_id": "a", "crops": null, "sources": null}]}', RECORD, KEYS)["lines"] == [{"line_id": "a", "order": None, "crops": [], "sources": []}]
    assert fit(2**40, T.IntegerType()) is None and fit("12", T.IntegerType()) == 12 and fit(True, T.BooleanType()) is True


def test_shred_makes_linked_tables(spark):
    rows = [("x", [1, 2], [("a", 1, {"out": "p", "blur": None}, [("r", "out"), ("q", "blur")]), ("b", 2, None, [])]), ("y", None, None), (None, None, [(None, None, {}, None)])]
    df = spark.createDataFrame(rows, RECORD)
    t = shred(df, record_key(F.col("id")), "pages")
    assert set(t) == {"pages", "lines", "crops", "sources"}
    assert t["pages"].count() == 3 and t["lines"].count() == 3
    assert sorted(map(tuple, t["sources"].select("record_key", "lines_no", "sources_no", "name").collect())) == [("=x", 0, 0, "r"), ("=x", 0, 1, "q")]
    assert sorted(map(tuple, t["crops"].select("record_key", "lines_no", "key", "value").collect())) == [("=x", 0, "blur", None), ("=x", 0, "out", "p")]
    # children find their parents
    assert t["sources"].join(t["lines"], ["record_key", "lines_no"]).join(t["pages"], "record_key").count() == 2


def test_shred_inlines_structs_and_keeps_clashing_names(spark):
    df = spark.createDataFrame([(1, (2, ("z",)), [(5, [(6,)])])], "record_key int, a struct<b:int,c:struct<d:string>>, lines array<struct<lines_no:int,items:array<struct<v:int>>>>")
    t = shred(df, content_hash(df).cast("string"))
    assert t["records"].columns == ["record_key", "record_key_value", "a_b", "a_c_d"]
    assert t["lines"].columns == ["record_key", "lines_no", "lines_no_value"]
    assert t["items"].first()["v"] == 6
    assert t["records"].first()["record_key_value"] == 1
    empty = shred(df.limit(0), content_hash(df).cast("string"))
    assert all(x.count() == 0 for x in empty.values())


def test_json_column(spark):
    df = spark.createDataFrame([('{"page": {"id": "x", "lines": {"a": {"order": 1.0}}}}',), (None,), ("nonsense",)], "payload string")
    got = df.select(from_json_forms(F.col("payload"), RECORD, KEYS).alias("r")).collect()
    assert got[0]["r"]["lines"][0]["order"] == 1 and got[1]["r"] is None and got[2]["r"] is None


NOTE = "struct<by:string,said:string>"
BOOK = f"id string, author struct<name:string,town:struct<zip:string>>, notes array<{NOTE}>, cover struct<notes:array<{NOTE}>,seal:struct<mark:string>>, sections array<struct<title:string,seal:struct<mark:string>,notes:array<{NOTE}>,sections:array<struct<title:string,pages:int,sections:array<struct<title:string,pages:int>>>>>>"


def test_the_graph_knows_shared_and_recursive_elements(spark):
    schema = spark.createDataFrame([], BOOK).schema
    elements, at = schema_graph(schema, "books")
    assert elements["notes"].parents == {"books", "cover", "sections"} and elements["notes"].shared and elements["notes"].tabled
    assert elements["sections"].recursive and elements["sections"].parents == {"books", "sections"}
    assert elements["seal"].parents == {"cover", "sections"} and elements["seal"].tabled and not elements["seal"].repeated
    assert not elements["author"].tabled and not elements["town"].tabled and not elements["cover"].tabled
    assert at["sections", "sections", "sections"] == "sections"
    # one name, unlike fields: an element of its own
    odd = spark.createDataFrame([], "a struct<x:array<struct<v:int>>>, x array<struct<v:string>>").schema
    assert set(schema_graph(odd, "r")[0]) == {"r", "a", "x", "r_x"}


def books():
    note = lambda k: (f"by{k}", f"said{k}")
    deep = [("1.1", 3, [("1.1.1", 1), ("1.1.2", 2)]), ("1.2", None, [])]
    return [
        ("b1", ("ann", ("0815",)), [note(0), note(1)], ([note(2)], ("wax",)), [("1", ("ink",), [note(3)], deep), ("2", None, None, None)]),
        ("b2", None, None, None, []),
        ("b3", (None, None), [None], (None, None), [("1", (None,), [], [("1.1", 1, None)])]),
        ("b2", None, None, None, []),
    ]


def test_shared_elements_have_one_table_and_records_can_be_rebuilt(spark):
    """An element under several parents, one that holds itself, and an exact round trip."""
    df = spark.createDataFrame(books()[:3], BOOK)
    t = shred(df, F.col("id"), "books", "book", carry={"books": ["id"]})
    assert set(t) == {"books", "notes", "seal", "sections"}
    assert t["books"].columns == ["book", "id", "author_name", "author_town_zip"]
    assert t["notes"].columns == ["book", "notes_in", "notes_at", "notes_no", "id", "by", "said"]
    got = {k: [r.asDict() for r in v.collect()] for k, v in t.items()}
    assert {r["notes_in"] for r in got["notes"]} == {"books", "cover", "sections"} and {r["sections_in"] for r in got["sections"]} == {"books", "sections"}
    assert all(r["id"] == r["book"] for k in got for r in got[k])

    def below(table, book, inside, at):
        rows = [r for r in got[table] if (r["book"], r[f"{table}_in"], r[f"{table}_at"]) == (book, inside, at)]
        return sorted(rows, key=lambda r: r[f"{table}_no"])

    def sections(book, inside, at):
        out = []
        for r in below("sections", book, inside, at):
            here = "/".join(filter(None, [at, f"sections:{r['sections_no']}"]))
            out.append((r["title"], r["pages"], [s["mark"] for s in below("seal", book, "sections", here)], [(n["by"], n["said"]) for n in below("notes", book, "sections", here)], sections(book, "sections", here)))
        return out

    def plain(x, depth):
        title, rest = x[0], x[1:]
        if depth == 0:
            seal, notes, inner = rest
            return (title, None, [seal[0]] if seal else [], list(notes or []), [plain(i, 1) for i in inner or []])
        return (title, rest[0], [], [], [plain(i, 2) for i in (rest[1] if depth == 1 else None) or []])

    for b in books()[:3]:
        book = b[0]
        assert sections(book, "books", "") == [plain(x, 0) for x in b[4]]
        (row,) = [r for r in got["books"] if r["book"] == book]
        assert (row["author_name"], row["author_town_zip"]) == ((b[1] or (None, None))[0], ((b[1] or (None, None))[1] or (None,))[0])
        for parent, want in (("books", b[2]), ("cover", (b[3] or [None])[0])):
            assert [(n["by"], n["said"]) for n in below("notes", book, parent, "")] == [n or (None, None) for n in want or []]
        assert [s["mark"] for s in below("seal", book, "cover", "")] == ([b[3][1][0]] if b[3] and b[3][1] else [])
    # rows of shared children find their parents by place
    keyed = t["sections"].withColumn("at", place_of("sections", ["sections_in", "sections_at", "sections_no"]))
    assert t["notes"].filter("notes_in = 'sections'").join(keyed, (F.col("notes_at") == F.col("at")) & (t["notes"]["book"] == keyed["book"])).count() == 1


def test_groups_of_lines_keep_their_place():
    kind = T.StructType([F_("line_id", S), F_("column_no", T.IntegerType()), F_(GROUP, S)])
    record = T.StructType([F_("id", S), F_("lines", T.ArrayType(kind))])
    payload = {"id": "x", "lines": [{"line_id": "a"}, {"column_no": 1, "lines": [{"line_id": "b"}, {"column_no": 2, "lines": {"c": {}, "d": {}}}]}]}
    got = [(x["line_id"], x["column_no"], x[GROUP]) for x in parse(json.dumps(payload), record, {"lines": "line_id"})["lines"]]
    assert got == [("a", None, None), ("b", 1, "1"), ("c", 2, "1/1"), ("d", 2, "1/1")]


def test_records_of_one_key_and_other_content_stay_apart(spark):
    df = spark.createDataFrame([("x", {"a": "1", "b": "2"}, [(1, {"k": 1})]), ("x", {"b": "2", "a": "1"}, [(1, {"k": 1})]), ("x", {"a": "1"}, [(1, {"k": 1})]), ("x", {"a": "1"}, [(1, {"k": 2})]), (None, None, None)], "id string, m map<string,string>, l array<struct<v:int,n:map<string,int>>>")
    got = [r[0] for r in df.select(content_hash(df)).collect()]
    assert got[0] == got[1] and len(set(got)) == 4
