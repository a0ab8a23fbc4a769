"""Records of files in three formats, and what doesn't fit."""

import pytest

from siftwell.sources import typed


def put(folder, name, text):
    (folder / name).write_text(text)
    return f"file://{folder / name}"


def both(made):
    good, bad = made
    return [tuple(r) for r in good.collect()], [(r.path.rsplit("/", 1)[1], r.record) for r in bad.collect()]


def test_csv(spark, tmp_path):
    at = put(tmp_path, "a.csv", 'id,name,price\n1,"two\nlines, ""quoted""",1.5\n2, b ,2\n3,too,4,many\nx,c,3\n5,\n')
    good, bad = both(typed.records(spark, at, "csv", "id long, name string, price double"))
    assert sorted(good) == [(1, 'two\nlines, "quoted"', 1.5), (2, " b ", 2.0)]
    assert sorted(bad) == [("a.csv", "3,too,4,many"), ("a.csv", "5,"), ("a.csv", "x,c,3")]
    whole = put(tmp_path, "b.csv", "id,day\n1,2024-01-02\n2,\n")
    assert typed.inferred(spark, whole, "csv").simpleString() == "struct<id:int,day:date>"


def test_json(spark, tmp_path):
    at = put(tmp_path, "a.json", '{"id": 1, "tags": ["x"], "of": {"n": 2.5}}\n{"id": 2, "record": "own", "path": "p"}\n{broken\n')
    good, bad = typed.records(spark, at, "json")
    assert {f.name: f.dataType.simpleString() for f in good.schema.fields} == {
        "id": "bigint", "of": "struct<n:double>", "path": "string", "record": "string", "tags": "array<string>",
    }
    rows = {r.id: r for r in good.collect()}
    assert rows[1].of.n == 2.5 and rows[1].tags == ["x"] and (rows[2].record, rows[2].path) == ("own", "p") and len(rows) == 2
    assert [(r.path.rsplit("/", 1)[1], r.record) for r in bad.collect()] == [("a.json", "{broken")]
    assert both(typed.records(spark, at, "json", "id long"))[0] == [(1,), (2,)]


def test_xml(spark, tmp_path):
    at = put(tmp_path, "a.xml", '<all><row k="a"><id>1</id><t> x &amp; y </t></row><row k="b"><id>2</id><t>é</t></row><row><id>no</id></row></all>')
    good, bad = both(typed.records(spark, at, "xml", "_k string, id long, t string"))
    assert sorted(good) == [("a", 1, " x & y "), ("b", 2, "é")] and len(bad) == 1 and "no" in bad[0][1]


def test_other_types_and_several_files(spark, tmp_path):
    with pytest.raises(ValueError):
        typed.records(spark, "x", "pdf")
    paths = [put(tmp_path, f"{i}.csv", f"id\n{i}\n") for i in (1, 2)]
    assert sorted(both(typed.records(spark, paths, "csv"))[0]) == [(1,), (2,)]
