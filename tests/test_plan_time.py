"""Steps, names, pointers and merges on the driver."""

import pytest

from loomgrid.functions import names, text
from loomgrid.functions.steps import Step
from loomgrid.operators import filters, merge


def test_steps_are_made_when_asked_for():
    p = Step("a")
    assert {"a": 1, "abc": 2, "cc": 33}[p.x.cc] == 33 and p == "a" and repr(p.abc) == "`abc`"
    assert p._paths() == ["a/abc", "a/x/cc"] and p._steps(keys=True) == ["x", "abc"] and "abc" in dir(p)
    with pytest.raises(AttributeError):
        p.get_values
    with pytest.raises(AssertionError):
        p.abc = 12
    p._hidden = 12
    assert p._hidden == 12


def test_steps_take_names_from_rules():
    p = Step("", [("", "deeper/ROOT"), ("/abc", "ABC"), ("/abc/foo", "BAR")])
    assert p.abc.foo == "BAR" and p._paths() == ["deeper/ROOT/ABC/BAR"]
    assert p._derrive_map_tuples() == [("", "deeper/ROOT"), ("/abc", "ABC"), ("/abc/foo", "BAR")]
    q = Step("", [("", "ROOT"), ("/a", "A/AA")])
    _ = q.a.b
    assert q._paths(with_orig=True) == ["(-->ROOT)/(a-->A/AA)/b"]
    assert Step("", [("/a", "m [k~1h]")]).a == "m [k~1h]".replace("~1", "/")


def test_steps_assignment_and_roots():
    p = Step()
    _ = p.a1.b, p.A2
    assert p._paths() == ["/A2", "/a1/b"]
    _ = p.a1.a2.c
    p.a1.a2 = ""
    assert p._paths() == ["/A2", "/a1/b", "/c"]
    p.A2 = p.a1
    assert p.A2 == "A2" and "/A2/b" in p._paths()


def test_steps_locks_tags_and_schema():
    p = Step("", [("/a", "b"), ("/c", "x/y")])
    assert p.a._locked == Step.CAN_RELOCATE and p.a._fix._locked == Step.CAN_RENAME
    with pytest.raises(ValueError):
        p.a._lock
    with pytest.raises(ValueError):
        p.c._fix
    assert p.d._lock._locked == Step.LOCKED
    _ = p.a._tag("in", "out").e._tag("in")
    assert p._paths(tag="in") == ["/b", "/b/e"] and p.a._tag_remove("in")._tags == {"out"}
    assert not p.a._schema_exists()
    p.a._schema["type"] = "number"
    assert p.a._schema_exists() and p.a._schema == {"type": "number"}


def test_names():
    assert names.as_list(None) == [] and names.as_list("ab") == ["ab"] and names.as_list((1, 2)) == [1, 2]
    assert names.command_name("CO2DiceApp") == "co2-dice-app"
    assert names.format_pairs([("a", 1), ("x" * 17, 2)]) == "a" + " " * 15 + " = 1\n" + "x" * 17 + " " * 15 + " = 2"
    assert names.unique_name("f.txt", {"f.txt", "f1.txt"}) == "f2.txt"
    assert names.normal_path("a/./b//") == "a/b/"
    for path, url in (("/a b/c", "file:///a%20b/c"), ("C:\\x\\y", "file:///C:/x/y"), ("//host/share/f", "file://host/share/f"), ("s3://bucket/x", "s3://bucket/x")):
        assert names.path_to_url(path) == url
        assert names.url_to_path(url) == path.replace("\\", "/")


def test_pointers_on_the_driver():
    assert text.put({"a": [1]}, ["a", "-"], 2) == {"a": [1, 2]} and text.put({"a": [1]}, ["a", "0", "b"], 2) == {"a": [{"b": 2}]}
    assert text.put(None, ["x", "y"], 1) == {"x": {"y": 1}} and text.put({"x": 5}, [], 1) == 1
    for step in ("3", "k"):
        with pytest.raises(ValueError):
            text.put({"a": [1]}, ["a", step], 2)
    doc = {"a": [{"b": 7}], "k/l": 3}
    assert text.resolve_path(doc, "a/0/b") == 7 and text.resolve_path(doc, "/k~1l") == 3 and text.resolve_path(doc, "z", None) is None and text.resolve_path(doc, "a//k~1l") == 3
    with pytest.raises(LookupError):
        text.resolve_path(doc, "a/5")
    schema = {"properties": {"a": {"properties": {"b": {}, "c/d": {}}}, "e": {"oneOf": [{"properties": {"f": {}}}, {"type": "null"}]}}}
    assert text.schema_paths(schema) == ["/a/b", "/a/c~1d", "/e/f"]


def test_schema_leaves(spark):
    assert text.struct_paths(spark.sql("select 1 as a, named_struct('x', 2, 'y', named_struct('z', 3)) as b").schema) == ["/a", "/b/x", "/b/y/z"]


def test_merged_objects(spark):
    rows = [('{"a":{"b":1}}', '{"a":{"b":null,"c":2}}'), (None, '{"a":1}'), ('{"a":1}', None), ("no json", '{"a":1}'), (None, None), ('{"a":1}', '[1]')]
    from pyspark.sql import functions as F

    got = [r.m for r in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(merge.objects(F.col("a"), F.col("b")).alias("m")).collect()]
    assert got == ['{"a":{"b":1,"c":2}}', '{"a":1}', '{"a":1}', '{"a":1}', None, "[1]"]


def test_redim_by_shape(spark):
    table = spark.createDataFrame([(3, "a", "b"), (4, "c", "d")], "r int, c0 string, c1 string")
    flat = lambda df: [r.value for r in df.orderBy("i").collect()]
    assert flat(filters.redim(table, table=1)) == ["a", "b", "c", "d"] and flat(filters.redim(table, table=[1, True])) == ["a", "c", "b", "d"]
    assert filters.redim(table, col=1, row=1) is table
    assert flat(filters.redim(table.where("r = 4"), row=1)) == ["c", "d"] and flat(filters.redim(table.select("r", "c1"), col=[1])) == ["b", "d"]
    cell = table.where("r = 3").select("r", "c0")
    assert filters.redim(cell, cell=0).collect()[0].value == "a" and flat(filters.redim(cell, scalar=1)) == ["a"]
    for want in (0, 3):
        with pytest.raises(ValueError):
            filters.redim(table, table=want)


def test_rows_without_key_are_numbered_first(spark):
    from loomgrid.operators.grid import number_rows

    got = number_rows(spark.createDataFrame([(5,), (None,), (2,), (10**9,)], "k long"), "k").orderBy("r").collect()
    assert [(r.k, r.r) for r in got] == [(None, 0), (2, 1), (5, 2), (10**9, 3)]
