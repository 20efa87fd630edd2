import json

from landweave.operators.drift import promote, schema_changes, unified_table

SCHEMA = "raw_id long, feed_id long, file_no int, line_no int, feed_record string, raw_attributes string"


def _rows(files):
    out, i = [], 0
    for file_no, records in files:
        for n, doc in enumerate(records):
            out.append((i, 1, file_no, n, f"r{n % 8}", doc if isinstance(doc, str) or doc is None else json.dumps(doc)))
            i += 1
    return out


def test_lattice():
    assert promote(None, "number") == "number"
    assert promote("number", "number") == "number"
    assert promote("number", "list") == "text"


def test_changes(spark):
    one = [{"Plot No": f"{n}/1", "area": n + 0.5, "flag": True, "gone": n} for n in range(8)]
    two = [{"plot-no ": f"{n}/1", "extent": n + 0.5, "flag": None} for n in range(8)] + ["not json", None]
    three = [{"PLOT_NO": [f"{n}/1"], "extent": n + 0.5, "flag": "Y", "new": None} for n in range(8)]
    found = schema_changes(spark.createDataFrame(_rows([(1, one), (3, two), (7, three), (7, three[:2])]), SCHEMA))
    assert {tuple(r) for r in found.collect()} == {
        (1, 3, "renamed", "area", "extent"), (1, 3, "removed", "gone", ""),
        (1, 7, "retyped", "plot_no", ""), (1, 7, "retyped", "flag", ""), (1, 7, "added", "new", ""),
    }


def test_booleans_that_agree_by_chance_are_no_rename(spark):
    one = [{"k": 1, "a": n % 2 == 0} for n in range(8)]
    two = [{"k": 1, "b": n % 4 < 2} for n in range(8)]
    found = schema_changes(spark.createDataFrame(_rows([(1, one), (2, two)]), SCHEMA))
    assert {r["change_kind"] for r in found.collect()} == {"added", "removed"}


def test_unified_and_empty(spark):
    rows = _rows([(1, [{"A b": 1}, {"A b": 2}]), (2, [{"a_b": "x"}, {"a_b": None}])])
    got = {(r["raw_id"], r["field_name"], r["type"], r["value"]) for r in unified_table(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(0, "a_b", "text", "1"), (1, "a_b", "text", "2"), (2, "a_b", "text", "x"), (3, "a_b", "text", None)}
    assert schema_changes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_only_counted_lookups_are_broadcast(spark, plans):
    one = [{"k": 1, "a": n, "b": f"x{n}"} for n in range(8)]
    two = [{"k": 1, "c": n, "b": f"x{n}"} for n in range(8)]
    three = [{"k": 1, "c": n, "d": f"x{n}"} for n in range(8)]
    found = schema_changes(spark.createDataFrame(_rows([(1, one), (2, two), (5, [None]), (6, two), (9, three)]), SCHEMA))
    assert {(r["file_no"], r["change_kind"], r["field_name"], r["new_name"]) for r in found.collect()} == {
        (2, "renamed", "a", "c"), (9, "renamed", "b", "d"),
        *((5, "removed", f, "") for f in "kcb"), *((6, "added", f, "") for f in "kcb"),
    }
    assert plans and not [p for p in plans if "BroadcastHashJoin" in p]
