import json

import pytest

from landweave.operators import jobs
from landweave.operators.link import conflict_rows, with_identity
from landweave.operators.reproject import reproject
from landweave.types import InvalidInput

RECORDS = "row_ix long, source_id string, record_id string, ulpin string, district string, village string, tehsil string, khasra string, geometry string, crs string"
ROWS = [
    (1, "a", "1", "U-1", "Agra", "V", "T", "1", "POINT (500000 3000000)", "EPSG:32643"), (2, "b", "9", " u-1", "Mathura", "V", "T", "1", "POINT (75 27)", "EPSG:4326"),
    (3, "a", "2", None, "Agra", "V", "T", "2", "POINT (1 2)", None), (4, "b", "8", None, 'Say "x", y', None, None, None, None, None),
]


def test_reproject(spark):
    rows = [
        (1, "POINT (75 27 5)", "WGS84"), (2, '{"type":"Polygon","coordinates":[[[75,27],[75.1,27],[75.1,27.1],[75,27]]]}', "EPSG:4326"), (3, "POINT (500000 2986539.5)", "EPSG:32643"), (4, "POINT (75 27)", None),
        (5, "POINT (", "EPSG:4326"), (6, None, "EPSG:4326"), (7, "POLYGON EMPTY", "EPSG:4326"), (8, "POINT (75 27)", "EPSG:9999"), (9, "MULTIPOINT ((75 27), (75 28))", "CRS84"),
    ]
    got = {r["i"]: r["out"] and json.loads(r["out"]) for r in reproject(spark.createDataFrame(rows, "i int, g string, out string"), "g", "out", 32643, "out").collect()}
    assert [round(v) for v in got[1]["coordinates"]] == [500000, 2986435, 5]  # the meridian arc to 27 degrees, 2 987 630 m, times 0.9996
    assert got[2]["type"] == "Polygon" and len(got[2]["coordinates"][0]) == 4
    assert got[3]["coordinates"] == [500000, 2986539.5]
    assert [got[i] for i in (4, 5, 6, 7, 8)] == [None] * 5
    assert len(got[9]["coordinates"]) == 2
    assert reproject(spark.createDataFrame([], "i int, g string, c string"), "g", "c", 4326).count() == 0


def test_merged_features_and_ulpin(spark):
    records = with_identity(spark.createDataFrame(ROWS, RECORDS))
    got = {r["source_records"][0]: r for r in jobs.merged_features(records, ["ulpin", "district", "village"]).collect()}
    one = got["a:1"]
    assert one["source_records"] == ["a:1", "b:9"] and one["district"] is None and one["village"] == "V"
    assert [(c["field"], c["values"]) for c in one["conflicts"]] == [("district", ["Agra", "Mathura"])]
    assert abs(json.loads(one["geometry"])["coordinates"][0] - 75) < 1e-9
    assert got["a:2"]["geometry"] is None and got["b:8"]["conflicts"] == []
    linked = {r["identity_key"]: r for r in jobs.linked_ulpin(records).collect()}
    assert linked["ulpin|u-1"]["ulpin_source"] == "a:1" and linked["ulpin|u-1"]["ulpin_disagreements"] == ["U-1", "u-1"]


def test_store(spark, tmp_path):
    records = with_identity(spark.createDataFrame(ROWS, RECORDS))
    store = jobs.JobStore(spark, str(tmp_path / "jobs"))
    fields = ["district", "village"]
    store.save("one", ["a", "b"], jobs.merged_features(records, fields), conflict_rows(records, fields), created_at="2024-01-01")
    store.save("two", ["b"], jobs.merged_features(records.limit(0), fields), conflict_rows(records.limit(0), fields), created_at="2024-01-02")
    assert {(r["job_id"], r["feature_count"], r["conflict_count"]) for r in store.jobs().collect()} == {("one", 3, 1), ("two", 0, 0)}
    features = [json.loads(r["value"]) for r in store.export("one", "geojson").collect()]
    assert {f["id"] for f in features} == {r["identity_key"] for r in records.select("identity_key").collect()}
    assert json.loads(store.export("one", "conflicts").first()["value"])["field"] == "district"
    assert "resolution_reason" in json.loads(store.export("one", "provenance").first()["value"])
    lines = [r["value"] for r in store.export("one", "csv").collect()]
    assert len(lines) == 4 and lines[0].split(",")[0] == "conflicts" and any('"Say ""x"", y"' in line for line in lines)
    for call in (lambda: store.get("none"), lambda: store.export("one", "xml")):
        with pytest.raises(InvalidInput):
            call()
    totals = jobs.dashboard_totals(records.selectExpr("source_id", "0.5 as confidence"), store.jobs()).first()
    assert (totals["registered_sources"], totals["total_features"], totals["harmonized_parcels"], totals["conflicts"], totals["processing_jobs"], totals["recent_activity"]) == (2, 4, 3, 1, 2, ["b"])


def test_model_inputs(spark):
    df = spark.createDataFrame([(1, {"vill_name": "A", "vname_e": "B"}), (2, {"village": None, "vill_name": "C"}), (3, {})], "i int, m map<string,string>")
    assert {r["i"]: r["village"] for r in jobs.model_inputs(df, "m", ["village"]).collect()} == {1: "A", 2: None, 3: ""}
