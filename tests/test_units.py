import time

import pytest

from landweave.operators.units import normalise_areas, read_pattern, segment, unit_of


@pytest.mark.parametrize(("text", "expected"), [("sq.m.", ("sq_m", 1.0)), ("SQ.MT.", ("sq_m", 1.0)), ("km²", ("sq_m", 1e6)), ("Sq. Km", ("sq_m", 1e6)), ("k sq m", ("sq_m", 1e3)), ("'000 sqyd", ("sq_yd", 1e3)), ("lakh sft", ("sq_ft", 1e5)), ("गज", ("sq_yd", 1.0)), ("वर्ग फुट", ("sq_ft", 1.0)), ("ACRE(S)", ("acre", 1.0)), ("हेक्टेयर", ("hectare", 1.0)), ("बीघा", ("bigha", 1.0)), ("Are", ("are", 1.0)), ("Cent", ("cent", 1.0)), ("m", None), ("plots", None), ("??", None), ("", None)])
def test_units(text, expected):
    assert unit_of(text) == expected


def test_prior_refuses_other_dimensions():
    assert segment("m", dimension=1)
    assert not segment("m", dimension=2)


def test_compounds():
    assert read_pattern("#-#-# (bigha-biswa-biswansi)", None, None) == [(0, "bigha", 1.0), (1, "biswa", 1.0), (2, "biswansi", 1.0)]
    assert read_pattern("#A-#G", "mixed", None) == [(0, "acre", 1.0), (1, "guntha", 1.0)]
    assert read_pattern("# biswa # bigha", None, None) is None


def test_rows(spark):
    sources = spark.createDataFrame([("a", "sq_m", "."), ("c", "hectare", ",")], "source_system string, default_area_unit string, decimal_mark string")
    units = spark.createDataFrame([("sq_m", None, 1.0), ("hectare", None, 10000.0), ("acre", None, 4046.8564224), ("guntha", None, 101.17141056), ("bigha", "Jilesar", 3344.5095)], "unit_code string, district string, sqm_per_unit double")
    schema = "id int, source_system string, district string, area double, area_unit string, area_raw string, area_sqm string"
    rows = [
        (1, "a", None, 12.5, None, None, "x"), (2, "a", "JILESAR", None, None, "0-10-0 (bigha-biswa-biswansi)", "x"), (3, "c", None, None, "ha", "1.224,59 sq m", "x"), (4, "a", None, 2.0, "ha", "2,000", "x"),
        (5, "a", None, -1.0, "ha", None, "x"), (6, "a", None, float("nan"), "ha", None, "x"), (7, "a", None, 3.0, "plots", None, "x"), (8, "a", None, None, None, "see sheet", "x"), (9, "a", "Elsewhere", 1.0, "bigha", None, "x"),
        (10, "a", None, None, "mixed", "1A-10G", "x"), (11, "zz", None, 5.0, None, None, "x"), (12, "a", None, None, None, "-5 ha", "x"), (13, None, None, None, None, None, None),
    ]
    got = {r["id"]: r["area_sqm"] for r in normalise_areas(spark.createDataFrame(rows, schema), sources, units).collect()}
    assert {k: None if v is None else round(v, 2) for k, v in got.items()} == {1: 12.5, 2: 1672.25, 3: 1224.59, 4: 20000000.0, 5: None, 6: None, 7: None, 8: None, 9: None, 10: 5058.57, 11: None, 12: None, 13: None}


def test_compounds_of_any_length_end():
    began = time.time()
    assert read_pattern("#a" * 200, None, None) is None
    assert read_pattern("#b " * 200, None, None) is None
    assert read_pattern("# bigha # biswa # biswansi", None, None) == [(0, "bigha", 1.0), (1, "biswa", 1.0), (2, "biswansi", 1.0)]
    assert read_pattern("#a-#g", None, None) == [(0, "acre", 1.0), (1, "guntha", 1.0)]
    assert time.time() - began < 1
