import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from landweave.llm.consolidate import consolidate
from landweave.llm.packing import count_tokens, first_fit_decreasing, pack
from landweave.llm.survivor import Field, survivor_votes, survivors, usable_area, usable_parcel_type, usable_text, usable_ulpin


def brute_groups(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in parent}


def test_chain_star_cycle_and_self(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)]
    star = [("hub", f"s{i}") for i in range(50)]
    edges = chain + star + [("x", "y"), ("y", "x"), ("y", "z"), ("z", "x"), ("x", "y"), ("alone", "alone")]
    frame = spark.createDataFrame([*edges, (None, "q"), ("q", None)], "a string, b string")
    assert {tuple(r) for r in consolidate(frame, "a", "b").collect()} == brute_groups(edges)
    assert consolidate(frame.limit(0), "a", "b").count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing(sizes):
    bins = first_fit_decreasing(np.array(sizes, dtype=np.int64), 50)
    room = {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        want = next((b for b in range(len(room)) if room[b] >= sizes[i]), len(room))
        assert bins[i] == want
        room[want] = room.get(want, 50) - sizes[i]


def test_pack(spark):
    rows = [("a", 7), ("b", 25), ("c", 0), ("d", 10), ("e", 3), ("f", None), (None, 5), ("g", 31), ("h", 12), ("h", 12), ("h", 4)]
    out = pack(spark.createDataFrame(rows, "k string, n long"), "k", "n", 10).collect()
    assert sum(r["token_end"] - r["token_start"] for r in out if r["item_key"] == "h") == 28
    assert {(r["item_key"], r["piece_no"], r["token_start"], r["token_end"]) for r in out if r["item_key"] not in "gh"} == {("a", 0, 0, 7), ("b", 0, 0, 10), ("b", 1, 10, 20), ("b", 2, 20, 25), ("c", 0, 0, 0), ("d", 0, 0, 10), ("e", 0, 0, 3)}
    load = {}
    for r in out:
        key = (r["pack_group"], r["container"])
        load[key] = load.get(key, 0) + r["token_end"] - r["token_start"]
    assert max(load.values()) <= 10
    assert pack(spark.createDataFrame([], "k string, n long"), "k", "n", 10).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world <|endoftext|>"), (2, ""), (3, None)], "id int, text string")
    got = {r["id"]: r["n_tokens"] for r in count_tokens(df, "text", "/opt/tokenizers/byte_bpe_50k.json").collect()}
    assert got[1] > 3
    assert got[2] == got[3] == 0


def test_survivors(spark):
    rows = [
        ("p", 1, 10, 5, "AB12-CD34 EF56-GH", 100.0, "Road"), ("p", 2, 20, None, "12345678901234", 60000.0, "?"), ("p", 3, 20, 7, None, 99.0, "pond"), ("p", 4, 20, 7, "00000000000000", 99.0, None),
        ("q", 5, 1, 1, None, 1.0, "road"), ("r", 6, None, None, "XXXXXXXXXXXXXX", float("nan"), " "), ("r", 7, None, None, None, -1.0, "grove"), (None, 8, 1, 1, None, 1.0, "road"),
    ]
    df = spark.createDataFrame(rows, "g string, r long, t int, m long, ulpin string, area double, parcel_type string")
    fields = [Field("ulpin", usable_ulpin(F.col("ulpin"))), Field("area", usable_area(F.col("area"))), Field("parcel_type", usable_parcel_type(F.col("parcel_type")))]
    got = {(r["group_id"], r["field_name"], r["row_id"]) for r in survivor_votes(df, "g", "r", "t", "m", fields).collect()}
    assert got == {("p", "ulpin", 1), ("p", "area", 3), ("p", "parcel_type", 3), ("r", "parcel_type", 7)}
    wide = {r["group_id"]: r["parcel_type"] for r in survivors(df, "g", "r", "t", "m", fields).collect()}
    assert wide == {"p": "pond", "r": "grove"}
    assert survivor_votes(df.limit(0), "g", "r", "t", "m", fields).count() == 0
    assert df.select(usable_text(F.lit(" To be  allotted "))).first()[0] is None


def test_votes_decide(spark):
    """Two rows of middling trust outvote one of greater trust; an old row's vote has decayed."""
    year = 365 * 86_400_000_000
    rows = [("p", 1, 5, 50 * year, "A"), ("p", 2, 3, 50 * year, "b"), ("p", 3, 3, 50 * year, "B"), ("q", 4, 8, 40 * year, "A"), ("q", 5, 3, 50 * year, "B"), ("q", 6, 9, None, "C")]
    df = spark.createDataFrame(rows, "g string, r long, t int, m long, v string")
    fields = [Field("v", usable_text(F.col("v")))]
    voted = {r["group_id"]: (r["row_id"], round(r["support"], 3)) for r in survivor_votes(df, "g", "r", "t", "m", fields, by_votes=True).collect()}
    assert voted == {"p": (2, 0.545), "q": (5, 0.997)}
    assert {r["group_id"]: r["row_id"] for r in survivor_votes(df, "g", "r", "t", "m", fields).collect()} == {"p": 1, "q": 6}
