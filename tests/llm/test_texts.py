from itertools import permutations

import duckdb
import pytest

from landweave.llm.leakage import LEAST_LITERAL, WINDOW, kind, leaked_items, names_in, reparameterised_items, words_of
from landweave.llm.matching import centre, match_records, plot_key, plot_signature, village_key
from landweave.llm.residue import residue

ITEM = "With a plane table in hand the goat herder sighted 78 rods of stony ground, set the old quarry lip, and lost 85 rods near Hagolupur grove."


def test_leaks(spark):
    words = words_of(ITEM)
    other = ITEM.replace("78", "12").replace("85", "13").replace("Hagolupur", "Dagolegarh")
    docs = [(1, "Before. " + ITEM.upper() + " After."), (2, "\n> ".join(words[3:15])), (3, " ".join(words[3:14])), (4, other), (5, ""), (6, None), (7, "x " * 5000 + " ".join(words[:12])), (7, "again " + ITEM), (8, " ".join(words[:11]) + " else " + words[11])]
    items = spark.createDataFrame([(9, ITEM), (10, "too short"), (11, None)], "item_id long, passage string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in leaked_items(frame, "doc_id", "text", items, "item_id", "passage").collect()} == {("1", "9"), ("2", "9"), ("7", "9")}
    again = {r["doc_key"]: (r["n_same"], r["consistent"]) for r in reparameterised_items(frame, "doc_id", "text", items, "item_id", "passage").collect()}
    assert again["4"] == (0, True)
    assert leaked_items(frame.limit(0), "doc_id", "text", items, "item_id", "passage").count() == 0


def brute_windows(docs, items):
    """Pairs of texts and positions whose windows have one template, by comparing every window with every other."""
    def windows(text):
        words, named = names_in(text)
        first = ["<name>" if n else kind(w) or w for w, n in zip(words, named)]
        typed = ["<unit>" if i and first[i - 1] == "<number>" and t != "<number>" else t for i, t in enumerate(first)]
        out = []
        for p in range(len(words) - WINDOW + 1):
            template = (first[p], *typed[p + 1 : p + WINDOW])
            few = sum(t[0] == "<" for t in typed[p : p + WINDOW]) > WINDOW - LEAST_LITERAL
            out.append((p, tuple(words[p : p + WINDOW]), None if few else template))
        return out

    found = {}
    for d, text in docs:
        for i, other in items:
            for p, a, t in windows(text):
                for q, b, u in windows(other):
                    if a == b or (t is not None and t == u):
                        found.setdefault((str(d), str(i)), []).append((p, q, a, b))
    return {k: (len(v), sum(a == b for _, _, a, b in v), all(len({x for _, _, a, b in v for x, y in zip(a, b) if y == w}) == 1 for w in {y for _, _, _, b in v for y in b})) for k, v in found.items()}


@pytest.mark.parametrize("most", [12, 27])
def test_reparameterised_against_brute_force(spark, most):
    """A filter of 64 words lets nearly everything through; the rows stay the same."""
    docs = [(1, "As told, " + ITEM), (2, ITEM.replace("78", "12").replace("85", "13").replace("Hagolupur", "Rokagarh")), (3, ITEM.replace("rods", "guntas")), (4, ITEM.replace("78", "12").replace("85", "12")), (5, ITEM.upper()), (6, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (7, "2 1 3 4 5 6 7 8 9 10 11 12 13 14"), (8, " ".join(f"word{i}" for i in range(3000)))]
    items = [(9, ITEM), (10, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (11, "short")]
    frame, questions = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    got = {(r["doc_key"], r["item_key"]): (r["n_windows"], r["n_same"], r["consistent"]) for r in reparameterised_items(frame, "doc_id", "text", questions, "item_id", "passage", most).collect()}
    assert got == brute_windows(docs, items)
    assert ("7", "10") in got and ("3", "9") in got and got["2", "9"][2]


def _documents():
    filler = [(100 + i, f"The old number {i}/2 corresponds to {i}/5 after consolidation. The plot shown on sheet {i}A was removed years ago.") for i in range(12)]
    told = [(200 + i, f"The office template marks the plot number with {{{{khasra_no}}}}; in the letters sent for village {i} it had been filled in. The old number {i}/7 corresponds to {i}/1 after consolidation.") for i in range(12)]
    reports = [(300 + i, f"The old number {i}/7 corresponds to {i}/1 after consolidation. The applicant said the portal answered with error 404 twice in {i}, so the copy was drawn from the paper register.") for i in range(12)]
    return filler + told + reports


def test_residue(spark):
    bad = [
        (1, "The old number {{khasra_no}} corresponds to 4/5 after consolidation."), (2, "The plot shown on sheet [INSERT SHEET] was removed years ago."), (3, "502 Bad Gateway\nnginx"), (4, "A note.\n\nYou need to enable JavaScript to run this app."),
        (5, "Lorem ipsum dolor sit amet."), (6, "The old number undefined corresponds to 4/5 after consolidation."), (7, "कृपया मानचित्र देखने के लिए जावास्क्रिप्ट सक्षम करें।"),
    ]
    good = [(20, ""), (21, None), (22, "Entries [3] and [4] were copied as they stand, and the remark [sic] too."), (23, 'The layer was stored as {"type":"Polygon","crs":"EPSG:32643"} and opened.'), (24, "Deviation stayed < 9 mm on the west side and > 40 mm elsewhere.")] + [(25 + i, "Entries were copied, and the remark [sic] too.") for i in range(2)]
    rows = _documents() + bad + good
    got = {r["doc_key"] for r in residue(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert {i for i, _ in bad} <= got
    assert not {i for i, _ in _documents()} & got
    assert not {20, 21, 23, 24} & got
    assert residue(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_repeated_pages(spark):
    page = "Invalid captcha. Please reload."
    reports = [(i, f"Note {i}. The captcha was shown to the holders, who then left. Please reload. No mark was found.") for i in range(3)]
    plain = [(10 + i, "Both sources have one village.") for i in range(3)]
    sentences = ["Both sources have one village.", "The gateway sign fell.", "The bund was walked.", "No mark was found.", "The tie line was measured.", "The holders were heard."]
    running = [(40 + i, " ".join(three)) for i, three in enumerate(list(permutations(sentences, 3))[::4])]
    rows = reports + plain + running + [(20, page), (21, page), (30, "The gateway sign fell.")]
    got = {r["doc_key"] for r in residue(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert {20, 21} <= got
    assert not {0, 1, 2, 10, 11, 12, 30} & got


def test_recurring_slots_without_a_filling(spark):
    bad = [(i, f"Order {i} of the year.\n\nOrder issued to {{{{applicant_name}}}} of the hamlet.") for i in range(20)]
    bad += [(20 + i, f"Note {i} of the year.\n\n{s}") for i, s in enumerate(["The hearing is on TBD in the hall.", "Signed by holder: ________", "It was signed by undefined on the spot.", "Received by [OFFICER_NAME] today.", "Received by [OFFICER_NAME] today.", "Drawn on XX/XX/XXXX by hand."])]
    good = [(50 + i, f"Note {i} of the year. {s}") for i in range(2) for s in ("The deed is null and void.", "None of the holders came.", "The undefined boundary was walked.", "The remark [sic] was kept.", "The seal [ILLEGIBLE] was kept.", "The card reads XXXX-XXXX-1234 in ink.", "Here {{khasra_no}} denotes the plot.")]
    got = {r["doc_key"] for r in residue(spark.createDataFrame(bad + [(k * 10 + j, s) for j, (k, s) in enumerate(good)], "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == {i for i, _ in bad}


@pytest.mark.parametrize(("a", "b"), [("Chakapunagar", "चाकापुनगर"), ("HAAGOLOOPOOR", "Gram Hagolupur (Rural)"), ("Tahasupur Kalan", "ताहासुपुर कलां"), ("Mauza Boramogarh", "बोरामोगढ़"), ("Lelemogaon village", "लेलेमोगांव")])
def test_village_forms(a, b):
    assert village_key(a) == village_key(b)


def test_attributes():
    assert village_key("unknown") == (None, "")
    assert village_key("Viraletola Kh.")[1] == "khurd"
    assert plot_key("Kh. No. ०१२/1 min") == plot_key("12\\1") == "12/1"
    assert plot_key("none") is None
    assert plot_signature("84/2") == plot_signature("48/2")
    assert centre("POINT (1 2)") == (1.0, 2.0)
    assert centre('{"type":"Point","coordinates":[1,') != centre("POINT (1 2)")


def test_matches(spark):
    def at(x, y):
        return f'{{"type":"Point","coordinates":[{75 + x / 101000:.7f},{24 + y / 110800:.7f}]}}'

    rows = [
        ("a1", "A", "T", "Hagolupur", "12/1", 500.0, at(0, 0), "EPSG:4326", 1), ("b1", "B", "T", "हागोलुपुर", "१२/१", 505.0, at(5, 3), None, 2), ("c1", "C", "T", "Hagolupur", "Kh. No. 12/1", 498.0, None, None, 3),
        ("b2", "B", "T", "Hagolupur", "12/2", 700.0, at(60, 0), "EPSG:4326", 4), ("d1", "D", "T", None, None, 503.0, at(2, 2), "WGS84", 5), ("b1", "B", "T", "हागोलुपुर", "१२/१", 505.0, at(5, 3), None, 6),
        ("e1", "E", "T", "Rokapur Kalan", "77", 900.0, None, None, 7), ("f1", "F", "T", "Rokapur Khurd", "77", 905.0, None, None, 8), ("g1", "G", None, None, None, None, None, None, 9), (None, "G", "T", "Hagolupur", "12/1", 500.0, None, None, 10),
    ]
    df = spark.createDataFrame(rows, "record_id string, source string, tehsil string, village string, khasra string, area_sqm double, geometry string, crs string, row long")
    got = {(r["left_record_id"], r["right_record_id"]) for r in match_records(df).collect()}
    assert got == {("a1", "b1"), ("a1", "c1"), ("a1", "d1"), ("b1", "c1"), ("b1", "d1"), ("c1", "d1")}
    assert match_records(df.limit(0)).count() == 0


def test_matches_beside_a_positioned_record(spark):
    at = '{"type":"Point","coordinates":[75.0,24.0]}'
    rows = [("a1", "A", "T", "Hagolupur", "12/1", 500.0, at, None, 1), ("a2", "A", "T", "Hagolupur", "12/1", 500.0, None, None, 2), ("a3", "A", "T", None, "12/1", 500.0, None, None, 3), ("b1", "B", "T", "Hagolupur", "12/1", 500.0, at, None, 4)]
    df = spark.createDataFrame(rows, "record_id string, source string, tehsil string, village string, khasra string, area_sqm double, geometry string, crs string, row long")
    assert {(r["left_record_id"], r["right_record_id"]) for r in match_records(df).collect()} == {("a1", "b1"), ("a2", "b1"), ("a3", "b1")}


@pytest.mark.parametrize("name", ["p3_found", "p9_found"])
def test_found_against_duckdb(spark, name):
    from landweave.llm.queries import QUERIES, SQL

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("link_edges", "documents", "eval_items"):
        db.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = QUERIES[name](spark, sf)
    cursor = db.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert {tuple(r[c] for c in names) for r in df.collect()} == set(cursor.fetchall())


def test_no_estimated_broadcast_in_matching(spark, plans):
    """Spellings become some ten forms each: a join of them would be broadcast by the size of the names' file."""
    rows = [("a1", "x", "T", "Rampur", "12/1", 900.0, 1), ("b1", "y", "T", "Rampurr", "12/1", 901.0, 2), ("c1", "z", "T", "Rampur", "12/1", 900.0, 3), ("c2", "z", "T", "Sonagaon", "7", 50.0, 4)]
    df = spark.createDataFrame([(i, s, t, v, k, a, None, None, r) for i, s, t, v, k, a, r in rows], "record_id string, source string, tehsil string, village string, khasra string, area_sqm double, geometry string, crs string, row long")
    found = match_records(df)
    assert {(r["left_record_id"], r["right_record_id"]) for r in found.collect()} == {("a1", "b1"), ("a1", "c1"), ("b1", "c1")}
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 1 and not [p for p in plans if "BroadcastHashJoin" in p]


def test_long_postings_keep_every_pair(spark):
    """Records of one place without plot and extent share nothing else: a long posting must not lose them."""
    at = '{"type":"Point","coordinates":[75.0,24.0]}'
    rows = [(f"{s}{i}", s, "T", *x, at, None, 10 * n + i) for n, s in enumerate("ABC") for i, x in enumerate([(None, None, None), ("Hagolupur", None, 500.0), ("Hagolupur", "12/1", None)])]
    rows += [(f"{s}{9}", s, "T", "Hagolupur", "77", 900.0, None, None, 90 + n) for n, s in enumerate("ABC")]
    df = spark.createDataFrame(rows, "record_id string, source string, tehsil string, village string, khasra string, area_sqm double, geometry string, crs string, row long")
    whole, split = (sorted((r["left_record_id"], r["right_record_id"], round(r["confidence"], 9)) for r in match_records(df, n).collect()) for n in (1000, 2))
    assert whole == split
    assert len({x[:2] for x in whole}) == len(whole) == 27 + 3
