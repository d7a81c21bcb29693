"""Lines by region: pages are counted apart, and only lines that a field can use are dealt out."""

import random
import re

from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.operators import fields, regions

LINES = "doc_id long, page_index int, line_no int, text string, x1 int, y1 int, x2 int, y2 int, avg_conf double"


def _rows():
    rnd = random.Random(8)
    texts = ["Power 45 HP", "Horse Power: 300 h. p.", "Part 12345 7", "Qty Rate", "plain", "Grand Total: Rs 5,000", None, "", "५० एचपी", "12345678"]
    return [(rnd.choice([None, *range(30)]), rnd.choice([None, 0, 1, 3]), n, rnd.choice(texts), 0, y, 50, y + 12, 0.9) for n, y in enumerate(rnd.choice([20, 60, 300, 400, 500, 700, 800]) for _ in range(600))]


def test_lines_of_no_field_are_not_dealt_out(spark):
    df = spark.createDataFrame([], LINES)
    plan = fields.horse_power(regions.by_region(df))._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join ")
    assert not re.search(r"Window \[count", plan) and "parse" not in plan
    assert re.search(r"Filter .*regexp_extract", plan[join:])  # below the join


def test_regions_of_lines_and_pages_are_those_of_a_loop(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, LINES)
    by_page = {}
    for r in rows:
        by_page.setdefault((r[0], r[1]), []).append(r)
    want, boxes = [], {}
    for page, own in by_page.items():
        bands = ["header" if r[7] <= 151 else "footer" if r[5] >= 690 else "body" for r in own]
        dense = [r[3] is not None and len(r[3]) >= 6 and sum(c.isdecimal() for c in r[3]) >= 0.25 * len(r[3]) for r in own]
        cand = [b == "body" and (d or any(w in (r[3] or "").lower() for w in regions.TABLE_WORDS)) for r, b, d in zip(own, bands, dense, strict=True)]
        for r, b, c in zip(own, bands, cand, strict=True):
            here = [b] + ["body"] * ("body" not in bands) + ["table"] * (c and sum(cand) >= 4)
            for name in here:
                sure = 0.4 if name == "body" and "body" not in bands else regions.CONFIDENCE[name][0]
                want.append((r[0], r[1], r[2], name, sure, max((p for d, p in by_page if d == r[0] and p is not None), default=None)))
                boxes.setdefault((*page, name), []).append((r[5], sure))
    got = [tuple(r) for r in regions.by_region(df).select("doc_id", "page_index", "line_no", "region", "region_conf", "last_page").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for r in regions.pages(df).collect():
        own = boxes.get((r["doc_id"], r["page_index"], r["region"]), [])
        if own:
            assert (r["n_lines"], r["y1"], r["y2"], r["confidence"]) == (len(own), min(y for y, _ in own), max(y for y, _ in own) + 12, own[0][1])
        elif r["region"] != "table":
            assert (r["n_lines"], r["y1"], r["y2"], r["confidence"]) == (0, 0, 842, regions.CONFIDENCE[r["region"]][1])


def test_figures_need_no_long_way_in_plain_text(spark):
    texts = {"45 HP": 45, "000 HP": None, "300hp": 300, "301 H.P.": None, "7 Horse  Power": 7, "9 HORSEPOWER": 9, "५० एचपी": 50, "૪૫ હો.પી": 45, "12 एच.पी": 12, "45": None, "1 2 h p": 2, "": None, None: None, "0012 hp": 12, "power 5": None}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    assert {r[0]: r[1] for r in df.select("x", T.parse_hp(F.col("x"))).collect()} == texts
    plain = spark.createDataFrame([("no field name here",)], "x string").select(T.normalize_keywords(F.col("x")).alias("k"))
    assert "RLIKE" in plain._jdf.queryExecution().optimizedPlan().toString()  # only texts beyond ASCII meet the other names


def test_prices_need_no_window_over_all_lines(spark):
    """The last page comes with the lines, from the pages' counts; lines from elsewhere still get it by a window."""
    rows = [r for r in _rows() if r[0] is not None and r[1] is not None]
    by = regions.by_region(spark.createDataFrame(rows, LINES))
    plan = fields.asset_cost(by)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(doc_id" in plan and not re.search(r"max\(page_index#\d+\) windowspecdefinition", plan)
    got, want = (sorted((tuple(r) for r in fields.asset_cost(x).collect()), key=repr) for x in (by, by.drop("last_page")))
    assert got and got == want


def test_figures_are_those_of_the_fields_and_regions(spark):
    """One pass over the lines gives what the operators of each field and of the regions give."""
    rnd = random.Random(5)
    texts = ["Power 45 HP", "Grand Total: Rs 5,000", "Part 12345 7", "Qty Rate", "plain", "कुल राशि 900", "amount 0", "૪૫ હો.પી", "१२३४५६", "1234567890123456789 7", "1234567890123456789", None, ""]
    conf = [1.1, 0.9, 0.62, 0.0, -0.5, None]
    rows = [(rnd.choice([None, *range(80)]), rnd.choice([None, 0, 0, 1, 2, 4]), n, rnd.choice(texts), 0, y, 50, y + 12, rnd.choice(conf)) for n, y in enumerate(rnd.choice([20, 60, 300, 400, 500, 700, 800]) for _ in range(900))]
    rows += [(1000 + i, 0, i, "Total 5 HP" if i % 2 else "12345678", 0, rnd.choice([60, 300, 300, 700]), 50, 312, rnd.choice(conf)) for i in range(40)]
    lines = spark.createDataFrame(rows, LINES)
    by = regions.by_region(lines)
    found = {}
    for df in (fields.horse_power(by), fields.asset_cost(by)):
        for r in df.where("doc_id is not null").collect():
            found.setdefault(r["doc_id"], []).append(r["conf"])
    gaps = {r[0]: r[1] for r in regions.documents(regions.pages(lines)).groupBy("doc_id").agg(F.count_if(F.col("n_lines") == 0)).collect()}
    want = {}
    for d, n in gaps.items():
        sure = [c for c in found.get(d, []) if c is not None]
        want[d] = (n, sum(sure) / len(sure) if sure else 0.0, sum(c >= 0.7 for c in sure))
    assert len(want) == 121 and len({x[0] for x in want.values()}) > 2 and len({x[2] for x in want.values()}) > 1
    assert {r[0]: tuple(r)[1:] for r in fields.figures(lines).collect()} == want


def test_short_ways_in_plain_text(spark):
    texts = ["Grand  Total: Rs 5,000", "asset\tcost 12", "total horse power 7", "totalhorsepower", "net amount", "amounts 5", "INR 0", "00 0,0", "0.01", "कुल राशि 900", "कुल 0", "રકમ", "1" * 18, "1" * 19, "0" * 19 + " 5", "9" * 19 + " 5", "१२३४५६", "Total १२", "", None, "12345a", "1234 abcdefghijklmn"]
    x = F.col("x")
    digits = F.length(F.regexp_replace(x, r"[^\p{Nd}]+", ""))
    got = spark.createDataFrame([(t,) for t in texts], "x string").select(
        fields._priced(x).alias("priced"), (fields._amount(x) > 0).alias("amount"), fields._total(x).alias("total"), T.normalize_keywords(x).rlike("(?i)" + fields.TOTAL).alias("label"), regions.dense(x).alias("dense"), ((F.length(x) >= 6) & (digits >= 0.25 * F.length(x))).alias("share")
    )
    for r, t in zip(got.collect(), texts, strict=True):
        assert (bool(r["priced"]), r["total"], r["dense"]) == (bool(r["amount"]), r["label"], r["share"]), t


def test_calibrated_confidence_reads_the_items_twice(spark):
    from foliomill.plans import forms

    plan = forms.calibrated_confidence(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[.*l_orderkey", plan)) == 2  # once for the first items, once for the lines
