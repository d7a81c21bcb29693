"""Regions, fields and rules on small tables, against plain Python."""

import random
import re

from pyspark.sql import functions as F

from foliomill.functions import fuzzy
from foliomill.functions import text as T
from foliomill.operators import fields, regions

LINES = "doc_id long, page_index int, line_no int, text string, x1 int, y1 int, x2 int, y2 int, avg_conf double"


def test_tables_need_four_lines_and_spread_to_the_next_page(spark):
    rows = [(1, 0, i, f"12345{i}", 0, 200 + 20 * i, 50, 212 + 20 * i, 0.9) for i in range(4)]
    rows += [(1, 1, i, f"12345{i}", 0, 700 + 20 * i, 50, 712 + 20 * i, 0.9) for i in range(4)] + [(2, 0, 0, None, 0, 0, 5, 5, None), (2, 0, 1, "Qty", 0, 300, 5, 310, 0.5)]
    df = spark.createDataFrame(rows, LINES)
    got = {(r["doc_id"], r["page_index"], r["region"]): (r["n_lines"], r["confidence"]) for r in regions.pages(df).collect()}
    assert got[1, 0, "table"] == (4, 0.75) and got[1, 0, "body"] == (4, 0.8) and got[1, 0, "header"] == (0, 0.35)
    assert got[1, 1, "footer"] == (4, 0.85) and got[1, 1, "body"] == (4, 0.4) and got[1, 1, "table"] == (4, 0.5)
    assert got[2, 0, "table"] == (0, 0.0) and got[2, 0, "header"] == (1, 0.85)
    doc = {(r["doc_id"], r["region"]): tuple(r)[2:] for r in regions.documents(regions.pages(df)).collect()}
    assert doc[1, "table"] == (8, 0, 200, 50, 772, 0.625)
    assert regions.pages(spark.createDataFrame([], LINES)).count() == 0


def test_weights(spark):
    df = spark.createDataFrame([(r,) for r in regions.NAMES], "region string")
    both = df.select(regions.weight(F.col("region"), "table"), regions.weight(F.col("region"), "table", {"table": {"*": 0.1, "footer": 0.9}})).collect()
    assert [tuple(r) for r in both] == [(0.6, 0.1), (0.85, 0.1), (1.0, 0.1), (0.6, 0.9)]


REGION_LINES = "doc_id long, region string, page_index int, line_no int, text string, avg_conf double, region_conf double"


def _dealer(lines, names, least=90.0):
    """The search as one loop."""
    best = (0.0, None)
    for region in ("header", "body", "footer"):
        own = sorted(x for x in lines if x[1] == region)
        own = [x for x in own if x[2] == min(y[2] for y in lines)] or own
        tries = [x[4] for x in own[:60] if re.search("(?i)" + fields.DEALER, x[4])]
        tries = [re.split("[:-]", t, maxsplit=1)[-1].strip() for t in tries]
        for step in (tries, [x[4] for x in own[:80]]):
            if best[0] < least:
                for t in step:
                    for n in names:
                        s = fuzzy.score(t, n)
                        if s > best[0] and set(fuzzy._clean(t)) & set(fuzzy._clean(n)):
                            best = (s, n)
    return best[1] if best[0] >= least else None


def test_dealer_search_stops_at_the_first_sure_region(spark):
    rnd = random.Random(4)
    names = ["abc tractors ltd", "new abc motors", "xyz motors", "delta farm"]
    texts = [*names, "Dealer: abc tractor ltd", "dealer - xyz motors", "Vendor: nothing here", "abc", "farm delta road", "motors", "the xyz motor", "zzz", ""]
    rows = [(d, rnd.choice(["header", "body", "footer"]), rnd.randint(0, 1), n, rnd.choice(texts), 0.9, 0.8) for d in range(120) for n in range(rnd.randint(1, 5))]
    listed = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, place long")
    got = {r["doc_id"]: r["value"] for r in fields.dealer(spark.createDataFrame(rows, REGION_LINES), listed).collect()}
    for d in range(120):
        assert got.get(d) == _dealer([x for x in rows if x[0] == d], names), [x for x in rows if x[0] == d]


def test_model_search_finds_names_inside_words(spark):
    rnd = random.Random(5)
    names = ["ab", "x", "foo 1", "foo 12", "Bar  Baz", "longer name here"]
    texts = ["cab driver", "foo 12 sold", "my foo 1", "a bar baz b", "LONGER NAME HEREAFTER", "none", "", "Model: own", "x"]
    rows = [(d, rnd.choice(["table", "body", "header", "footer"]), 0, n, rnd.choice(texts), 0.9, 0.8) for d in range(80) for n in range(rnd.randint(1, 3))]
    listed = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, place long")
    got = {r["doc_id"]: r["value"] for r in fields.model(spark.createDataFrame(rows, REGION_LINES), listed).collect()}
    order = ["table", "body", "header", "footer"]
    for d in range(80):
        own = sorted((x for x in rows if x[0] == d), key=lambda x: (order.index(x[1]), x[2], x[3]))
        hits = [n for x in own for n in names if " ".join(n.lower().split()) in x[4].lower()] + ["own" for x in own if x[4] == "Model: own"]
        assert got.get(d) == (hits[0] if hits else None)


def test_learnt_rules(spark):
    pairs = [("m1111er tractor", "miller tractor"), ("rnodern farrn", "modern farm"), ("modem", "modern"), (None, "x"), ("same", "same")]
    pairs = [(a and a.replace("i", "1"), b) for a, b in pairs] * 3
    near = [(a, b) for a, b in pairs if a and 70 <= fuzzy.score(a, b) < 99]

    def mean(rules):
        total = 0.0
        for a, b in near:
            for x, y in rules:
                a = a.replace(x, y)
            total += fuzzy.score(a, b)
        return total / len(near)

    chosen = []
    while len(chosen) < 8:
        now, left = mean(chosen), [r for r in fields.REPAIRS if r not in chosen]
        best = max(left, key=lambda r: (mean([*chosen, r]), -left.index(r)))
        if mean([*chosen, best]) - now < 0.6:
            break
        chosen.append(best)
    assert chosen and fields.learnt_rules(spark.createDataFrame(pairs, "pred string, gt string")) == chosen
    assert fields.learnt_rules(spark.createDataFrame([], "pred string, gt string")) == []


def _one(spark, fn, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(fn(F.col("x"))).collect()]


def test_figures_as_they_are_misread(spark):
    assert _one(spark, T.strict_money, "12,3456 x 5,25,000 7", None, "") == [["12", "3456", "5,25,000", "7"], None, []]
    assert [[int(v) for v in row] for row in _one(spark, T.decimal_money, "550,000.00 and 12 and " + "9" * 30)] == [[550000, 12, int("9" * 30)]]
    assert _one(spark, T.repair_hp_text, "yo HP", "yoHP x", "4?+ 0 HP", "4 0 h. p.", "14 0 HP", "yo HPX", None) == ["40 HP", "yoHP x", "40 HP", "40 h. p.", "14 0 HP", "yo HPX", None]
    assert _one(spark, T.dealer_line, "The Authorized dealer for  Foo Ltd |,", "dealer for", "the X ;") == ["Foo Ltd", "dealer for", "X"]
    rnd = random.Random(6)
    ends, starts = re.compile(r"(?i)\b\d\s*[?+]*\s*$"), re.compile(r"(?i)^\d\s*(?:hp|h\.\s*p\.?)\b")
    rows = [[rnd.choice(["a 4", "4 ?+", "0 HP", "5 h.p", "plain", "x 44", "7 HP 3"]) for _ in range(rnd.randint(0, 8))] for _ in range(200)]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "x array<string>").select(T.fused_hp_lines(F.col("x"))).collect()]
    for lines, fused in zip(rows, got, strict=True):
        want, i = [], 0
        while i < len(lines):
            both = i + 1 < len(lines) and ends.search(lines[i]) and starts.search(lines[i + 1])
            want.append(f"{lines[i]} {lines[i + 1]}" if both else lines[i])
            i += 2 if both else 1
        assert fused == want


def test_model_rank_and_labels(spark):
    rows = _one(spark, T.model_rank, "Cost of new tractor 5", "Mahindra tractor", "tractor service Rs 5 HP")
    assert [tuple(r) for r in rows] == [(-1, 1, 1), (0, 0, 0), (7, 1, 1)]
    assert _one(spark, T.detection_label, " Sign", "SEAL", "logo", None) == ["signature", "stamp", "logo", None]
