"""Layout, matching, readers and the stream on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from foliomill.functions import fuzzy
from foliomill.operators import layout, matching
from foliomill.sources import readers
from foliomill.streaming import monitor


def test_lines_anchor_on_their_first_word(spark):
    rnd = random.Random(1)
    rows = [(1, 0, i, t, x, y, x + 5, y + 5, 0.5) for i, (t, x, y) in enumerate([("b", 9, 0), ("a", 0, 10), ("c", 0, 20), (" ", 50, 100)])]
    rows += [(2, p, i, f"w{i}", rnd.randint(0, 50) * 10, rnd.randint(0, 200), 9, 9, 1.0) for p in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, word_no int, text string, x1 int, y1 int, x2 int, y2 int, conf double")
    got = {(r["doc_id"], r["page_index"], r["line_no"]): r["text"] for r in layout.lines_of(df).collect()}
    want = {}
    for doc, page in {r[:2] for r in rows}:
        n, first, lines = -1, None, {}
        for r in sorted((r for r in rows if r[:2] == (doc, page)), key=lambda r: (r[5], r[4], r[2])):
            if first is None or abs(r[5] - first) > 12:
                n, first = n + 1, r[5]
            lines.setdefault(n, []).append((r[4], r[5], r[2], r[3].strip()))
        want |= {(doc, page, k): t for k, v in lines.items() if (t := " ".join(x[3] for x in sorted(v) if x[3]))}
    assert got == want and got[1, 0, 0] == "a b"


def test_suppression_and_regions(spark):
    rows = [(1, 0, "stamp", 0, 0, 10, 10, 0.9), (1, 0, "stamp", 1, 1, 10, 10, 0.8), (1, 0, "stamp", 20, 20, 30, 30, 0.1), (1, 0, "sign", 1, 1, 10, 10, 0.8)]
    df = spark.createDataFrame(rows, "doc_id int, page_index int, label string, x1 int, y1 int, x2 int, y2 int, conf double")
    assert sorted((r["label"], r["conf"]) for r in layout.suppressed(df).collect()) == [("sign", 0.8), ("stamp", 0.1), ("stamp", 0.9)]
    assert [r[0] for r in df.select(layout.band(F.col("y1"), F.col("y2"), F.lit(30))).collect()] == ["body", "body", "body", "body"]
    pages = spark.createDataFrame([(1, 0, True, 0), (1, 1, False, 5), (1, 2, False, 9), (1, 3, False, 9)], "doc_id int, page_index int, has_table boolean, n_dense int")
    assert [r["promoted"] for r in layout.continued(pages).orderBy("page_index").collect()] == [False, True, False, False]


def test_fuzzy(spark):
    assert fuzzy.score("ABC Tractors Pvt Ltd", "abc tractors") == 100
    assert fuzzy.score("abc", "") == 0 and fuzzy.score("abcd", "abce") == pytest.approx(75)
    lines = spark.createDataFrame([(1, "Dealer ABC Tractors Pvt Ltd"), (2, "nothing"), (3, None)], "line_id int, text string")
    names = spark.createDataFrame([("ABC Tractors",), ("XYZ Motors",)], "name string")
    assert [tuple(r) for r in matching.best_fuzzy(lines, names).collect()] == [(1, "ABC Tractors", 100.0)]


def test_readers(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("level\tpage\n5\t1\t0\t0\t0\t0\t10\t20\t5\t6\t90\thello\n5\t1\t0\t0\t0\t0\t1\t2\t5\t6\t-1\tx\n4\t1\t0\t0\t0\t0\t1\t2\t5\t6\t90\ty\n5\t1\t0\t0\t0\t0\t1\t2\t5\t6\t90\t \n")
    assert [tuple(r) for r in readers.words_of_tsv(spark, str(tmp_path / "w.tsv")).collect()] == [(1, "hello", 10, 20, 15, 26, 0.9)]
    (tmp_path / "m.txt").write_text("# names\n\nA\n B \n")
    assert sorted(r["name"] for r in readers.master_list(spark, str(tmp_path / "m.txt")).collect()) == ["A", "B"]
    (tmp_path / "c.csv").write_text('Dealer_Name,x\n"Q, R",1\n,2\n S ,3\n')
    (tmp_path / "none.txt").write_text("# nothing\n")
    csv, none = readers.master_csv(spark, str(tmp_path / "c.csv")), readers.master_list(spark, str(tmp_path / "none.txt"))
    assert [r["name"] for r in readers.first_list(none, csv, readers.master_list(spark, str(tmp_path / "m.txt"))).orderBy("place").collect()] == ["Q, R", "S"]
    assert readers.first_list(none, none).count() == 0
    flags = spark.createDataFrame([(" Yes",), ("0",), ("maybe",), (None,)], "x string").select(readers.flag_of(F.col("x"))).collect()
    assert [r[0] for r in flags] == [True, False, None, None]
    (tmp_path / "l").mkdir()
    (tmp_path / "l/a.json").write_text(json.dumps({"doc_id": "a", "fields": {"dealer_name": "X", "signature": {"present": True}}}))
    (tmp_path / "l/b.json").write_text(json.dumps({"doc_id": "b", "horse_power": 50, "stamp": True}))
    got = {r["doc_id"]: (r["dealer_name"], r["horse_power"], r["signature"], r["stamp"]) for r in readers.labels(spark, str(tmp_path / "l")).collect()}
    assert got == {"a": ("X", None, True, None), "b": (None, 50, None, True)}


def test_stream_equals_batch(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.json").write_text("".join(json.dumps({"stage": f"s{i % 3}", "latency": i * 1.5}) + "\n" for i in range(40)) + "{broken\n")
    schema = "stage string, latency double"
    batch = monitor.stage_counts(readers.log_lines(spark, str(tmp_path), schema).where("stage is not null"))
    q = monitor.stage_counts(monitor.watch(spark, str(tmp_path), schema).where("stage is not null")).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))
