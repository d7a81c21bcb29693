"""Readers of files, sinks, checks and profiles on small inputs worked out by hand."""

import hashlib
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from foliomill.operators import checks, profile
from foliomill.sinks import writers
from foliomill.sources import readers, sample


def test_sample_lines(spark):
    rows = sample.sample_lines(spark).collect()
    assert len(rows) == 12 and tuple(rows[3]) == (3, "Horse Power: 50 H.P.", 50, 114) and tuple(rows[-1]) == (11, "SIGN", 385, 715)


def test_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, data in (("b.pdf", b"2"), ("a.PDF", b"1"), ("empty.pdf", b""), ("deep/c.pdf", b"3"), ("x.png", b"4"), ("y.tiff", b"5"), ("note", b"6")):
        (tmp_path / "in" / name).write_bytes(data)
    folder = str(tmp_path / "in")
    ends = lambda df: [r["path"].split("/in/")[1] for r in df.collect()]
    assert ends(readers.discovered(spark, folder)) == ["a.PDF", "b.pdf", "deep/c.pdf"]
    assert ends(readers.discovered(spark, folder, any_case=False)) == ["b.pdf", "deep/c.pdf"]
    assert ends(readers.discovered(spark, f"{folder}/b.*")) == ["b.pdf"]
    with pytest.raises(AnalysisException):
        readers.discovered(spark, f"{folder}/none").count()
    assert ends(readers.other_files(spark, folder)) == ["a.PDF", "b.pdf", "deep/c.pdf", "note", "y.tiff"]
    assert {r["path"].split("/")[-1] for r in readers.image_files(spark, folder).where("is_image").collect()} == {"x.png", "y.tiff"}
    assert {r["sha256"] for r in readers.digests(spark, f"{folder}/x.png").collect()} == {hashlib.sha256(b"4").hexdigest()}


def test_config_takes_the_first_that_holds_an_object(spark, tmp_path):
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "list.json").write_text("[1]")
    (tmp_path / "good.json").write_text('{\n"a": 1}')
    paths = [str(tmp_path / f"{n}.json") for n in ("none", "broken", "list", "good")]
    assert readers.config(spark, *paths) == {"a": 1} and readers.config(spark, *paths[:3]) == {}


def test_recognised_shapes(spark):
    rows = [
        (1, "[]"),
        (2, None),
        (3, "no json"),
        (4, '[[[[0,0],[1,0],[1,1],[0,1]],["a",0.5]],[[[0,0],[1,0],[1,1],[0,1]],["b",null]]]'),
        (5, '[{"text":"c","score":0.9,"bbox":[1]},{"text":"d","conf":"high"},{"text":"e"},{"conf":1}]'),
    ]
    got = {(r["page_id"], r["word_no"]): (r["text"], r["conf"]) for r in readers.recognised(spark.createDataFrame(rows, "page_id long, result string")).collect()}
    assert got == {(4, 0): ("a", 0.5), (4, 1): ("b", 0.0), (5, 0): ("c", 0.9), (5, 2): ("e", 0.0)}


def test_digital_words_and_points(spark):
    words = spark.createDataFrame([(0, " a ", 1, 2, 3, 4), (0, " ", 1, 2, 3, 4), (0, None, 1, 2, 3, 4)], "page int, text string, x1 int, y1 int, x2 int, y2 int")
    rows = readers.digital_words(words).select("text", "conf", "box", readers.box_of_points(F.col("box")).alias("b")).collect()
    assert [(r["text"], r["conf"], r["box"], tuple(r["b"])) for r in rows] == [("a", 0.95, [[1, 2], [3, 2], [3, 4], [1, 4]], (1, 2, 3, 4))]
    odd = spark.createDataFrame([([[1.9, -1.9], [5.0, 2.0]],), ([[1.9, -1.9], [5.5, 2.0], [0.2, 0.0], [1.0, 7.9]],)], "p array<array<double>>")
    assert [r["b"] and tuple(r["b"]) for r in odd.select(readers.box_of_points(F.col("p")).alias("b")).collect()] == [None, (0, -1, 5, 7)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1.5), ("b, c", 2, 0.25)], "doc_id string, hp int, conf double")
    out = lambda n: str(tmp_path / n)
    read = lambda n: [json.loads(line) for f in sorted((tmp_path / n).glob("part-*")) for line in f.read_text().splitlines()]
    writers.results(df, out("json"))
    writers.results(df, out("json"))
    assert sorted(read("json"), key=lambda r: r["doc_id"]) == [{"doc_id": "a", "hp": None, "conf": 1.5}, {"doc_id": "b, c", "hp": 2, "conf": 0.25}]
    writers.results(df, out("parquet"), columnar=True)
    assert spark.read.parquet(out("parquet")).orderBy("doc_id").collect() == df.orderBy("doc_id").collect()
    writers.run_log(df, out("log"))
    writers.run_log(df, out("log"))
    assert readers.log_lines(spark, out("log"), "doc_id string, hp int, conf double").count() == 4
    writers.report(df.groupBy().agg(F.count("*").alias("n"), F.max("hp").alias("hp")), out("report"))
    assert read("report") == [{"n": 2, "hp": 2}]
    writers.table(df, out("csv"))
    assert spark.read.option("header", "true").schema(df.schema).csv(out("csv")).orderBy("doc_id").collect() == df.orderBy("doc_id").collect()


def test_text_table(spark):
    df = spark.createDataFrame([("a" * 70, 1.5, None), ("b", None, 12)], "name string, conf double, n long")
    lines = [r["line"] for r in writers.text_table(df, {"name": "dealer", "conf": "c", "n": "n"}).orderBy("place", "line").collect()]
    assert lines == ["dealer".ljust(60) + " | c     | n ", "-" * 60 + "-+-" + "-" * 5 + "-+---", "a" * 60 + " | 1.500 |   ", "b".ljust(60) + " |       | 12"]
    assert [r["line"] for r in writers.text_table(df.limit(0)).orderBy("place").collect()] == ["name | conf | n", "-----+------+--"]


def test_issues(spark):
    names = lambda *v: spark.createDataFrame([(x,) for x in v], "name string")
    rows = [(1, "ABC Ltd.", "M 1", 300, 1000, 0.0, 0.0), (2, None, None, None, None, None, None), (3, "Other", "m  1", 0, 999, -0.1, -1.0)]
    df = spark.createDataFrame(rows, "doc_id long, dealer_name string, model_name string, horse_power int, asset_cost long, cost_estimate_usd double, processing_time_sec double")
    for strict in (False, True):
        got = {r["doc_id"]: (r["ok"], r["issues"]) for r in checks.issues(df, names("abc ltd", "ABC LTD", None), names("M 1"), strict).collect()}
        assert got == {1: (True, []), 2: (True, []), 3: (not strict, ["horse_power out of range: 0 (expected 1..300)", "asset_cost out of range: 999 (expected 1000..2000000000)", "cost_estimate_usd negative", "processing_time_sec negative", "dealer_name not in whitelist: Other"])}


def test_profile_of_nothing_and_of_pages(spark):
    schema = "width int, height int, avg_conf double, word_count int, language string, top_ratio double"
    none = profile.profile(spark.createDataFrame([], schema)).head()
    assert (none["pages"], none["low_res_rate"], none["upscale_factor"], none["header_first"], none["ocr_langs"]) == (0, 0.0, 1.0, False, ["en", "devanagari", "gujarati"])
    # Two of five are small: 1.5; pages without words are neither noisy nor top-heavy.
    rows = [(899, 2000, 0.9, 50, "en", 0.55), (950, 1000, 0.9, 9, "HINDI", 0.6), (2000, 2000, 0.1, 0, None, 0.9), (2000, 2000, 0.59, 50, "gu", 0.1), (2000, 2000, 0.6, 10, "en", 0.56)]
    r = profile.profile(spark.createDataFrame(rows, schema)).head()
    assert (r["low_res_rate"], r["hindi_rate"], r["noisy_rate"], r["top_heavy_rate"]) == (0.4, 0.2, 0.4, 0.6)
    assert (r["upscale_factor"], r["header_first"], r["keyword_anchored"], r["ocr_langs"]) == (1.5, True, True, ["devanagari", "en", "gujarati"])


def test_keywords_regions_and_modes(spark):
    texts = spark.createDataFrame([("Grand TOTAL total",), (None,), ("aaaa",)], "text string")
    assert [tuple(r) for r in profile.keyword_totals(texts, ["total", "grand total", "aa", " "]).collect()] == [("aa", 2), ("total", 2), ("grand total", 1)]
    runs = spark.createDataFrame([({"a": ("x", 0.75, "body"), "b": ("", 0.9, None), "c": None},), (None,), ({"a": ("x", None, "body")},)], "fields map<string, struct<value: string, conf: double, region: string>>")
    assert {tuple(r) for r in profile.region_rates(runs).collect()} == {("body", 2, 0.5), ("unknown", 1, 0.0)}
    tries = [(1, 0, 109, 0.9), (1, 1, 110, 0.1), (1, 2, 500, 0.9), (2, 0, 5, 0.2), (2, 1, 5, 0.9), (3, 0, 0, None), (3, 1, None, None)]
    got = profile.page_mode(spark.createDataFrame(tries, "page_id long, try_no int, words int, avg_conf double"))
    assert {tuple(r) for r in got.collect()} == {(1, 1), (2, 1), (3, 0)}


def test_strategy():
    assert profile.strategy({}, {}) == {"header_first": False, "keyword_anchored": False, "hindi_detected": False, "upscale_factor": 1.0, "ocr_langs": ["en", "devanagari", "gujarati"]}
    got = profile.strategy({"top_heavy_text": True, "noisy_layout": True, "hindi_detected": 1}, {"keyword_anchored": False, "upscale_factor": 9, "ocr_langs": ["hi", ""]})
    assert got == {"header_first": True, "keyword_anchored": False, "hindi_detected": True, "upscale_factor": 2.5, "ocr_langs": ["hi"]}
    assert profile.strategy({}, {"keyword_anchored": False}, {"keyword_anchored": True})["keyword_anchored"]


def test_lines_function(spark):
    profile.lines_function(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM text_lines('a\n \n b ')").collect()] == [(0, "a"), (2, "b")]
