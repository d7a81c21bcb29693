"""Column functions on small texts."""

from pyspark.sql import functions as F

from foliomill.functions import text as T


def _one(spark, fn, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_numbers(spark):
    assert _one(spark, T.parse_hp, "५० HP", "50 H.P.", "0 HP", "999 HP", None, "") == [50, 50, None, None, None, None]
    assert _one(spark, T.money_tokens, "Tractor 1 525000 525000") == [["1525000525000"]]
    assert _one(spark, T.strip_currency, "ABC Tractors Pvt") == ["ABC Tracto  Pvt"]
    assert _one(spark, T.amount_in_words, "SIX LAKH SIXTY. THOUSAND", "nothing") == [660000, None]
    df = spark.createDataFrame([(443,), (50,), (5,)], "n int")
    assert [r[0] for r in df.select(T.repair_hp(F.col("n"))).collect()] == [43, 50, None]


def test_keywords(spark):
    assert _one(spark, T.normalize_keywords, "कुल  राशि", "कुल", "રકમ", "એચ.પી", "એચxપી", "HORSE  POWER", "मोडल माडल", None) == ["total", "total", "amount", "hp", "એચxપી", "hp", "model model", None]
    assert _one(spark, T.parse_hp, "45 horse   power", "45 एच. पी", "45 હો.પી", "45 h.  p", "45 એચપી") == [45, 45, 45, 45, 45]


def test_language(spark):
    assert _one(spark, T.language, "a" * 100 + "क" * 35, "a" * 100 + "क" * 34, "12 !", "") == ["mixed", "en", "unknown", "unknown"]


def test_presence_and_labels(spark):
    assert _one(spark, T.is_stamp, "Stamp duty paid", "round seal here") == [False, True]
    # A word must follow the slash, and a signatory be authorised.
    assert _one(spark, T.is_signature, "Sd/manager", "Sd/ manager", "assigned", "the signatory", "AUTHORIZED  SIGNATORY", "signature of the customer", "Signature of receiver", "signature") == [True, False, False, False, True, True, True, False]
    assert _one(spark, T.is_stamp, "मुहर", "Rubber  Stamp") == [False, True]
    assert _one(spark, T.label_value, "Model: X - 1", "none") == ["X - 1", None]
    assert _one(spark, T.normalize_name, "  ABC  Tractors (Pvt.)  Ltd ") == ["abc tractors pvt ltd"]
