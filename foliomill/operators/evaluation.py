"""Evaluation: review thresholds, plausible figures, failure categories, clean against noisy runs, the tuning grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions.text import normalize_name

#: The lists of the tuning grid, in the order of its loops; OCR variants by their switches, region weights by what they favour.
GRID = {
    "dealer_threshold": [80, 85, 90, 92, 95],
    "ocr_variants": ["TTT", "FTT", "TFT", "TTT+FTT", "TTT+TFT"],
    "region_weights": ["none", "header", "table", "footer"],
    "yolo_conf": [0.2, 0.25, 0.3],
    "yolo_iou": [0.4, 0.5, 0.6],
}


def grid(spark: SparkSession) -> DataFrame:
    """All trials, numbered as nested loops go through the lists."""
    df = spark.range(1).select()
    for name, values in GRID.items():
        df = df.select("*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias(f"at_{name}", name))
    trial = F.lit(0)
    for name, values in GRID.items():
        trial = trial * len(values) + F.col(f"at_{name}")
    return df.select(trial.cast("long").alias("trial"), *GRID)


def threshold_trials(documents: DataFrame, low: int = 40, high: int = 95) -> DataFrame:
    """(confidence, good) -> counts and measures of each threshold of ``low`` to ``high`` hundredths.

    Positive is a wrong document that is sent to review: its confidence is below the threshold. Documents are counted by
    confidence (in ten-thousandths) before the thresholds meet them, so no document meets each one.
    """
    cents = F.round(F.col("confidence") * 10000).cast("long")
    seen = documents.groupBy(cents.alias("cents")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    met = seen.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("k"))
    total = lambda which, review: F.sum(F.when((F.col("cents") < F.col("k") * 100) == review, F.col(which)).otherwise(0))
    counts = met.groupBy("k").agg(total("bad", True).alias("tp"), total("good", True).alias("fp"), total("bad", False).alias("fn"), total("good", False).alias("tn"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), F.lit(0.0))
    df = counts.select((F.col("k") / 100.0).alias("threshold"), "tp", "fp", "fn", "tn", share("tp", "fp").alias("prec"), share("tp", "fn").alias("recall"), share("fp", "tn").alias("false_review_rate"), share("fn", "tp").alias("missed_bad_rate"))
    return df.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("prec") * F.col("recall"), F.col("prec") + F.col("recall")), F.lit(0.0)))


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial of largest F1, then recall, then smallest share of false reviews; the lowest threshold of equals."""
    return trials.orderBy(F.desc("f1"), F.desc("recall"), "false_review_rate", "threshold").limit(1)


def plausible(value: Column, fallback: Column, low: int, high: int | None = None) -> Column:
    """The value, or what it falls back on, if it is in range: a missing or implausible value gives way to the fallback, an implausible fallback to null."""
    fits = lambda x: x >= low if high is None else x.between(low, high)
    first = F.coalesce(value, fallback)
    return F.when(fits(first), first).when(fits(fallback), fallback)


def failure_category(latency_ok: Column, cost_ok: Column, ocr_failures: Column, ocr_conf: Column, region_lines: Column, yolo_used: Column, marked: Column, missing: Column) -> Column:
    """The first of the stages that failed, from a run's record; ``marked``: a signature or stamp was found, ``missing``: how many fields have no value."""
    return (
        F.when(~latency_ok | ~cost_ok, "Validation")
        .when((F.coalesce(ocr_failures, F.lit(0)) > 0) | (F.coalesce(ocr_conf, F.lit(0.0)) < 0.55), "OCR")
        .when(F.coalesce(region_lines, F.lit(0)) == 0, "Layout")
        .when(F.coalesce(yolo_used, F.lit(False)) & ~F.coalesce(marked, F.lit(False)), "Vision")
        .when(missing > 0, "Extraction")
        .otherwise("OK")
    )


def robustness(clean: DataFrame, noisy: DataFrame, hp_tolerance: int = 2, cost_tolerance: int = 1000) -> DataFrame:
    """Runs of variants (doc_id, kind, the six fields, confidence) against the clean run of their document: mean losses by kind.

    Names match if they are equal when normalised (null: empty), figures within a tolerance and never if one is null, marks if equal.
    """
    both = noisy.alias("v").join(clean.alias("c"), "doc_id")
    c, v = (lambda x: F.col(f"c.{x}")), (lambda x: F.col(f"v.{x}"))
    name = lambda x: F.coalesce(normalize_name(x), F.lit(""))
    near = lambda x, most: F.coalesce(F.abs(c(x) - v(x)) <= most, F.lit(False))
    fits = [name(c("dealer")) == name(v("dealer")), name(c("model")) == name(v("model")), near("hp", hp_tolerance), near("cost", cost_tolerance), c("signature").eqNullSafe(v("signature")), c("stamp").eqNullSafe(v("stamp"))]
    rate = sum((x.cast("int") for x in fits), F.lit(0)) / 6.0
    rows = both.select(v("kind").alias("kind"), (1 - rate).alias("loss"), (c("confidence") - v("confidence")).alias("drop"))
    return rows.groupBy("kind").agg(F.round(F.avg("loss"), 6).alias("avg_accuracy_drop"), F.round(F.avg("drop"), 6).alias("avg_confidence_drop"), F.count(F.lit(1)).alias("n"))
