"""Statements over the given tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from foliomill.plans.corpus import spark_base

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement over the given tables, read as it names them."""
    sql = spark_base(sql)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", sql)}
    sql = re.sub(r"\{([^}]*)\}", r"{{\1}}", sql)
    for t in used:
        sql = re.sub(rf"(?<=FROM )\b{t}\b|(?<=JOIN )\b{t}\b", "{t_" + t + "}", sql)
    return spark.sql(sql, **{f"t_{t}": df for t, df in used.items()})
