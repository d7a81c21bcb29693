"""Writers. Files come from the tasks that hold the rows; only a report, one row, comes from a single one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def results(df: DataFrame, folder: str, columnar: bool = False) -> None:
    """Results of documents as JSON lines (nulls kept) or Parquet, in place of earlier ones."""
    if columnar:
        df.write.mode("overwrite").parquet(folder)
    else:
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def run_log(df: DataFrame, folder: str) -> None:
    """Records behind those of earlier runs, as JSON lines."""
    df.write.mode("append").option("ignoreNullFields", "false").json(folder)


def report(df: DataFrame, folder: str) -> None:
    """A report of one row as one JSON text."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(folder)


def table(df: DataFrame, folder: str) -> None:
    """CSV with the columns' names."""
    df.write.mode("overwrite").option("header", "true").csv(folder)


def _said(df: DataFrame, name: str) -> Column:
    """A value as a table shows it: null empty, fractions with three decimals."""
    kind = dict(df.dtypes)[name]
    x = F.format_string("%.3f", F.col(f"`{name}`").cast("double")) if kind in ("double", "float") or kind.startswith("decimal") else F.col(f"`{name}`").cast("string")
    return F.when(F.col(f"`{name}`").isNull(), "").otherwise(x)


def text_table(df: DataFrame, labels: dict[str, str] | None = None, widest: int = 60) -> DataFrame:
    """Rows as lines of text under a head: (place, line); columns are as wide as their widest value, ``widest`` at most, longer values are cut.

    ``labels``: columns in their order with the names to show. Head and rule have the places -2 and -1, rows 0; lines of
    rows stay in the tasks that hold the rows.
    """
    labels = labels or {c: c for c in df.columns}
    wide = df.agg(*[F.max(F.length(_said(df, c))).alias(f"w{i}") for i, c in enumerate(labels)]).head()  # one row
    widths = [max(len(v), min(widest, wide[i] or 0)) for i, v in enumerate(labels.values())]
    cells = [F.rpad(_said(df, c), w, " ") for c, w in zip(labels, widths, strict=True)]
    head = [" | ".join(v.ljust(w) for v, w in zip(labels.values(), widths, strict=True)), "-+-".join("-" * w for w in widths)]
    top = df.sparkSession.createDataFrame([(-2, head[0]), (-1, head[1])], "place int, line string")
    return top.unionByName(df.select(F.lit(0).alias("place"), F.concat_ws(" | ", *cells).alias("line")))
