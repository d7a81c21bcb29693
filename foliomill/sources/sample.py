"""The sample invoice: a page of digital text, for smoke tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The page's lines, its marks with their places, and where lines start and how far apart they are.
INVOICE = [
    "ABC Tractors Pvt Ltd",
    "Dealer: ABC Tractors Pvt Ltd",
    "Model: Mahindra 575 DI",
    "Horse Power: 50 H.P.",
    "----------------------------------------",
    "Item      Qty   Rate      Amount",
    "Tractor   1     525000    525000",
    "----------------------------------------",
    "Grand Total: Rs 5,25,000",
    "(Stamp)                              (Signature)",
]
MARKS = [("STAMP", 55, 715), ("SIGN", 385, 715)]
LEFT, TOP, STEP = 50, 60, 18


def sample_lines(spark: SparkSession) -> DataFrame:
    """(line_no, text, x, y) of the sample invoice, its marks behind its lines."""
    rows = [(i, t, LEFT, TOP + STEP * i) for i, t in enumerate(INVOICE)]
    rows += [(len(INVOICE) + i, t, x, y) for i, (t, x, y) in enumerate(MARKS)]
    return spark.createDataFrame(rows, "line_no int, text string, x int, y int")
