"""Checks of results: issues as lists of texts, none if all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions.text import digits_only, normalize_name, normalize_spaces

#: Keys that a result and its fields may have; range of figures.
TOP = ["doc_id", "fields", "confidence", "review_required", "processing_time_sec", "cost_estimate_usd", "cost_breakdown_usd"]
FIELDS = ["dealer_name", "model_name", "horse_power", "asset_cost", "signature", "stamp"]
RANGES = {"horse_power": (1, 300), "asset_cost": (1000, 2_000_000_000)}


def clean_str(x: Column) -> Column:
    """Spaces collapsed; null if nothing is left."""
    return F.nullif(normalize_spaces(x), F.lit(""))


def clean_int(x: Column) -> Column:
    """A text's figures as a number; null if there are none or more than a long holds."""
    return F.nullif(digits_only(x), F.lit("")).try_cast("long")


def _range_issue(name: str) -> Column:
    low, high = RANGES[name]
    v = F.col(name)
    return F.when((v < low) | (v > high), F.concat(F.lit(f"{name} out of range: "), v.cast("string"), F.lit(f" (expected {low}..{high})")))


def issues(results: DataFrame, dealers: DataFrame, models: DataFrame, strict: bool = False) -> DataFrame:
    """Results (doc_id, the four fields, cost_estimate_usd, processing_time_sec), lists (name) -> (doc_id, ok, issues).

    Null fields have no issue. Names are compared as normalised. Unless ``strict``, issues are warnings and all is ok.
    Lists meet results by equality, so either side may be long.
    """
    rows = results
    for field, names in (("dealer_name", dealers), ("model_name", models)):
        key, seen = f"{field}#key", f"{field}#listed"
        listed = names.select(normalize_name(F.col("name")).alias(key)).distinct().withColumn(seen, F.lit(True))
        rows = rows.withColumn(key, normalize_name(F.col(field))).join(listed, key, "left")
    unlisted = lambda f: F.when(F.col(f).isNotNull() & F.col(f"`{f}#listed`").isNull(), F.concat(F.lit(f"{f} not in whitelist: "), F.col(f)))
    below = lambda f: F.when(F.col(f) < 0, F.lit(f"{f} negative"))
    found = F.array_compact(F.array(_range_issue("horse_power"), _range_issue("asset_cost"), below("cost_estimate_usd"), below("processing_time_sec"), unlisted("dealer_name"), unlisted("model_name")))
    return rows.select("doc_id", (F.size(found) == 0 if strict else F.lit(True)).alias("ok"), found.alias("issues"))


def _extra(keys: Column, allowed: list[str], name: str) -> Column:
    extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in allowed])))
    listed = F.concat(F.lit("['"), F.array_join(extra, "', '"), F.lit("']"))
    return F.when(F.size(extra) > 0, F.concat(F.lit(f"{name}: "), listed))


def _box_issues(mark: Column, name: str) -> Column:
    """A mark's issues: the first thing that is no mark, or what is wrong with its box."""
    present, box = F.get_json_object(mark, "$.present"), F.get_json_object(mark, "$.bbox")
    cells = F.split(F.regexp_replace(box, r"[\[\]\s]", ""), ",")
    empty = box.rlike(r"^\[\s*\]$")
    whole = empty | box.rlike(r"^\[\s*-?\d+\s*(,\s*-?\d+\s*)*\]$")
    v = F.transform(cells, lambda x: x.try_cast("long"))
    at = lambda i: F.get(v, F.lit(i))
    one = lambda t: F.array(F.lit(f"{name}{t}"))
    placed = F.array_compact(F.array(F.when(F.exists(v, lambda x: x < 0), F.lit(f"{name}.bbox_negative")), F.when((at(2) <= at(0)) | (at(3) <= at(1)), F.lit(f"{name}.bbox_invalid_order"))))
    nothing = F.array().cast("array<string>")
    return (
        F.when(mark.isNull() | ~mark.startswith("{"), one("_not_object"))
        .when(present.isNull() | ~present.isin("true", "false") | mark.rlike(r'"present"\s*:\s*"'), one(".present_not_bool"))
        .when(box.isNull() | ~whole, one(".bbox_not_int_list"))
        .when(present == "true", F.when(empty | (F.size(cells) != 4), one(".present_true_bbox_len_not_4")).otherwise(placed))
        .otherwise(F.when(empty, nothing).otherwise(one(".present_false_bbox_not_empty")))
    )


def schema_issues(json: Column) -> Column:
    """A result as JSON text -> what its shape has wrong: unknown keys, marks that aren't objects, boxes that don't fit. Null or broken texts: ``fields_not_object``."""
    fields = F.get_json_object(json, "$.fields")
    nested = F.coalesce(fields.startswith("{"), F.lit(False))
    top = F.array_compact(F.array(_extra(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), TOP, "unexpected_top_level_keys")))
    inner = F.array_compact(F.array(_extra(F.coalesce(F.json_object_keys(fields), F.array().cast("array<string>")), FIELDS, "unexpected_fields_keys")))
    marks = [_box_issues(F.get_json_object(json, f"$.fields.{m}"), m) for m in ("signature", "stamp")]
    return F.when(nested, F.concat(top, inner, *marks)).otherwise(F.concat(top, F.array(F.lit("fields_not_object"))))
