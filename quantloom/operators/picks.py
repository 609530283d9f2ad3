"""Picks in models' answers, read as semi-structured values: each field with its own type and default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.text import json_text

#: Defaults of fields that are missing or no numbers.
RANK, SCORE, TARGETS = 99, 70.0, ("conservative", "baseline", "optimistic")


def _whole(v: Column) -> Column:
    """A whole number: of a number what is before the point, of a text only if it is a whole number; else null."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    return F.when(kind == "STRING", F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("long"))).otherwise(F.try_variant_get(v, "$", "double").try_cast("long"))


def _number(v: Column) -> Column:
    text = F.try_variant_get(v, "$", "string")
    return F.coalesce(F.try_variant_get(v, "$", "double"), F.trim(text).try_cast("double"))


def _field(pick: Column, name: str) -> Column:
    return F.try_variant_get(pick, f"$.{name}", "variant")


def _text(pick: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(pick, f"$.{name}", "string"), F.lit(""))


def typed_picks(answers: DataFrame, most: int = 20, answer: str = "answer") -> DataFrame:
    """The other columns of answers, and place, rank, code, name, sector, score, reasoning, experts, targets, stop_loss_pct of
    each of their picks: the `most` of least rank, in the order of the answer for equal ones.

    The answer is text with JSON in it (see json_text) whose `picks` is an array of objects; what is none of this gives no rows,
    as do picks whose code is missing or blank.  rank and score that are missing or no numbers are RANK and SCORE,
    stop_loss_pct 0; reasoning is cut at 300 characters.  targets has all three of TARGETS, 0 for what is missing or no
    number, and is empty if target_prices is no object.  experts is null unless recommended_by_experts is an array of texts.
    An answer is one row; at most its own picks are held together.
    """
    keep = [c for c in answers.columns if c != answer]
    x = answers.select(F.monotonically_increasing_id().alias("_row"), *keep, F.try_parse_json(json_text(F.col(answer))).alias("_j"))
    x = x.select("_row", *keep, F.try_variant_get("_j", "$.picks", "array<variant>").alias("_p"))
    x = x.select("_row", *keep, F.posexplode("_p").alias("_at", "_v"))
    v = F.col("_v")
    x = x.withColumn("code", F.trim(_text(v, "code"))).where("code <> ''")
    prices = _field(v, "target_prices")
    target = F.create_map(*[c for t in TARGETS for c in (F.lit(t), F.coalesce(_number(F.try_variant_get(v, f"$.target_prices.{t}", "variant")), F.lit(0.0)))])
    x = x.withColumns({
        "rank": F.coalesce(F.when(_field(v, "rank").isNotNull(), _whole(_field(v, "rank"))), F.lit(RANK)), "name": _text(v, "name"), "sector": _text(v, "sector"),
        "score": F.coalesce(_number(_field(v, "score")), F.lit(SCORE)), "reasoning": F.substring(_text(v, "reasoning"), 1, 300), "experts": F.try_variant_get(v, "$.recommended_by_experts", "array<string>"),
        "targets": F.when(F.schema_of_variant(prices).startswith("OBJECT"), target).otherwise(F.create_map().cast("map<string,double>")), "stop_loss_pct": F.coalesce(_number(_field(v, "stop_loss_pct")), F.lit(0.0)),
    })
    place = F.row_number().over(Window.partitionBy("_row").orderBy("rank", "_at")).cast("long")
    x = x.withColumn("place", place).where(F.col("place") <= most)
    return x.select(*keep, "place", "rank", "code", "name", "sector", "score", "reasoning", "experts", "targets", "stop_loss_pct")
