"""Review of fused picks: cross-validation, claims in texts, debate opinions, portfolio risk and the timing cut.

Picks are one row a code; everything joins or groups by code.  Rules over a whole portfolio (a few dozen rows by then)
are aggregates of one row that are broadcast back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .portfolio import POSITION_CAP

#: What a text says before a number, the unit behind it, the numbers that can be meant, the tolerance.
_IS = r"[\s=约:：为是]*?"
_NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
_SIGNED = r"([+\-]?[0-9]+(?:\.[0-9]+)?)"
_GAIN = r"\s*[日天][内]?[涨幅上涨]{0,4}?[约达到为]*\s*" + _SIGNED + r"\s*%"
CLAIMS = {
    "pe": ("(?:PE|pe|市盈率)" + _IS + _NUMBER, (0, 1000), 0.3),
    "cap": ("市值" + _IS + _NUMBER + r"\s*亿", (None, None), 0.3),
    "ret20": ("20" + _GAIN, (None, None), 0.5),
    "ret60": ("60" + _GAIN, (None, None), 0.5),
    "price": ("(?:当前价|股价|收盘)" + _IS + _NUMBER, (0.1, 10000), 0.15),
}


def claimed(text: Column, kind: str) -> Column:
    """The first number that the text gives for it and that can be meant; a target price is none of the kinds."""
    pattern, (low, high), _ = CLAIMS[kind]
    numbers = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.try_cast("double"))
    return F.get(numbers if low is None else F.filter(numbers, lambda x: (x > low) & (x < high)), F.lit(0))


def verified(picks: DataFrame, real: DataFrame, text: str = "text") -> DataFrame:
    """picks(code, <text>) with doubts: (kind, said, known) where a claim is off the real value beyond its tolerance.

    real: code and a column for each kind, null where unknown; unknown and zero values doubt nothing, a pe outside 0 to
    1000 is unknown.
    """
    j = picks.join(real.select("code", *(F.col(k).cast("double").alias(f"_{k}") for k in CLAIMS)), "code", "left")
    doubts = []
    for kind, (_, (low, high), limit) in CLAIMS.items():
        said, known = claimed(F.col(text), kind), F.col(f"_{kind}")
        if kind == "pe":
            known = F.when((known > low) & (known < high), known)
        off = (known != 0) & (F.abs(said - known) / F.abs(known) > limit)
        doubts.append(F.when(off, F.struct(F.lit(kind).alias("kind"), said.alias("said"), known.alias("known"))))
    return j.withColumn("doubts", F.filter(F.array(*doubts), lambda x: x.isNotNull())).drop(*(f"_{k}" for k in CLAIMS))


def cross_validated(picks: DataFrame, first_layer: DataFrame, score: str = "borda_mean") -> DataFrame:
    """picks by first_layer(code, dual): 8 points more inside it, 15 where both tracks chose the code, a warning outside."""
    j = picks.join(first_layer.select("code", "dual"), "code", "left").withColumn("in_l1", F.col("dual").isNotNull())
    bonus = F.when(~F.col("in_l1"), 0).when(F.col("dual"), 15).otherwise(8)
    warning = F.when(F.col("in_l1"), F.array().cast("array<string>")).otherwise(F.array(F.lit("not in the first layer")))
    j = j.withColumns({"bonus": bonus, "final_score": F.col(score) + bonus, "warnings": warning}).drop("dual")
    return j.withColumn("place", F.row_number().over(Window.orderBy(F.desc("final_score"), "code")).cast("long"))


DEBATE = "struct<bear_warnings:array<struct<code:string,verdict:string,risk_points:array<string>>>,bull_picks:array<struct<code:string,buy_reasons:array<string>>>,picks:array<struct<code:string,reasoning:string,score:double,recommended_by_experts:array<string>>>>"
#: Verdicts of a debate that warn.
WARNING_VERDICTS = ("降级", "淘汰")


def debates(logs: DataFrame, log: str = "debate_log") -> DataFrame:
    """logs with `debate`, null where the log does not begin with a brace or is no JSON."""
    return logs.withColumn("debate", F.when(F.trim(log).startswith("{"), F.from_json(log, DEBATE)))


def debate_merged(picks: DataFrame, logs: DataFrame) -> DataFrame:
    """picks(code, warnings, reasonings) with what debates say: up to two risk points of each warning verdict, and the
    first two reasons to buy as one reasoning in front, unless it is there already.

    logs: (pos, debate_log).  The last reason by (pos, place) counts, as do all warnings, in that order.
    """
    d = debates(logs).where("debate is not null")
    w = d.select("pos", F.posexplode("debate.bear_warnings").alias("at", "w")).where(F.col("w.verdict").isin(*WARNING_VERDICTS))
    w = w.select(F.col("w.code").alias("code"), "pos", "at", F.slice("w.risk_points", 1, 2).alias("points")).where("size(points) > 0")
    warned = w.groupBy("code").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "at", "points"))), lambda x: x["points"])).alias("more"))
    b = d.select("pos", F.posexplode("debate.bull_picks").alias("at", "b")).select(F.col("b.code").alias("code"), F.struct("pos", "at").alias("at"), F.coalesce(F.array_join(F.slice("b.buy_reasons", 1, 2), " | "), F.lit("")).alias("reason"))
    reasons = b.groupBy("code").agg(F.max_by("reason", "at").alias("reason"))
    j = picks.withColumn("_c", F.col("code").cast("string")).join(warned.withColumnRenamed("code", "_c"), "_c", "left").join(reasons.withColumnRenamed("code", "_c"), "_c", "left").drop("_c")
    new = (F.coalesce("reason", F.lit("")) != "") & ~F.array_contains("reasonings", F.col("reason"))
    return j.withColumns({"warnings": F.concat("warnings", F.coalesce("more", F.array().cast("array<string>"))), "expert_reasoning": F.coalesce("reason", F.lit("")), "reasonings": F.when(new, F.concat(F.array("reason"), "reasonings")).otherwise(F.col("reasonings"))}).drop("more", "reason")


def debate_index(logs: DataFrame) -> DataFrame:
    """(code, model, reasoning, experts, score) of every pick in logs(model, pos, debate_log) that names a code."""
    x = debates(logs).select("model", "pos", F.posexplode("debate.picks").alias("at", "p")).where("p.code <> ''")
    return x.select(F.col("p.code").alias("code"), "model", "pos", "at", F.coalesce("p.reasoning", F.lit("")).alias("reasoning"), F.coalesce("p.recommended_by_experts", F.array().cast("array<string>")).alias("experts"), F.coalesce("p.score", F.lit(0.0)).alias("score"))


def arbitration_rows(fused: DataFrame) -> DataFrame:
    """Fused picks as the arbiter reads them: the fused score stands for the final one, and defaults fill what is not known."""
    n = F.col("ballots")
    label = F.when(n >= 3, "strong").when(n >= 2, "medium").otherwise("single")
    have = {c.lower() for c in fused.columns}
    known = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in have else F.lit(default)
    return fused.select("code", known("name", "").alias("name"), known("sector", "").alias("sector"), F.coalesce("borda_mean", F.lit(0.0)).alias("final_score"), F.coalesce("mean_score", F.lit(70.0)).alias("mean_score"), n.alias("experts"), label.alias("consensus"), known("in_l1", True).alias("pass_l1"), known("bonus", 0).alias("bonus"))


def risk_checked(picks: DataFrame, regime: str | Column, most: int = 2) -> DataFrame:
    """picks(code, sector, final_score, position, pos) with state ("approved" or "sector"), scaled and flags.

    At most `most` of a sector stay, the best by final score (none counts as 0), then by pos.  Positions of those that
    stay shrink in proportion where their sum is above the regime's part of the capital (half for an unknown regime).
    """
    sector = F.coalesce(F.nullif(F.trim("sector"), F.lit("")), F.lit("unknown"))
    place = F.row_number().over(Window.partitionBy(sector).orderBy(F.coalesce("final_score", F.lit(0)).desc(), "pos"))
    x = picks.withColumns({"sector": sector, "state": F.when(place <= most, "approved").otherwise("sector")})
    total = x.where("state = 'approved'").agg(F.coalesce(F.sum("position"), F.lit(0.0)).alias("total"))
    name = F.lit(regime) if isinstance(regime, str) else regime
    cap = F.coalesce(F.create_map(*[F.lit(v) for kv in POSITION_CAP.items() for v in kv])[name], F.lit(0.5)) * 100
    x = x.crossJoin(F.broadcast(total)).withColumn("cap", cap)  # one row
    over = (F.col("state") == "approved") & (F.col("total") > F.col("cap"))
    x = x.withColumn("scaled", F.when(over, F.col("position") * F.col("cap") / F.col("total")).when(F.col("state") == "approved", F.col("position")))
    flags = F.array(F.when(F.col("state") == "sector", F.concat(F.lit("sector limit: "), "sector")), F.when(over, F.format_string("position %.1f%% to %.1f%%", F.col("position").cast("double"), F.col("scaled").cast("double"))))
    return x.withColumn("flags", F.filter(flags, lambda f: f.isNotNull()))


def portfolio_summary(checked: DataFrame, bars: DataFrame) -> DataFrame:
    """One row: position sum in use, cap, sectors, diversity, mean volatility of the last 20 bars, and warnings.

    A code's volatility is its mean high-low range over the last 20 bars against the last close in percent; codes with
    fewer bars or no positive close have none.
    """
    ok = checked.where("state = 'approved'")
    n = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("d")))
    tail = bars.join(ok.select("code"), "code", "left_semi").withColumn("_n", n).where("_n <= 20")
    vol = tail.groupBy("code").agg(F.avg(F.col("h") - F.col("l")).alias("range"), F.max(F.when(F.col("_n") == 1, F.col("c"))).alias("last"), F.count("*").alias("k")).where("k = 20 and last > 0")
    j = ok.join(vol.select("code", (F.col("range") / F.col("last") * 100).alias("vol")), "code", "left")
    s = j.agg(F.count("*").alias("n"), F.coalesce(F.least(F.max("total"), F.max("cap")), F.lit(0.0)).alias("used"), F.max("cap").alias("cap"), F.countDistinct("sector").alias("sectors"), F.array_join(F.sort_array(F.collect_set("sector")), ",").alias("names"), F.coalesce(F.avg("vol"), F.lit(0.0)).alias("volatility"))
    s = s.withColumn("diversity", F.col("sectors") / F.greatest("n", F.lit(1)))
    warnings = F.array(F.when(F.col("volatility") > 6, "volatility"), F.when((F.col("diversity") < 0.5) & (F.col("n") >= 4), "diversity"))
    return s.withColumn("warnings", F.array_join(F.filter(warnings, lambda w: w.isNotNull()), ","))


def timing_cut(checked: DataFrame, most: Column | int, regime: str) -> DataFrame:
    """checked with the approved picks beyond the best `most` by final score set to state "timing", with a flag."""
    place = F.row_number().over(Window.partitionBy("state").orderBy(F.coalesce("final_score", F.lit(0)).desc(), "pos"))
    late = (F.col("state") == "approved") & (F.col("_p") > most)
    x = checked.withColumn("_p", place)
    return x.withColumns({"flags": F.when(late, F.concat("flags", F.array(F.lit(f"timing: {regime}")))).otherwise(F.col("flags")), "state": F.when(late, "timing").otherwise(F.col("state"))}).drop("_p")


def refilled(top: DataFrame, ranked: DataFrame, group: str, most: int, item: str = "item", pos: str = "pos") -> DataFrame:
    """top cut to `most` of each group in order, then filled up to its own length from ranked's other items, by the same cap."""
    rest = ranked.join(top.select(item), item, "left_anti")
    both = top.select(item, group, pos, F.lit(0).alias("src")).unionByName(rest.select(item, group, pos, F.lit(1).alias("src")))
    n = F.row_number().over(Window.partitionBy(group).orderBy("src", pos))
    length = top.agg(F.count("*").alias("length"))
    kept = both.withColumn("_n", n).where(F.col("_n") <= most).withColumn("place", F.row_number().over(Window.orderBy("src", pos)).cast("long"))
    return kept.crossJoin(F.broadcast(length)).where("src = 0 or place <= length").select(item, group, "src", "place")  # one row
