"""The quantitative funnel as one lazy plan: features, gates, regime, scores, merge with patterns, second layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.expr import fixed, series
from quantloom.operators import scoring
from quantloom.operators.crosssec import percentile_rank, share_below, with_regime
from quantloom.operators.indicators import closes, ewm_last, last_bars, last_features
from quantloom.operators.patterns import chart_patterns, pattern_scores
from quantloom.operators.scoring import LIVE, Profile
from quantloom.sources.feeds import stored


def latest_features(bars: DataFrame, profile: str = "live") -> DataFrame:
    """One row a code: the features at its last bar."""
    return last_features(bars, profile)


def prefiltered(bars: DataFrame, basics: DataFrame | None, lhb: DataFrame | None, profile: Profile = LIVE) -> DataFrame:
    """Codes that pass every gate, with valuation, special trades, chip score, ranks and the market's regime.

    The regime counts all codes with enough bars, before the gates: windows over the one row of each code, so the
    features are computed once.
    """
    last = with_regime(latest_features(bars, "live" if profile.valuation else "backtest"))
    if basics is not None:
        last = last.join(basics, "code", "left")
    for condition in scoring.gates(profile).values():
        last = last.where(f"not ({condition})")
    if lhb is not None:
        last = last.join(lhb, "code", "left")
    else:
        last = last.withColumns({"lhb_count": F.lit(0), "net": F.lit(0.0)})
    return last.withColumns({"rps20": percentile_rank("ret20"), "rps60": percentile_rank("ret60"), "chip": F.expr(scoring.CHIP), "lhb_bonus": F.expr(scoring.LHB_BONUS)})


def quant_scores(candidates: DataFrame) -> DataFrame:
    """candidates with quant (0.1 points as whole numbers), by the regime's formula."""
    score = F.when(F.col("regime") == "bear", F.expr(scoring.QUANT_BEAR)).otherwise(F.expr(scoring.QUANT_BULL))
    return candidates.withColumn("quant", fixed(score, 1))


def quant_funnel(bars: DataFrame, basics: DataFrame | None, lhb: DataFrame | None, profile: Profile = LIVE) -> DataFrame:
    """The quant track: the best tenth (bear: twentieth) of the candidates, 20 to 200."""
    scored = quant_scores(prefiltered(bars, basics, lhb, profile))
    return scoring.keep_top(scored, "quant", F.when(F.col("regime") == "bear", 0.05).otherwise(0.10), 20, 200)


def merged_score(quant: str = "quant", pattern: str = "pattern_score", source: str = "source") -> Column:
    """60 % quant score relative to the best, 40 % pattern score of 70; 10 more when both tracks chose it."""
    q = F.col(quant) / F.greatest(F.max(quant).over(Window.partitionBy()), F.lit(1e-9)) * 100
    p = F.least(F.lit(100.0), F.col(pattern) * 100 / 70)
    return q * 0.6 + p * 0.4 + F.when(F.col(source) == "dual", 10).otherwise(0)


def health(bars: DataFrame, window: int = 310) -> DataFrame:
    """(code, n300, dif, dea, ema60, ema60_10) over the last `window` bars, folded in the JVM once a code."""
    cs = closes(bars, window)
    fold = F.aggregate(
        F.slice("cs", F.lit(2), F.greatest(F.size("cs") - 1, F.lit(0))),
        F.struct(F.element_at("cs", 1).alias("a"), F.element_at("cs", 1).alias("b"), F.lit(0.0).alias("dea")),
        lambda s, x: F.struct((s["a"] * (1 - 2 / 13) + x * (2 / 13)).alias("a"), (s["b"] * (1 - 2 / 27) + x * (2 / 27)).alias("b"), (s["dea"] * 0.8 + ((s["a"] * (1 - 2 / 13) + x * (2 / 13)) - (s["b"] * (1 - 2 / 27) + x * (2 / 27))) * 0.2).alias("dea")),
    )
    earlier = F.slice("cs", F.lit(1), F.greatest(F.size("cs") - 10, F.lit(1)))
    return cs.select("code", F.col("n").alias("n300"), fold.alias("m"), ewm_last(F.col("cs"), 2 / 61).alias("ema60"), ewm_last(earlier, 2 / 61).alias("ema60_10")).select("code", "n300", (F.col("m.a") - F.col("m.b")).alias("dif"), F.col("m.dea").alias("dea"), "ema60", "ema60_10")


def second_layer(chosen: DataFrame, bars: DataFrame, profile: Profile = LIVE) -> DataFrame:
    """chosen(code, regime, quant, pattern_score, source) scored again: vetoes, health, volume; the best 5 to 30 stay.

    A back-test looks at 300 bars where the live run has 310, and at its own features.
    """
    use = stored(chosen.select("code", "regime", "quant", "pattern_score", "source"))  # some 200 rows, read three times
    few = bars.join(use.select("code"), "code", "left_semi")  # features and histories of the chosen codes alone
    features, window = ("live", 310) if profile.valuation else ("backtest", 300)
    last = use.join(latest_features(few, features), "code").join(health(few, window), "code")
    last = last.where(f"not ({scoring.FIVE_FALLS}) and not ({scoring.CRASH})")
    last = last.withColumns({"health": F.expr(scoring.HEALTH_L2), "volume": F.expr(scoring.VOLUME_L2)})
    whole = Window.partitionBy()
    q = F.col("quant") / F.greatest(F.max("quant").over(whole), F.lit(1e-9)) * 100
    p = F.when(F.max("pattern_score").over(whole) > 0, F.col("pattern_score") / F.max("pattern_score").over(whole) * 100).otherwise(0.0)
    total = q * 0.4 + p * 0.3 + F.col("health") * 0.2 + F.col("volume") * 0.1 + F.when(F.col("source") == "dual", 5).otherwise(0)
    scored = last.withColumn("l2", fixed(total, 1))
    return scoring.keep_top(scored, "l2", F.when(F.col("regime") == "bear", 0.05).otherwise(0.15), 5, 30)


def merged_tracks(scored: DataFrame, pattern: DataFrame) -> DataFrame:
    """(code, quant_score, pattern_score, source, regime, candidates) from all codes that pass the gates.

    scored: code, quant, regime; pattern: code, bull, excluded (codes that it lacks have no pattern).  The quant track takes
    the best by quant, the pattern track the codes with bullish points; both keep their scores of both kinds.  A code that
    the patterns exclude leaves both tracks, also where it was among the best by quant; candidates counts all of scored.
    """
    share = F.when(F.col("regime") == "bear", 0.05).otherwise(0.10)
    n = F.count("*").over(Window.partitionBy())
    best = F.row_number().over(Window.orderBy(F.desc("quant"), "code")) <= scoring.top_count(n, share, 20, 200)
    x = scored.select("code", "quant", "regime").withColumns({"candidates": n, "in_quant": best}).join(pattern.select("code", "bull", "excluded"), "code", "left")
    bull = F.coalesce("bull", F.lit(0))
    x = x.where(~F.coalesce("excluded", F.lit(False)) & (F.col("in_quant") | (bull > 0)))
    source = F.when(F.col("in_quant") & (bull > 0), "dual").when(F.col("in_quant"), "quant").otherwise("pattern")
    return x.select("code", F.col("quant").alias("quant_score"), bull.alias("pattern_score"), source.alias("source"), "regime", "candidates")


def dual_tracks(spark: SparkSession, bars: DataFrame, basics: DataFrame | None, lhb: DataFrame | None, profile: Profile = LIVE) -> DataFrame:
    """merged_tracks with the chart patterns of all codes that pass the gates.

    The scored codes, one row each, are stored, since scores and patterns both start from them.
    """
    scored = stored(quant_scores(prefiltered(bars, basics, lhb, profile)).select("code", "quant", "regime"))
    found = pattern_scores(spark, chart_patterns(bars.join(scored.select("code"), "code", "left_semi")))
    return merged_tracks(scored, found)


def first_layer(tracks: DataFrame) -> DataFrame:
    """The best of both tracks by merged score; how many follows from the number of codes that passed the gates."""
    x = tracks.withColumn("score", fixed(merged_score("quant_score"), 1))
    share = F.when(F.col("regime") == "bear", 0.05).otherwise(0.10)
    return scoring.keep_top(x, "score", share, 20, 200, rows=F.col("candidates"))


def old_first_layer(bars: DataFrame, amount: float = 2.5, most: int = 150) -> DataFrame:
    """The older strategy's first layer: its gates, fixed points, the best `most` by score (0.1 points as whole numbers)."""
    before = {f"p_{c}{k}": F.lag(c, k).over(series()) for k in (1, 2) for c in ("c", "o", "v")}
    last = last_features(bars, "backtest", before).where("nbar >= 20")
    last = last.where(f"not ({scoring.OLD_GATES}) and not coalesce(amount20 / {Profile.amount_unit} < {amount}, false)")
    points = [(F.col("slope") > 0, 20), (F.col("atr5") < F.col("atr20"), 15), (F.col("near_high") > 0.8, 15), (F.col("yang"), 15), (F.col("amount_ratio") > 1.2, 10)]
    score = percentile_rank("ret20") * 0.25
    for hit, worth in points:
        score = score + F.when(hit, worth).otherwise(0)
    return scoring.keep_top(last.withColumn("score", fixed(score, 1)), "score", 1.0, 0, most)


def old_second_layer(chosen: DataFrame, bars: DataFrame, most: int = 30) -> DataFrame:
    """The older strategy's second layer over old_first_layer's rows: 40 % form, 30 % volume, 30 % momentum.

    Form: means stacked, ranges shrinking, the close above its means, MACD; momentum: share of the chosen with a smaller
    20-bar return, and the 5-bar return.
    """
    few = bars.join(chosen.select("code"), "code", "left_semi")
    week = few.withColumn("c5", F.lag("c", 4).over(series()))
    x = chosen.join(health(few, 300), "code").join(last_bars(week).select("code", "c5"), "code").where("n300 >= 60")
    x = x.withColumn("below", share_below("ret20"))  # before the vetoes
    x = x.where(f"not ({scoring.FIVE_FALLS}) and not ({scoring.CRASH})")
    stacked = F.when((F.col("ma5") > F.col("ma10")) & (F.col("ma10") > F.col("ma20")), 30).when(F.col("ma5") > F.col("ma10"), 15).otherwise(0)
    calm = F.greatest(F.lit(0.0), F.least(F.lit(30.0), (1 - F.col("atr5") / F.greatest(F.col("atr20"), F.lit(0.001))) * 60))
    above = lambda m: F.when(F.col("c") > F.col(m), 15).otherwise(0)
    form = F.least(F.lit(100.0), stacked + calm + above("ma20") + above("ma60") + F.when(F.col("dif") > F.col("dea"), 10).otherwise(0))
    gain = F.least(F.lit(50.0), F.greatest(F.lit(0.0), (F.col("c") - F.col("c5")) / F.col("c5") * 500))
    total = form * 0.4 + F.expr(scoring.VOLUME_L2) * 0.3 + (F.col("below") * 50 + gain) * 0.3
    return scoring.keep_top(x.drop("score", "rank").withColumn("score", fixed(total, 1)), "score", 1.0, 0, most)
