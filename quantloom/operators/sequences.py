"""Patterns that the last bars and the last pivots decide, as windows over all series at once.

Flags, divergence from the MACD line, broken supports and stacked means need no search: each is a condition on a few
ordered facts of a series (its last pivot, the last two above a quantile, the top of the last week), which windows by code
and timeframe find together in one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import resample

#: Bars around a pivot by timeframe; bars of a series at least, and pivots; daily bars from which on there are weeks.
AROUND = {"daily": 5, "weekly": 2}
LEAST_BARS, LEAST_PIVOTS, FOR_WEEKS = 30, 3, 100
#: Bars of the top, month, quarter; means apart; quantiles of pivots; slack of a held price; days of a break.
TOP, MONTH, QUARTER, ABOVE, BELOW = 7, 30, 90, 1.08, 0.92
HIGH_QUANTILE, LOW_QUANTILE, HELD, RECENT, MEAN_BARS = 0.7, 0.3, 0.97, 5, 20
KEY = ("code", "timeframe")


def frames(bars: DataFrame) -> DataFrame:
    """bars as daily series, and for codes of FOR_WEEKS bars or more the weeks that end on Friday as weekly ones."""
    daily = bars.select("code", F.lit("daily").alias("timeframe"), "d", *(F.col(c).cast("double").alias(c) for c in "hlcv"))
    many = bars.withColumn("_n", F.count("*").over(Window.partitionBy("code"))).where(F.col("_n") >= FOR_WEEKS).drop("_n")
    weeks = resample(many, "week_friday", "w")
    return daily.unionByName(weeks.select("code", F.lit("weekly").alias("timeframe"), F.col("w").alias("d"), *(F.col(c).cast("double").alias(c) for c in "hlcv")))


def _series_facts(series: DataFrame) -> DataFrame:
    """series with pos, n, back (0 is the last bar), whether a bar is a high or low pivot, and the series' quantiles and last pivot."""
    by, order = Window.partitionBy(*KEY), Window.partitionBy(*KEY).orderBy("d")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def pivot(k: int, column: str, top: bool) -> Column:
        before, after = order.rowsBetween(-k, -1), order.rowsBetween(1, k)
        edge, beyond = (F.max, lambda x, y: x > y) if top else (F.min, lambda x, y: x < y)
        full = (F.col("pos") >= k) & (F.col("pos") < F.col("n") - k)
        return full & beyond(F.col(column), edge(column).over(before)) & beyond(F.col(column), edge(column).over(after))

    x = series.withColumns({"pos": F.row_number().over(order) - 1, "n": F.count("*").over(by)})
    of = lambda column, top: F.coalesce(F.when(F.col("timeframe") == "daily", pivot(AROUND["daily"], column, top)).otherwise(pivot(AROUND["weekly"], column, top)), F.lit(False))
    x = x.withColumns({"high": of("h", True), "low": of("l", False), "back": F.col("n") - 1 - F.col("pos")})
    pivots = F.sum(F.col("high").cast("int") + F.col("low").cast("int")).over(by)
    x = x.withColumns({
        "pivots": pivots, "q_high": F.percentile("h", F.lit(HIGH_QUANTILE)).over(by), "q_low": F.percentile("l", F.lit(LOW_QUANTILE)).over(by), "v_mid": F.percentile("v", F.lit(0.5)).over(by),
        "last_pivot": F.max(F.when(F.col("high") | F.col("low"), F.col("pos"))).over(by),
        "top": F.min_by("pos", F.when(F.col("back") < TOP, F.struct(-F.col("h"), F.col("pos")))).over(whole), "bottom": F.min_by("pos", F.when(F.col("back") < TOP, F.struct(F.col("l"), F.col("pos")))).over(whole),
    })
    return x.where((F.col("n") >= LEAST_BARS) & (F.col("pivots") >= LEAST_PIVOTS))


def _dif(closes: Column, upto: Column) -> Column:
    """The MACD line after the bar at `upto`: two recursive means over the closes from the first one on."""
    part = F.slice(closes, F.lit(2), F.greatest(upto, F.lit(0)))
    first = F.element_at(closes, 1)
    step = lambda s, x: F.struct((s["a"] + (x - s["a"]) * (2 / 13)).alias("a"), (s["b"] + (x - s["b"]) * (2 / 27)).alias("b"))
    m = F.aggregate(part, F.struct(first.alias("a"), first.alias("b")), step)
    return m["a"] - m["b"]


def sequence_patterns(series: DataFrame) -> DataFrame:
    """(code, timeframe, pattern, direction, points): FLAGU, FLAGD, MACD_DIV, BREAK_SUPPORT, MA_BULL, MA_BEAR.

    series: code, timeframe, d, h, l, c, v (see frames); one of fewer than LEAST_BARS bars or LEAST_PIVOTS pivots has none, a
    bar that is a high and a low counting as two.  points is a map of (bar, price) for flags, empty for others.

    FLAGU: the highest high of the last TOP bars (the first of equals) is the highest of MONTH and QUARTER bars, not on the
    last bar; the 20-bar mean is ABOVE times the 50-bar mean or more; no low since is under the middle between the last pivot
    and the top.  FLAGD is its mirror.  MACD_DIV: of the last two pivots at or above the high quantile the later holds HELD of the
    earlier's price on a lower MACD line, which isn't at or above 0 at both.  BREAK_SUPPORT: one of the last RECENT closes is
    under the last pivot that is at or below the low quantile on more than the median volume, on more than the mean volume of
    the last MEAN_BARS.
    """
    x = _series_facts(series)
    back, pos = F.col("back"), F.col("pos")
    when = lambda c, v: F.when(c, F.col(v) if isinstance(v, str) else v)
    mean = lambda k: F.avg(when(back < k, "c")).alias(f"m{k}")
    # the pivots that count, the last two of them; a bar's low stands behind its high
    pivot = lambda side, price: F.when(F.col(side), F.struct(pos.alias("pos"), F.lit(side == "low").cast("int").alias("at"), F.col(price).alias("p"), F.col("v").alias("v")))
    both = F.array_compact(F.array(pivot("high", "h"), pivot("low", "l")))
    strong = F.filter(both, lambda s: s["p"] >= F.col("q_high"))
    held = F.filter(both, lambda s: (s["p"] <= F.col("q_low")) & (s["v"] > F.col("v_mid")))
    g = x.groupBy(*KEY).agg(
        F.max("n").alias("n"), *(mean(k) for k in (5, 20, 50, 60)), F.max("pivots").alias("pivots"),
        *(F.first(c).alias(c) for c in ("last_pivot", "top", "bottom")),
        F.max(when(pos == F.col("top"), "h")).alias("top_h"), F.max(when(back < MONTH, "h")).alias("month_h"), F.max(when(back < QUARTER, "h")).alias("quarter_h"), F.min(when(pos >= F.col("top"), "l")).alias("since_l"),
        F.min(when(pos == F.col("bottom"), "l")).alias("bottom_l"), F.min(when(back < MONTH, "l")).alias("month_l"), F.min(when(back < QUARTER, "l")).alias("quarter_l"), F.max(when(pos >= F.col("bottom"), "h")).alias("since_h"),
        F.max(when(pos == F.col("last_pivot"), F.greatest(when(F.col("high"), "h"), when(F.col("low"), "l")))).alias("pivot_max"), F.min(when(pos == F.col("last_pivot"), F.least(when(F.col("high"), "h"), when(F.col("low"), "l")))).alias("pivot_min"),
        F.slice(F.sort_array(F.flatten(F.collect_list(strong)), asc=False), 1, 2).alias("strong"), F.max(F.array_max(held)).alias("support"),
        F.array_sort(F.collect_list(F.when(back < RECENT, F.struct("pos", "c", "v")))).alias("recent"), F.avg(when(back < MEAN_BARS, "v")).alias("mean_v"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda s: s["c"]).alias("closes"),
    )
    last = F.col("n") - 1
    quarter = lambda q, m: F.when(F.col("n") >= QUARTER, F.col(q)).otherwise(F.col(m))
    up = (F.col("n") >= 50) & (F.col("top") != last) & (F.col("top_h") >= F.col("month_h")) & (F.col("top_h") >= quarter("quarter_h", "month_h"))
    up = up & (F.col("m20") >= F.col("m50") * ABOVE) & (F.col("since_l") >= (F.col("pivot_max") + F.col("top_h")) / 2)
    down = (F.col("n") >= 50) & (F.col("bottom") != last) & (F.col("bottom_l") <= F.col("month_l")) & (F.col("bottom_l") <= quarter("quarter_l", "month_l"))
    down = down & (F.col("m20") <= F.col("m50") * BELOW) & (F.col("since_h") <= (F.col("pivot_min") + F.col("bottom_l")) / 2)
    now, before = F.get("strong", F.lit(0)), F.get("strong", F.lit(1))
    dif = lambda s: _dif(F.col("closes"), s["pos"])
    fades = (F.col("n") >= 60) & (F.size("strong") == 2) & (now["p"] >= before["p"] * HELD) & (dif(now) < dif(before)) & (dif(now) < 0)
    broken = F.col("support").isNotNull() & F.exists("recent", lambda r: (r["pos"] > F.col("support.pos")) & (r["c"] < F.col("support.p")) & (r["v"] > F.col("mean_v")))
    many = F.col("n") >= 60
    point = lambda bar, price: F.struct(F.col(bar).cast("long").alias("bar"), F.col(price).alias("price"))
    points = lambda *x: F.create_map(*x) if x else F.create_map().cast("map<string,struct<bar:long,price:double>>")
    rules = [
        ("FLAGU", "bullish", up, points(F.lit("A"), point("last_pivot", "pivot_max"), F.lit("B"), point("top", "top_h"))), ("FLAGD", "bearish", down, points(F.lit("A"), point("last_pivot", "pivot_min"), F.lit("B"), point("bottom", "bottom_l"))),
        ("MACD_DIV", "bearish", fades, points()), ("BREAK_SUPPORT", "bearish", broken, points()),
        ("MA_BULL", "bullish", many & (F.col("m5") > F.col("m20")) & (F.col("m20") > F.col("m60")), points()), ("MA_BEAR", "bearish", many & (F.col("m5") < F.col("m20")) & (F.col("m20") < F.col("m60")), points()),
    ]
    rows = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(name).alias("pattern"), F.lit(side).alias("direction"), p.alias("points"))) for name, side, c, p in rules]))
    return g.select(*KEY, F.explode(rows).alias("r")).select(*KEY, "r.*")
