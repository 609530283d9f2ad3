"""A security's profile over longer periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.expr import fixed, rounded, rounded_even, series


def period_profile(periods: DataFrame, unit: str, lags: tuple[int, ...], means: tuple[int, ...], recent: int, least: int) -> DataFrame:
    """(code, <unit><lag>..., <unit>_ma<n>..., <unit>_volume) at each code's last period, as whole numbers of 0.01.

    periods: code, w, c, v by month or week.  Changes are in percent against the close so many periods before, null where there
    are not so many; means are over the periods that there are, but the longest only with enough of them; volume is the mean
    of the `recent` last periods against that of all (1 at least).  Codes of fewer than `least` periods have no row.
    """
    w, by = series("w"), Window.partitionBy("code")
    change = lambda k: rounded((F.col("c") - F.lag("c", k).over(w)) / F.lag("c", k).over(w) * 100, 2)
    mean = lambda m: F.avg("c").over(w.rowsBetween(-(m - 1), 0))
    n = F.count("*").over(by)
    columns = {f"{unit}{k}": fixed(change(k), 2) for k in lags} | {f"{unit}_ma{m}": fixed(mean(m) if m < max(means) else F.when(n >= m, mean(m)), 2) for m in means}
    columns[f"{unit}_volume"] = fixed(F.avg("v").over(w.rowsBetween(-(recent - 1), 0)) / F.greatest(F.avg("v").over(by), F.lit(1)), 2)
    x = periods.withColumns({**columns, "_n": n, "_back": F.row_number().over(by.orderBy(F.desc("w")))})
    return x.where((F.col("_back") == 1) & (F.col("_n") >= least)).select("code", *columns)


def recent_change(bars: DataFrame, back: int = 20) -> DataFrame:
    """(code, change, days): each code's last close against the one `back` bars before, or its first, in percent, and how many
    bars lie between; codes of two bars at least.
    """
    w = series()
    n = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("d")))
    base = F.first("c").over(w.rowsBetween(-back, 0))
    x = bars.where("c is not null").withColumns({"_n": n, "_base": base, "_all": F.count("*").over(Window.partitionBy("code"))})
    change = (F.col("c") - F.col("_base")) / F.greatest(F.col("_base").cast("double"), F.lit(0.01)) * 100
    return x.where((F.col("_n") == 1) & (F.col("_all") >= 2)).select("code", change.alias("change"), F.least(F.lit(back), F.col("_all") - 1).alias("days"))


def _number(c: Column | str, form: str) -> Column:
    """The number as a text, null for null; halves go to the even digit, as a decimal print does."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    places = int(form[-2])
    return F.when(c.isNotNull(), F.format_string(form, rounded_even(c, places)))


def slim_profile(facts: DataFrame) -> DataFrame:
    """(code, profile): what is known of a security in one line of marked parts; unknown parts are left out.

    facts: code, name, and, each null where unknown: sector, pe, pb, cap, price (texts or numbers, shown as they are), change, days,
    forecast, forecast_range, holder_change, rps, goodwill_ratio, pledge_ratio, trades, discount, margin_change, score, signal,
    bias, avg_cost, profit_ratio, concentration, inflow, virtual (boolean).  The first line of numbers is always there, with N/A
    for what is unknown; trades of 0, a score of 0 and an empty forecast say nothing; a discount of 0 is none.
    """
    text = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other))
    part = lambda label, value: F.concat(F.lit(label), value)  # noqa: E731  null if the value is
    sign = lambda c, up, down: F.when(F.col(c) > 0, up).otherwise(down)
    head = F.concat(F.col("code").cast("string"), F.lit(" "), text("name", ""), F.lit(" | 板块:"), text("sector", "未知"), F.lit(" | PE="), text("pe", "N/A"), F.lit(" PB="), text("pb", "N/A"), F.lit(" 市值="), text("cap", "N/A"), F.lit(" 现价="), text("price", "N/A"), F.lit(" 近20日="), F.coalesce(F.concat(_number("change", "%+.1f"), F.lit("%("), F.col("days").cast("string"), F.lit("日)")), F.lit("N/A")))
    holders = F.concat(F.when(F.col("holder_change") < 0, "减少").otherwise("增加"), _number(F.abs("holder_change"), "%.1f"), F.lit("%"))
    pledged = F.concat_ws(" ", part("商誉率=", F.concat(F.col("goodwill_ratio").cast("string"), F.lit("%"))), part("质押率=", F.concat(_number("pledge_ratio", "%.1f"), F.lit("%"))))
    trades = F.when(F.col("trades") > 0, F.concat(F.col("trades").cast("string"), F.lit("笔"), F.coalesce(F.when(F.col("discount") != 0, F.concat(F.lit("折价"), F.col("discount").cast("string"), F.lit("%"))), F.lit(""))))
    margin = F.concat(sign("margin_change", "增", "减"), _number(F.abs("margin_change"), "%.1f"), F.lit("%"))
    chip = F.concat_ws(" ", part("均成本=", F.col("avg_cost").cast("string")), part("获利比=", F.concat(_number(F.col("profit_ratio") * 100, "%.0f"), F.lit("%"))), part("集中度=", _number("concentration", "%.3f")), part("5日主力净流入=", F.concat(_number("inflow", "%.0f"), F.lit("万"))))
    signal = F.when(F.col("score") > 0, F.concat(F.col("score").cast("string"), F.lit("分("), text("signal", ""), F.lit(") 乖离率(MA5)="), F.coalesce(_number("bias", "%+.1f"), F.lit("+0.0")), F.lit("%")))
    rest = [
        part("业绩预告:", F.when(F.col("forecast") != "", F.concat("forecast", text("forecast_range", "")))), part("股东户数:", F.when(F.col("holder_change").isNotNull(), holders)), part("板块RPS=", F.col("rps").cast("string")), F.nullif(pledged, F.lit("")),
        part("大宗交易:", trades), part("融资余额5日:", F.when(F.col("margin_change").isNotNull(), margin)), part("筹码: ", F.nullif(chip, F.lit(""))), part("量化评分=", signal),
    ]
    line = F.concat_ws(" | ", head, *rest)
    return facts.select("code", F.concat(line, F.when(F.coalesce("virtual", F.lit(False)), " [盘中实时]").otherwise("")).alias("profile"))


def profile_field(profile: Column | str, label: str, form: str = r"[+\-]?[\d.]+%?") -> Column:
    """The value after a label in a profile's text; '' if it isn't there."""
    return F.coalesce(F.regexp_extract(profile, rf"{label}=({form})", 1), F.lit(""))
