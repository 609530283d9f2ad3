"""Rule scores as expressions over feature columns (operators.indicators.with_features).

The texts are valid in Spark and in ANSI SQL, so a plan and its SQL twin say the same rule.  Numbers in them are the
fixed values of the scoring model.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    """Thresholds of the gates; the defaults are the model's, tests scale them to their data."""

    drop: float = -0.03
    cap_low: float = 40
    cap_high: float = 1500
    pe_low: float = 10
    pe_high: float = 60
    limit_gain: float = 0.099
    amount: float = 2.5
    amount_unit: float = 1e8 / 100
    min_bars: int = 60
    valuation: bool = True
    limit_up: bool = True


LIVE, BACKTEST = Profile(), Profile(valuation=False, limit_up=False)


def gates(p: Profile = LIVE) -> dict[str, str]:
    """Conditions that drop a security at its last bar, by name; a null never drops."""
    out = {
        "history": f"nbar < {p.min_bars}",
        "double_drop": f"coalesce((prev_c - c2) / cast(c2 as double) < {p.drop} and (c2 - c3) / cast(c3 as double) < {p.drop}, false)",
        "liquidity": f"coalesce(amount20 / {p.amount_unit} < {p.amount}, false)",
    }
    if p.valuation:
        out["valuation"] = f"coalesce(mktcap < {p.cap_low} or mktcap > {p.cap_high}, false) or coalesce(pe > {p.pe_high} or pe < {p.pe_low}, false)"
    if p.limit_up:
        out["limit_up"] = f"coalesce(abs(c - h) < 0.01 and (c - prev_c) / cast(prev_c as double) > {p.limit_gain}, false)"
    return out


FIVE_FALLS = "coalesce(falls5 >= 5, false)"
CRASH = "coalesce((c - prev_c) / cast(prev_c as double) < -0.07, false)"

CHIP = """(case when v5_60 between 0.6 and 0.9 then 40 when v5_60 >= 0.5 and v5_60 < 0.6 or v5_60 > 0.9 and v5_60 <= 1.0 then 20 else 0 end
+ case when vcv < 0.5 then 30 when vcv < 0.7 then 15 else 0 end + case when pcv < 0.05 then 30 when pcv < 0.08 then 15 else 0 end)"""

LHB_BONUS = """case when coalesce(lhb_count, 0) > 0 then least(5, 2 * lhb_count) + case when net >= 5 then 15 when net >= 1 then 10 when net > 0 then 5 when net < -1 then -5 else 0 end else 0 end"""

QUANT_BULL = """(rps20 * 0.2 + rps60 * 0.1 + case when slope > 0 then 10 + least(5, slope * 200) else 0 end + case when atr_ratio < 1 then 5 + least(5, (1 - atr_ratio) * 15) else 0 end
+ greatest(0, least(20, (near_high - 0.6) / 0.4 * 20)) + case when yang then 10 else 0 end
+ case when amount_ratio >= 1 and amount_ratio <= 2 then 10 when amount_ratio >= 0.7 and amount_ratio < 1 then (amount_ratio - 0.7) / 0.3 * 10 when amount_ratio > 2 and amount_ratio <= 3 then (3 - amount_ratio) * 10 else 0 end
+ case when atr_ratio < 0.7 then 5 else 0 end + chip / 10.0 + lhb_bonus)"""

QUANT_BEAR = """(case when slope > 0 then 15 + least(10, slope * 300) else 0 end + case when atr_ratio < 1 then 15 + least(10, (1 - atr_ratio) * 30) else 0 end + rps20 * 0.1 + rps60 * 0.05
+ case when near_high > 0.75 then 10 + least(5, (near_high - 0.75) / 0.25 * 5) when near_high > 0.6 then (near_high - 0.6) / 0.15 * 10 else 0 end
+ case when amount_ratio between 0.5 and 1.2 then 15 else 0 end + case when c > ma20 and ma20 > 0 then 5 else 0 end + chip / 10.0 * 1.5 + lhb_bonus * 0.8)"""

VOLUME_L2 = """least(100, case when v5 * 10 < v20 * 8 then 40 when v5 < v20 then 20 else 0 end + greatest(0, least(30, 40 - 40 * vsd5 / greatest(v5, 1))) + case when c > o and v * 2 < v20 * 3 then 30 else 0 end)"""

HEALTH_L2 = """least(100, case when dif > dea then 20 + case when dif > 0 then 10 else 0 end else 0 end + case when c > ema60 then 15 else 0 end + case when n300 >= 71 and ema60 > ema60_10 then 15 else 0 end
+ case when c > ma60 * 0.95 then 15 else 0 end + case when n300 >= 100 and c >= max100 * 0.95 then 25 else 0 end)"""

# -- the 100-point signal
SIGNAL_TREND = "case when ma5 > ma10 and ma10 > ma20 then 30 when ma5 > ma10 then 26 when ma5 > ma20 then 18 else 12 end"
SIGNAL_BIAS = "case when bias < -3 then 20 when bias >= -1 and bias <= 2 then 18 when bias > 2 and bias <= 5 then 14 else 4 end"
SIGNAL_VOLUME = """case when c < prev_c and vr < 0.8 then 15 when c > prev_c and vr > 1.2 then 12 when vr >= 0.8 and vr <= 1.2 then 10 when c > prev_c and vr < 0.8 then 6 else 0 end"""
SIGNAL_SUPPORT = "case when c >= ma5 and ma5 >= c * 0.98 then 5 else 0 end + case when c >= ma10 and ma10 >= c * 0.97 then 5 else 0 end"
SIGNAL_MACD = "case when dif > 0 and dea > 0 and hist > 0 then 15 when hist > 0 and p_hist <= 0 then 12 when hist > 0 then 8 else 3 end"
SIGNAL_RSI = "case when rsi6 < 30 then 10 when rsi6 >= 60 and rsi6 < 70 then 8 when rsi6 >= 40 and rsi6 < 60 then 5 when rsi6 >= 30 and rsi6 < 40 then 3 else 0 end"
SIGNAL_LABEL = """case when total >= 75 and ma5 > ma10 and ma10 > ma20 and ma20 > ma60 then 'STRONG_BUY' when total >= 60 and ma5 > ma10 then 'BUY' when total >= 45 then 'HOLD' when total >= 30 then 'WAIT' else 'SELL' end"""

# -- the older strategy, kept as the baseline of comparisons
OLD_GATES = """coalesce(ma5 < ma10 and ma10 < ma20, false) or coalesce(c < o and p_c1 < p_o1 and p_c2 < p_o2, false) or coalesce(c < p_c1 and p_c1 < p_c2 and v < p_v1 and p_v1 < p_v2, false)"""


def top_count(rows: Column, share: Column | float, low: int, high: int) -> Column:
    """floor(rows * share) within bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(rows * share)))


def keep_top(scored: DataFrame, score: str, share: Column | float, low: int, high: int, tie: str = "code", rows: Column | None = None) -> DataFrame:
    """The best rows by score, as many as top_count says, with `rank`; the count is a window, not an action."""
    n = F.count("*").over(Window.partitionBy()) if rows is None else rows
    ranked = scored.withColumns({"rank": F.row_number().over(Window.orderBy(F.desc(score), tie)).cast("long"), "_n": top_count(n, share, low, high)})
    return ranked.where("rank <= _n").drop("_n")
