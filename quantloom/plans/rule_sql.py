"""The rules of scores, gates and labels once more as SQL, written from their definition for the SQL twins alone.

The plans say the same rules in operators.scoring and operators.labels; nothing here is made of those texts, so that a
threshold that is wrong in one of them shows.  Ratios against a threshold are whole-number comparisons where they can be.
"""

from __future__ import annotations

#: Gates at the thresholds that the fixture's smooth prices need (see funnel_queries.SCALED).
GATES_SCALED = {
    "history": "not coalesce(nbar >= 60, false)",
    "double_drop": "coalesce((prev_c - c2) * 1000 < -3 * c2 and (c2 - c3) * 1000 < -3 * c3, false)",
    "liquidity": "coalesce(amount20 < 600, false)",
    "valuation": "not (coalesce(mktcap between 40 and 1500, true) and coalesce(pe between 10 and 60, true))",
    "limit_up": "coalesce(c = h and (c - prev_c) * 2000 > prev_c, false)",
}
#: Gates of the back-test: no valuation, no limit-up lock; falls beyond 3 %, amounts below 2.5e8 in lots of 100.
GATES_BACKTEST = "(nbar < 60 or coalesce((prev_c - c2) * 100 < -3 * c2 and (c2 - c3) * 100 < -3 * c3, false) or coalesce(amount20 * 100 / 1e8 < 2.5, false))"
FIVE_FALLS = "coalesce(falls5 = 5, false)"
CRASH = "coalesce((c - prev_c) * 100 < -7 * prev_c, false)"

CHIP = "(if(v5_60 >= 0.5 and v5_60 <= 1.0, if(v5_60 >= 0.6 and v5_60 <= 0.9, 40, 20), 0) + if(vcv < 0.7, if(vcv < 0.5, 30, 15), 0) + if(pcv < 0.08, if(pcv < 0.05, 30, 15), 0))"
LHB_BONUS = "if(lhb_count > 0, if(lhb_count >= 3, 5, lhb_count * 2) + if(net < -1, -5, if(net >= 5, 15, if(net >= 1, 10, if(net > 0, 5, 0)))), 0)"
QUANT_BULL = """(0.2 * rps20 + 0.1 * rps60 + if(slope > 0, 10 + if(slope * 200 < 5, slope * 200, 5), 0) + if(atr_ratio < 1, 5 + if((1 - atr_ratio) * 15 < 5, (1 - atr_ratio) * 15, 5), 0)
+ if(near_high <= 0.6, 0, if(near_high >= 1, 20, (near_high - 0.6) / 0.4 * 20)) + if(yang, 10, 0)
+ if(amount_ratio >= 0.7 and amount_ratio <= 3, if(amount_ratio < 1, (amount_ratio - 0.7) / 0.3 * 10, if(amount_ratio <= 2, 10, (3 - amount_ratio) * 10)), 0) + if(atr_ratio < 0.7, 5, 0) + 0.1 * chip + lhb_bonus)"""
QUANT_BEAR = """(if(slope > 0, 15 + if(slope * 300 < 10, slope * 300, 10), 0) + if(atr_ratio < 1, 15 + if((1 - atr_ratio) * 30 < 10, (1 - atr_ratio) * 30, 10), 0) + 0.1 * rps20 + 0.05 * rps60
+ if(near_high > 0.75, 10 + if((near_high - 0.75) * 20 < 5, (near_high - 0.75) * 20, 5), if(near_high > 0.6, (near_high - 0.6) / 0.15 * 10, 0)) + if(amount_ratio >= 0.5 and amount_ratio <= 1.2, 15, 0) + if(c > ma20 and ma20 > 0, 5, 0) + chip * 0.15 + lhb_bonus * 0.8)"""
REGIME = "if(breadth > 0.55 and mean_ret > 0.01, 'bull', if(breadth >= 0.40 and mean_ret >= -0.02, 'neutral', 'bear'))"
VOLUME_L2 = "least(100, if(v5 * 10 < v20 * 8, 40, if(v5 < v20, 20, 0)) + greatest(0, least(30, 40 - 40 * vsd5 / greatest(v5, 1))) + if(c > o and v * 2 < v20 * 3, 30, 0))"
HEALTH_L2 = "least(100, if(dif > dea, if(dif > 0, 30, 20), 0) + 15 * cast(c > ema60 as int) + if(n300 > 70 and ema60 > ema60_10, 15, 0) + if(c > ma60 * 0.95, 15, 0) + if(n300 > 99 and c >= max100 * 0.95, 25, 0))"

SIGNAL = {
    "trend": "if(ma5 > ma10, if(ma10 > ma20, 30, 26), if(ma5 > ma20, 18, 12))",
    "bias_score": "if(bias < -3, 20, if(bias < -1, 4, if(bias <= 2, 18, if(bias <= 5, 14, 4))))",
    "volume": "if(vr < 0.8, if(c < prev_c, 15, if(c > prev_c, 6, 0)), if(vr <= 1.2, 10, if(c > prev_c, 12, 0)))",
    "support": "if(ma5 <= c and ma5 >= c * 0.98, 5, 0) + if(ma10 <= c and ma10 >= c * 0.97, 5, 0)",
    "macd": "if(hist > 0, if(dif > 0 and dea > 0, 15, if(p_hist <= 0, 12, 8)), 3)",
    "rsi": "if(rsi6 < 30, 10, if(rsi6 < 40, 3, if(rsi6 < 60, 5, if(rsi6 < 70, 8, 0))))",
}
SIGNAL_LABEL = "if(total >= 75 and ma5 > ma10 and ma10 > ma20 and ma20 > ma60, 'STRONG_BUY', if(total >= 60 and ma5 > ma10, 'BUY', if(total < 30, 'SELL', if(total < 45, 'WAIT', 'HOLD'))))"

ALIGNMENT = "if(ma5 > ma10 and ma10 > ma20, if(ma20 > ma60, 'strong bull', 'bull'), if(ma5 < ma10 and ma10 < ma20, if(ma20 < ma60, 'strong bear', 'bear'), 'tangled'))"
MACD_STATUS = """if(sign(dif - dea) = 1 and sign(p_dif - p_dea) < 1, 'golden cross ' || if(least(dif, dea) > 0, 'above', 'below') || ' zero', if(sign(dif - dea) = -1 and sign(p_dif - p_dea) > -1, 'death cross ' || if(least(dif, dea) > 0, 'above', 'below') || ' zero',
if(least(dif, dea) > 0, 'bull ' || if(hist > p_hist, 'widening', 'narrowing'), 'bear ' || if(hist > p_hist, 'narrowing', 'widening'))))"""
TREND = "if(c > ma5 and ma5 > ma10 and ma10 > ma20, 'up', if(c < ma5 and ma5 < ma10 and ma10 < ma20, 'down', 'mixed'))"
#: The older strategy: means stacked downwards, three down candles, price and volume falling for three days.
OLD_GATES = "(coalesce(ma20 > ma10 and ma10 > ma5, false) or coalesce(o > c and p_o1 > p_c1 and p_o2 > p_c2, false) or coalesce(p_c2 > p_c1 and p_c1 > c and p_v2 > p_v1 and p_v1 > v, false))"
