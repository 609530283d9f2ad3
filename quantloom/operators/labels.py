"""Labels as rules over named columns; the texts are valid in Spark and in ANSI SQL."""

#: States of four moving averages.
ALIGNMENT = """case when ma5 > ma10 and ma10 > ma20 and ma20 > ma60 then 'strong bull' when ma5 > ma10 and ma10 > ma20 then 'bull'
when ma5 < ma10 and ma10 < ma20 and ma20 < ma60 then 'strong bear' when ma5 < ma10 and ma10 < ma20 then 'bear' else 'tangled' end"""

#: Crossing first, then the zone and whether the histogram widens; p_ marks the bar before.
MACD_STATUS = """case when dif > dea and p_dif <= p_dea then case when dif > 0 and dea > 0 then 'golden cross above zero' else 'golden cross below zero' end
when dif < dea and p_dif >= p_dea then case when dif > 0 and dea > 0 then 'death cross above zero' else 'death cross below zero' end
when dif > 0 and dea > 0 then case when hist > p_hist then 'bull widening' else 'bull narrowing' end
else case when hist > p_hist then 'bear narrowing' else 'bear widening' end end"""

TREND = "case when c > ma5 and ma5 > ma10 and ma10 > ma20 then 'up' when c < ma5 and ma5 < ma10 and ma10 < ma20 then 'down' else 'mixed' end"

#: From the share of securities above their 20-bar mean and the mean 20-bar return; comparisons are strict.
REGIME = "case when breadth > 0.55 and mean_ret > 0.01 then 'bull' when breadth < 0.40 or mean_ret < -0.02 then 'bear' else 'neutral' end"
