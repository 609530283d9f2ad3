"""The query catalogue: a plan for each operator, and its SQL twin where SQL can say it."""

from . import funnel_queries, fusion_queries, indicator_queries, panel_queries, review_queries, rollup_queries, source_queries, text_queries

QUERIES, ORACLES = {}, {}
for _module in (indicator_queries, funnel_queries, fusion_queries, panel_queries, review_queries, rollup_queries, source_queries, text_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
