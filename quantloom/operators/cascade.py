"""Cascades of sources: rows of the first source that has a key, and fields of the first that has a value.

All sources are read once and meet in one grouping by key; how many there are doesn't add exchanges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _stacked(sources: Sequence[tuple[str, DataFrame]], key: str, fields: Sequence[str]) -> DataFrame:
    out = None
    for priority, (name, rows) in enumerate(sources):
        have = [F.col(f).alias(f) if f in rows.columns else F.lit(None).alias(f) for f in fields]
        part = rows.select(key, F.lit(priority).alias("_priority"), F.lit(name).alias("_source"), *have)
        out = part if out is None else out.unionByName(part)
    return out


def first_rows(sources: Sequence[tuple[str, DataFrame]], fields: Sequence[str], key: str = "code") -> DataFrame:
    """(key, fields, source): each key's whole row from the first source, by priority, that has it; of several rows there the least.

    A null key is a key like any other.  Fields that a source lacks are null.
    """
    x = _stacked(sources, key, fields)
    return x.groupBy(key).agg(F.min(F.struct("_priority", "_source", *fields)).alias("r")).select(key, *(F.col(f"r.{f}").alias(f) for f in fields), F.col("r._source").alias("source"))


def first_fields(sources: Sequence[tuple[str, DataFrame]], fields: Sequence[str], key: str = "code") -> DataFrame:
    """(key, fields, <field>_source): for each field the first source, by priority, that has a value for it; null if none."""
    x = _stacked(sources, key, fields)
    picks = [F.min(F.when(F.col(f).isNotNull(), F.struct("_priority", "_source", f))).alias(f"_{f}") for f in fields]
    g = x.groupBy(key).agg(*picks)
    return g.select(key, *(F.col(f"_{f}.{f}").alias(f) for f in fields), *(F.col(f"_{f}._source").alias(f"{f}_source") for f in fields))


#: A price-earnings ratio above this is taken for a fault of the feed.
LARGEST_PE = 2000


def quote_cascade(sources: Sequence[tuple[str, DataFrame]], authority: DataFrame, fields: Sequence[str], key: str = "code", unit: float = 1e4) -> DataFrame:
    """(key, fields, source, patched): quotes of the first source that has the code, mended from the authority.

    A quote whose pe is missing, 0 or above LARGEST_PE takes pe and pb (at 2 places) and cap (in `unit`s there) from
    authority(code, pe, pb, cap) where that has a value other than 0 (pe, pb, cap) or null; patched lists the fields that it
    took.  Codes that only the authority knows have no row.  fields hold pe, pb and cap.
    """
    named = [*sources, ("authority", authority.select(key, F.round("pe", 2).alias("pe"), F.round("pb", 2).alias("pb"), (F.col("cap") * unit).alias("cap")))]
    x = _stacked(named, key, fields)
    last = len(named) - 1
    own = F.min(F.when(F.col("_priority") < last, F.struct("_priority", "_source", *fields))).alias("r")
    patch = F.min(F.when(F.col("_priority") == last, F.struct("pe", "pb", "cap"))).alias("a")
    g = x.groupBy(key).agg(own, patch).where("r is not null")
    wrong = F.coalesce(F.col("r.pe"), F.lit(0.0)).isin(0.0) | (F.col("r.pe") > LARGEST_PE)
    takes: dict[str, Column] = {f: wrong & F.coalesce(F.col(f"a.{f}") != 0, F.lit(False)) for f in ("pe", "pb", "cap")}
    value = lambda f: F.when(takes[f], F.col(f"a.{f}")).otherwise(F.col(f"r.{f}")) if f in takes else F.col(f"r.{f}")
    patched = F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in takes.items()]))
    return g.select(key, *(value(f).alias(f) for f in fields), F.col("r._source").alias("source"), patched.alias("patched"))
