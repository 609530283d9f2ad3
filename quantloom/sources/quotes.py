"""Positional quote feeds: one line a security, fields by number, and what doesn't parse with the reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions.expr import rounded, safe_number


@dataclass(frozen=True)
class Layout:
    """Where a feed has its values, counted from 0: a text or number at a place, or the first that is not empty of several."""

    separator: str
    least: int
    code: int | None  # None: the symbol is the variable's last part, after two letters of its market
    name: int
    numbers: tuple[tuple[str, tuple[int, ...], float], ...]  # name, places by preference, factor


#: Fixed places of the two feeds; market values come in units of 1e8.
TILDE = Layout(
    "~", 47, 2, 1,
    (("last", (3,), 1), ("previous", (4,), 1), ("open", (5,), 1), ("high", (41, 33), 1), ("low", (42, 34), 1), ("volume", (36,), 1), ("amount", (37,), 1), ("turnover", (38,), 1), ("pe", (39,), 1),
     ("swing", (43,), 1), ("float_cap", (44,), 1e8), ("cap", (45,), 1e8), ("pb", (46,), 1)),
)
COMMA = Layout(",", 10, None, 0, (("open", (1,), 1), ("previous", (2,), 1), ("last", (3,), 1), ("high", (4,), 1), ("low", (5,), 1), ("volume", (8,), 1), ("amount", (9,), 1)))
#: Why a line is no quote.
NO_VARIABLE, NO_VALUE, SHORT = "no variable", "no value", "too few fields"


def parse_quotes(lines: DataFrame, layout: Layout, column: str = "value") -> DataFrame:
    """A row for each statement of each line, with `reason`, null for quotes: code, name, the layout's numbers, change, raw.

    Statements end at a semicolon (or with the line) and read variable="fields"; blank ones count as none.  One without an
    equals sign has NO_VARIABLE as its reason, one whose value is empty NO_VALUE, one with fewer than the layout's fields
    SHORT; these have null in all columns but raw and reason.  What is no number is 0, as is an empty field; a number with
    several places takes the first that is not empty.  change is the last price against the previous in percent, at 2 places,
    and null unless the previous is above 0.  Null lines give no rows.
    """
    split_ = F.transform(F.split(F.col(column), ";"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    x = lines.select(F.explode(split_).alias("raw")).where("raw <> ''")
    at = F.instr("raw", "=")
    value = F.regexp_replace(F.substr(F.col("raw"), at + 1), r'^\s*"*|"*\s*$', "")
    x = x.withColumns({"_at": at, "_value": F.when(at > 0, value)})
    x = x.withColumn("_p", F.split("_value", "\\" + layout.separator, -1))
    reason = F.when(F.col("_at") == 0, NO_VARIABLE).when(F.col("_value") == "", NO_VALUE).when(F.size("_p") < layout.least, SHORT)
    x = x.withColumn("reason", reason)
    field = lambda k: F.get("_p", F.lit(k))

    def number(places: tuple[int, ...], factor: float) -> Column:
        first = F.coalesce(*[F.when(field(k) != "", field(k)) for k in places])
        return safe_number(first) * F.lit(float(factor))

    if layout.code is not None:
        code = field(layout.code)
    else:
        variable = F.element_at(F.split(F.substr(F.col("raw"), F.lit(1), F.greatest(F.col("_at") - 1, F.lit(0))), "_"), -1)
        code = F.substr(variable, F.lit(3))
    good = lambda c: F.when(F.col("reason").isNull(), c)
    x = x.select("raw", "reason", good(code).alias("code"), good(field(layout.name)).alias("name"), *(good(number(places, factor)).alias(n) for n, places, factor in layout.numbers))
    change = rounded((F.col("last") - F.col("previous")) / F.col("previous") * 100, 2)
    return x.withColumn("change", F.when(F.col("previous") > 0, change))


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(quotes, rejects): the rows of parse_quotes without a reason, one for each code; those with one as (raw, reason).

    Of several quotes of a code the greatest raw stays, so that a rerun gives the same.
    """
    quotes = parsed.where("reason is null").drop("reason")
    fields = [c for c in quotes.columns if c not in ("code", "raw")]
    one = quotes.groupBy("code").agg(F.max_by(F.struct(*fields), "raw").alias("q")).select("code", "q.*")
    return one, parsed.where("reason is not null").select("raw", "reason")


def quote_lines(quotes: DataFrame, layout: Layout, variable: Column) -> Column:
    """A statement in the layout from columns named as in it: what a feed would have written."""
    places = {k: F.col(n) / factor if factor != 1 else F.col(n) for n, ks, factor in layout.numbers for k in ks[:1]}
    places |= {layout.name: F.col("name")} | ({layout.code: F.col("code")} if layout.code is not None else {})
    fields = [F.coalesce(places[k].cast(T.StringType()), F.lit("")) if k in places else F.lit("") for k in range(layout.least)]
    return F.concat(variable, F.lit('="'), F.concat_ws(layout.separator, *fields), F.lit('";'))
