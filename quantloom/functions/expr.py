"""Column helpers and the rules that both a plan and a SQL text use."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def fixed(column: Column | str, places: int = 4) -> Column:
    """The value as a whole number of 10^-places, so that results compare exactly between engines."""
    c = F.col(column) if isinstance(column, str) else column
    return F.floor(c * float(10**places) + 0.5).cast("long")


def rounded(column: Column | str, places: int = 0) -> Column:
    """The double rounded to so many places, halves away from zero, as SQL engines do it: the product with 10^places is what is
    rounded.  F.round rounds the shortest decimal text instead, which differs where the product is just off a half.
    """
    c = F.col(column) if isinstance(column, str) else column
    x = c.cast("double") * float(10**places)
    return F.when(F.abs(x) % 1.0 == 0.5, x + F.signum(x) * 0.5).otherwise(F.rint(x)) / float(10**places)


def rounded_even(column: Column | str, places: int = 0) -> Column:
    """As rounded, halves to the even digit; a negative value keeps its sign at zero."""
    c = F.col(column) if isinstance(column, str) else column
    return F.rint(c.cast("double") * float(10**places)) / float(10**places)


def printed(column: Column | str, places: int, sign: str = "+") -> Column:
    """The double as printf shows it: its exact binary value rounded, halves to the even digit (for less than 1e6).

    x * 10^places is the exact sum of two doubles, of x's first 24 bits and of the rest; F.format_string rounds the shortest
    decimal text instead.
    """
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    scale = float(10**places)
    x = F.abs(c)
    head = x.cast("float").cast("double")
    whole = F.floor(head * scale).cast("double")
    over = (head * scale - whole - 0.5) + (x - head) * scale
    n = whole + F.when((over > 0) | ((over == 0) & (whole % 2 == 1)), 1.0).when(over < -1, -1.0).otherwise(0.0)
    minus = c.cast("string").startswith("-")
    return F.format_string(f"%{sign}.{places}f", F.when(minus, -n).otherwise(n) / scale)


def series(order: str = "d", *by: str) -> WindowSpec:
    """One security's bars in date order."""
    return Window.partitionBy(*(by or ("code",))).orderBy(order)


def trailing(n: int, *by: str, order: str = "d") -> WindowSpec:
    """The last n bars including the current one."""
    return series(order, *by).rowsBetween(-(n - 1), 0)


def safe_number(column: Column | str, default: float = 0.0) -> Column:
    """A number from text; what is no number becomes the default."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.try_cast("double"), F.lit(float(default)))
