"""Causal and interval predicates as Columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .model import interval_parts

AS_OF = "as_of_date"
MODES = ("inclusive", "exclusive")


def q(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def back(column: Column, interval: str, times: int = 1) -> Column:
    """``column`` less an ISO-8601 interval; timestamps where the interval has a part below a day."""
    months, days, seconds = (times * x for x in interval_parts(interval))
    if seconds:
        column = column.cast("timestamp_ntz")
    return column - F.make_interval(F.lit(0), F.lit(months), F.lit(0), F.lit(days), F.lit(0), F.lit(0), F.lit(seconds))


def known(ts: Column, as_of: Column | None = None, mode: str = "inclusive") -> Column:
    """What had happened at the as-of date; a date counts as its midnight."""
    as_of = q(AS_OF) if as_of is None else as_of
    return ts <= as_of if mode == "inclusive" else ts < as_of


def within(ts: Column, interval: str | None, as_of: Column | None = None, mode: str = "inclusive") -> Column:
    """The look-back window, in whole days and with a closed lower end, of what is known."""
    as_of = q(AS_OF) if as_of is None else as_of
    cut = known(ts, as_of, mode)
    if not interval:
        return cut
    day, last = F.to_date(ts), F.to_date(as_of)
    return cut & (day >= F.to_date(back(as_of, interval))) & (day <= last if mode == "inclusive" else day < last)


def baseline(ts: Column, interval: str, as_of: Column | None = None) -> Column:
    """The window before the look-back window, [a - 2w, a - w), in days."""
    as_of = q(AS_OF) if as_of is None else as_of
    day = F.to_date(ts)
    return (day >= F.to_date(back(as_of, interval, 2))) & (day < F.to_date(back(as_of, interval)))
