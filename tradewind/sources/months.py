"""Event tables laid out by month, and pruned reads of them."""

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First and last month of a layout, such as ("2019-10", "2019-12").
Months = tuple[str, str]

MONTH = "event_month"
# Where rows go whose time is missing or out of the layout's months.
OUTSIDE = "outside"


def month_of(time: str, months: Months | None = None) -> Column:
    """The month of a time, or ``OUTSIDE``. A month begins with its first instant and ends before the next one's."""
    month = F.date_format(time, "yyyy-MM")
    within = month.isNotNull() if months is None else month.between(*months)
    return F.when(within, month).otherwise(F.lit(OUTSIDE))


def between(events: DataFrame, start: str | dt.datetime, stop: str | dt.datetime, time: str = "event_time") -> DataFrame:
    """Events from ``start`` on and before ``stop``, read from the months in question and from ``OUTSIDE``.

    The condition on the layout column is made of whole months, so it prunes folders; the one on the
    time cuts inside them. Rows outside of the layout's months are found too, as their folder is always read.
    """
    first, last = (dt.datetime.fromisoformat(t) if isinstance(t, str) else t for t in (start, stop))
    final = last - dt.timedelta(microseconds=1)  # the latest instant wanted
    inside = F.col(MONTH).between(first.strftime("%Y-%m"), final.strftime("%Y-%m")) | (F.col(MONTH) == OUTSIDE)
    moment = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
    return events.where(inside & (F.col(time) >= moment(first)) & (F.col(time) < moment(last)))
