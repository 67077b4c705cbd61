"""Column expressions of the catalogue clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinerank.sources.schemas import GENRE_COLUMNS


def flag_name(name: str) -> Column:
    """The flag's name where the flag is 1, else NULL."""
    return F.when(F.col(f"`{name}`") == 1, F.lit(name))


def genre_array(names: Sequence[str] = GENRE_COLUMNS) -> Column:
    """Names of the set flags as an array, in the order of ``names``."""
    return F.array_compact(F.array(*[flag_name(name) for name in names]))


def genre_text(names: Sequence[str] = GENRE_COLUMNS) -> Column:
    """Names of the set flags joined with commas; no flag gives ''."""
    return F.concat_ws(",", *[flag_name(name) for name in names])


def parse_release_date(text: Column) -> Column:
    """'01-Jan-1995' or '4-Feb-1971' as a date; anything else is NULL."""
    return F.try_to_date(text, "d-MMM-yyyy")


def epoch_to_utc(seconds: Column) -> Column:
    """Unix seconds as a UTC wall-clock timestamp, whatever the session zone."""
    return F.timestamp_add("SECOND", seconds, F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))


def default_title(title: Column) -> Column:
    """A rated film that the catalogue lacks is shown as 'Unknown'."""
    return F.coalesce(title, F.lit("Unknown"))
