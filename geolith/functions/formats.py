"""Values as their readers see them: shares, signs, labels, codes, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of derived features, and what they are called.
FEATURE_ENDINGS = (("_lag1", " (last year)"), ("_lag2", " (two years ago)"), ("_slope3", " (trend)"))


def percent(share: Column, digits: int = 1) -> Column:
    """A share as a percentage; unknown ones as n/a."""
    return F.when(share.isNull() | F.isnan(share), "n/a").otherwise(F.format_string(f"%.{digits}f%%", share * 100))


def signed(value: Column, digits: int = 2) -> Column:
    """A number with its sign; unknown ones as n/a."""
    return F.when(value.isNull() | F.isnan(value), "n/a").otherwise(F.format_string(f"%+.{digits}f", value))


def feature_label(name: Column) -> Column:
    """A feature's name in words, what its ending says behind it."""
    label = F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
    for ending, words in reversed(FEATURE_ENDINGS):
        stem = F.substring(name, F.lit(1), F.length(name) - len(ending))
        label = F.when(F.endswith(name, F.lit(ending)), F.concat(F.initcap(F.replace(stem, F.lit("_"), F.lit(" "))), F.lit(words))).otherwise(label)
    return label


def is_iso3(code: Column) -> Column:
    """If a code is three capital letters."""
    return F.coalesce(F.rlike(code, F.lit("^[A-Z]{3}$")), F.lit(False))


def iso_day(compact: Column) -> Column:
    """YYYYMMDD as YYYY-MM-DD; what is no such date is null."""
    return F.date_format(F.try_to_date(compact, "yyyyMMdd"), "yyyy-MM-dd")
