"""Column and header expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = "DATE"


def upper_headers(df: DataFrame) -> DataFrame:
    """Every column header in upper case; the rows are untouched."""
    return df.toDF(*[name.upper() for name in df.columns])


def hashable(kind: T.DataType) -> bool:
    """Can Spark hash values of the type?  Maps and variants it cannot."""
    text = kind.simpleString()
    return "map<" not in text and "variant" not in text


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def day_column(df: DataFrame, name: str = DAY) -> str:
    """The frame's own spelling of its day column, whatever the case."""
    found = [c for c in df.columns if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"need one {name} column, found {found or 'none'} in {df.columns}")
    return found[0]


def with_day(df: DataFrame, name: str = DAY) -> DataFrame:
    """The day column cast to DATE under its canonical name, in its old position.

    Text that is no date becomes NULL rather than failing the job.
    """
    found = day_column(df, name)
    return df.select(
        *[
            as_day(F.col(quoted(c))).alias(name) if c == found else F.col(quoted(c))
            for c in df.columns
        ]
    )


def as_day(value: Column) -> Column:
    return value.try_cast("date")


def mail_domain(company: Column) -> Column:
    """Company name as a mail domain: no space, dot or comma, lower case."""
    return F.lower(F.translate(company, " .,", ""))


def mail_address(first: Column, last: Column, domain: Column) -> Column:
    return F.concat(F.lower(first), F.lit("."), F.lower(last), F.lit("@"), domain, F.lit(".com"))


def first_word(phrase: Column) -> Column:
    return F.substring_index(phrase, " ", 1)
