"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketlens.contracts import IMAGE_FOLDER, NULL_TEXTS


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_texts_to_null(c: Column | str) -> Column:
    """A text from the fixed list of missing-value texts becomes null."""
    c = as_column(c)
    return F.when(~c.isin(*NULL_TEXTS), c)


def nan_to_null(c: Column | str) -> Column:
    """One NaN would turn sums, maxima and quantiles into NaN; null is skipped by all of them."""
    c = as_column(c)
    return F.when(~F.isnan(c), c)


def image_path(product_id: Column | str) -> Column:
    """images/<first three characters of the id>/<id>.jpg"""
    product_id = as_column(product_id)
    return F.concat(
        F.lit(f"{IMAGE_FOLDER}/"), F.substring(product_id, 1, 3), F.lit("/"), product_id, F.lit(".jpg")
    )


def name_length(name: Column | str) -> Column:
    """Length in code points; a missing name has no length."""
    return F.length(as_column(name))


def order_month(date: Column | str) -> Column:
    """Calendar month as 'YYYY-MM'."""
    return F.date_format(as_column(date).cast("date"), "yyyy-MM")


def local_time(c: Column | str) -> Column:
    """Wall-clock timestamp: dates and recency must not depend on the session's time zone."""
    return as_column(c).cast("timestamp_ntz")


def whole_days_between(start: Column, end: Column) -> Column:
    """Whole days from ``start`` to ``end``, rounded down also when negative."""
    gap = end - start
    days = F.extract(F.lit("DAY"), gap)
    short = gap < F.make_dt_interval(days.cast("int"))
    return (days - F.when(short, 1).otherwise(0)).cast("long")


#: Plain decimal numbers; other languages' suffixes (1.0d, 2f) and infinity are none.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^NaN$"


def parsed(c: Column | str, wanted: str) -> Column:
    """Value of a text, null if it has none: finite numbers, and dates with or without separators."""
    c = as_column(c)
    text = c.cast("string")
    if wanted == "double":
        number = F.when(text.rlike(NUMBER), c.try_cast("double"))
        return F.when(F.isnan(number) | (F.abs(number) < float("inf")), number)
    compact = F.when(text.rlike(r"^\s*\d{8}\s*$"), F.regexp_replace(F.trim(text), r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3"))
    return F.coalesce(compact, text).try_cast(wanted) if wanted == "timestamp_ntz" else c.try_cast(wanted)


def money(c: Column | str, scale: int) -> Column:
    """Exact decimal of ``scale`` places, so that a sum does not depend on the order of its rows.

    NaN is missing. An infinite amount, or one with too many digits, is an error, not null.
    """
    digits = 18 if scale <= 4 else 28
    c = as_column(c)
    exact = c.try_cast(f"decimal({digits},{scale})")
    lost = exact.isNull() & c.isNotNull() & ~F.isnan(c.cast("double"))
    return F.when(lost, F.raise_error(F.concat(F.lit("amount cannot be added exactly: "), c.cast("string")))).otherwise(exact)


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over rows where both are present; null when one side is constant."""
    x, y = as_column(x), as_column(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def array_mean(c: Column | str) -> Column:
    c = as_column(c)
    total = F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return F.try_divide(total, F.size(c))


def array_std(c: Column | str, mean: Column) -> Column:
    """Population standard deviation of all elements."""
    c = as_column(c)
    squares = F.aggregate(
        c, F.lit(0.0), lambda acc, v: acc + F.pow(v.cast("double") - mean, F.lit(2))
    )
    return F.sqrt(F.try_divide(squares, F.size(c)))


def stable_bucket(c: Column | str, buckets: int) -> Column:
    """Bucket in 0..buckets-1 from a digest of the value; one value is always in one bucket."""
    head = F.conv(F.substring(F.md5(as_column(c).cast("string")), 1, 8), 16, 10)
    return F.pmod(head.cast("long"), F.lit(buckets).cast("long"))
