"""Column expressions shared by the analyses. All run inside the JVM."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope import schemas as S


def _col(c):
    return c if isinstance(c, Column) else F.col(c)


def safe_ratio(n, d) -> Column:
    """``n / d`` as a double, 0 where the denominator is 0 or missing."""
    n, d = _col(n).cast("double"), _col(d).cast("double")
    return F.when(d.isNull() | (d == 0), F.lit(0.0)).otherwise(n / d)


def open_ratio(n, d) -> Column:
    """``n / d`` as a double, NULL where the denominator is 0."""
    return F.try_divide(_col(n).cast("double"), _col(d).cast("double"))


def zero_if_null(c) -> Column:
    return F.coalesce(_col(c), F.lit(0))


def month_start(d) -> Column:
    return F.trunc(_col(d), "MM")


def month_label(d, pattern="yyyy-MM") -> Column:
    return F.date_format(_col(d), pattern)


def month_from_label(label) -> Column:
    return F.to_date(F.concat(_col(label), F.lit("-01")))


def sum_of(*columns) -> Column:
    """Sum across columns, missing values counting as 0."""
    return reduce(lambda a, b: a + b, [zero_if_null(c) for c in columns])


def lookup(c, mapping: dict, default=None) -> Column:
    """Dictionary recode; keys not in ``mapping`` (and NULL) get ``default``."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _col(c)), F.lit(default))


def sku_label(name="product_name", color="color", size="size", sku="sku_id") -> Column:
    return F.concat(_col(name), F.lit(" "), _col(color).cast("string"), F.lit("/"),
                    _col(size).cast("string"), F.lit("（"), _col(sku).cast("string"),
                    F.lit("）"))


def account_name(customer_id, prefixes=S.CORPORATE_PREFIXES,
                 stems=S.CORPORATE_STEMS) -> Column:
    """Stable display name of an account, chosen by the code points of its id."""
    chars = F.split(_col(customer_id).cast("string"), "")
    points = F.aggregate(chars, F.lit(0), lambda total, c: total + F.ascii(c))

    def pick(words):
        at = (points % F.lit(len(words)) + F.lit(1)).cast("int")
        return F.element_at(F.array(*map(F.lit, words)), at)

    return F.concat(pick(prefixes), pick(stems))


def yen(c) -> Column:
    return F.concat(F.lit("¥"), F.format_number(_col(c), 0))


def yen_short(c) -> Column:
    """Millions with one decimal from a million on, whole money below."""
    amount = _col(c).cast("double")
    millions = F.format_string("%.1f", F.bround(amount / 1e6, 1))
    return F.when(amount >= 1e6, F.concat(F.lit("¥"), millions, F.lit("M"))).otherwise(yen(c))


def value_percent(c, digits=1) -> Column:
    """A value already in percent, as text."""
    return F.concat(F.format_string(f"%.{digits}f", _col(c).cast("double")), F.lit("%"))


def percent_text(ratio, digits=2) -> Column:
    pct = F.bround(_col(ratio).cast("double") * 100, digits)  # halves to even
    return F.concat(F.format_string(f"%.{digits}f", pct), F.lit("%"))


def signed_percent(pct, suffix="") -> Column:
    rounded = F.bround(_col(pct).cast("double"), 1)  # halves to even
    return F.concat(F.format_string("%+.1f", rounded), F.lit("%" + suffix))


def percent_change(current, base) -> Column:
    """Change of ``current`` against ``base`` in percent, NULL on a 0 or missing base."""
    current, base = _col(current).cast("double"), _col(base).cast("double")
    return F.when(base != 0, (current - base) / base * 100)


def decimals_as_double(df: DataFrame) -> DataFrame:
    """Cast decimal results to double once all sums are done."""
    return df.select([F.col(f"`{f.name}`").cast("double").alias(f.name)
                      if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`")
                      for f in df.schema.fields])
