"""Column builders shared by the plans.  All of them stay inside codegen."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


# ---- money and exact ratios -------------------------------------------------

def money(column: Column | str, digits: int = 2) -> Column:
    """Round an exact decimal half-up and hand it out as double."""
    return F.round(_col(column), digits).cast("double")


def steady_sum(column: Column | str) -> Column:
    """Sum of a double column through decimals of ten digits, the same whatever the order of the rows."""
    return F.sum(_col(column).cast("decimal(28,10)")).cast("double")


def steady_mean(column: Column | str) -> Column:
    """Mean of a double column, rounded half up at six digits in decimal arithmetic; null without values."""
    total = F.sum(_col(column).cast("decimal(28,10)"))
    count = F.nullif(F.count(_col(column)), F.lit(0).cast("long"))
    return (total.cast("decimal(38,10)") / count.cast("decimal(20,0)")).cast("double")


def exact_ratio(numerator: Column | str, denominator: Column | str, digits: int = 2) -> Column:
    """``round(numerator / denominator, digits)`` in decimal arithmetic; null when the denominator is 0."""
    top = _col(numerator).cast("decimal(26,2)")
    bottom = F.nullif(_col(denominator).cast("decimal(24,0)"), F.lit(0).cast("decimal(24,0)"))
    return F.round(top / bottom, digits).cast("double")


def share_ratio(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    """``round(100 * part / whole, digits)`` for decimal or integer operands."""
    top = (_col(part) * F.lit(100)).cast("decimal(26,2)")
    bottom = F.nullif(_col(whole).cast("decimal(22,2)"), F.lit(0).cast("decimal(22,2)"))
    return F.round(top / bottom, digits).cast("double")


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Double division with 0 where the denominator is 0 or either side is null."""
    bottom = F.nullif(_col(denominator).cast("double"), F.lit(0.0))
    return F.coalesce(_col(numerator).cast("double") / bottom, F.lit(0.0))


# ---- time -------------------------------------------------------------------

def micros_between(later: Column | str, earlier: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", _col(earlier), _col(later))


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Fractional days from ``earlier`` to ``later``."""
    return micros_between(later, earlier).cast("double") / F.lit(float(MICROS_PER_DAY))


def mean_days(micros: Column | str, rows: Column | str | None = None, digits: int = 2) -> Column:
    """Exact ``round(micros / rows, digits)`` in days, for sums of microseconds."""
    rows = F.lit(1) if rows is None else _col(rows)
    per_row = F.lit(MICROS_PER_DAY).cast("decimal(11,0)")
    return exact_ratio(micros, rows.cast("decimal(13,0)") * per_row, digits)


def month_of(ts: Column | str) -> Column:
    """First instant of the month, independent of the session time zone."""
    column = _col(ts)
    one, zero = F.lit(1), F.lit(0)
    return F.make_timestamp_ntz(F.year(column), F.month(column), one, zero, zero, zero.cast("decimal(16,6)"))


def to_micros(ts: Column | str) -> Column:
    return F.unix_micros(_col(ts).cast("timestamp"))


def from_micros(micros: Column | str) -> Column:
    return F.timestamp_micros(_col(micros)).cast("timestamp_ntz")


def parse_timestamp(text: Column | str) -> Column:
    """Timestamp without zone; unreadable text becomes null."""
    return _col(text).try_cast("timestamp_ntz")


# ---- aggregates -------------------------------------------------------------

def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def avg_positive(column: Column | str) -> Column:
    """Mean over values above 0; null when there are none."""
    column = _col(column)
    return F.avg(F.when(column > 0, column))


# ---- cleaning ---------------------------------------------------------------

def finite(column: Column | str) -> Column:
    """NaN and infinities become null."""
    value = _col(column)
    infinity = F.lit(float("inf"))
    return F.when(~F.isnan(value) & (F.abs(value) != infinity), value)


def to_number(column: Column | str) -> Column:
    """Numeric coercion: unreadable text, NaN and infinities become null."""
    return finite(_col(column).try_cast("double"))


def clip_zero(column: Column | str) -> Column:
    """Values below 0 become 0; null stays null."""
    value = _col(column)
    return F.when(value < 0, F.lit(0).cast("double")).otherwise(value)


# ---- labels -----------------------------------------------------------------

def rule_case(rules: Iterable[tuple[Column, Column | str]], default: Column | str | None = None) -> Column:
    """Ordered rules to a value: the first condition that is true wins."""
    result = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        result = F.when(condition, value) if result is None else result.when(condition, value)
    if result is None:
        raise ValueError("rule_case needs at least one rule")
    if default is not None:
        result = result.otherwise(default if isinstance(default, Column) else F.lit(default))
    return result


def label_map(column: Column | str, labels: dict, default: str | None = None) -> Column:
    """Value to label; unknown values give ``default``."""
    column = _col(column)
    return rule_case([(column == F.lit(key), value) for key, value in labels.items()], default)


def level_order(column: Column | str, levels: list[str], other: int = 99) -> Column:
    """Sort key of a value in a fixed list of levels."""
    return label_map(column, {level: F.lit(i) for i, level in enumerate(levels)}, F.lit(other))


def fixed_value_band(column: Column | str) -> Column:
    """Money bands by fixed limits."""
    value = _col(column)
    # fixed values: band limits and names
    return rule_case(
        [
            (value >= 100_000, "Very High Value"),
            (value >= 50_000, "High Value"),
            (value >= 20_000, "Medium Value"),
        ],
        "Lower Value",
    )


def as_json(*columns: Column | str, keep_null: bool = False) -> Column:
    options = {"ignoreNullFields": "false"} if keep_null else {}
    return F.to_json(F.struct(*columns), options)


def ranked_array(entry: Column, order: Column) -> Column:
    """Entries of a bounded group as an array in ascending ``order``."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("position"), entry.alias("entry"))))
    return F.transform(pairs, lambda pair: pair["entry"])


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column
