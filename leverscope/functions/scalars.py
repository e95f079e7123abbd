"""Number parsing, null handling and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text a CSV reader takes for a missing cell.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Spellings of a boolean cell.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")

# Fixed pattern: text that reads as a number. The cast alone is too lenient: it
# takes Java suffixes such as '1d' and '1f'.
NUMBER_PATTERN = (
    r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
)


def quoted(name: str) -> Column:
    """The column of that exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def parse_number(text: Column) -> Column:
    """Text to double; anything that is not a number becomes NULL."""
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def parse_boolean(text: Column) -> Column:
    """Text to 1.0 / 0.0; anything that is not a boolean word becomes NULL."""
    return F.when(text.isin(*TRUE_TOKENS), F.lit(1.0)).when(
        text.isin(*FALSE_TOKENS), F.lit(0.0)
    )


def nan_to_null(number: Column) -> Column:
    return F.when(~F.isnan(number), number)


def finite_or_null(number: Column) -> Column:
    return F.when(
        ~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number
    )


def finite_or_zero(number: Column) -> Column:
    return F.coalesce(finite_or_null(number), F.lit(0.0))


def pair_correlation(x: Column, y: Column) -> Column:
    """Pearson over the rows where both sides are present.

    NULL under two pairs or when a side is constant, where ``corr`` would raise.
    """
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_samp(F.when(both, x)) * F.stddev_samp(F.when(both, y))
    return F.try_divide(F.covar_samp(x, y), spread)


def pair_count(x: Column, y: Column) -> Column:
    return F.count_if(x.isNotNull() & y.isNotNull())


def _formatted(number: Column, pattern: str, digits: int) -> Column:
    return F.when(number.isNotNull(), F.format_string(pattern, F.round(number, digits)))


def fixed(number: Column, digits: int) -> Column:
    """A number as text with exactly ``digits`` decimals, halves rounded up."""
    return _formatted(number, f"%.{digits}f", digits)


def signed(number: Column, digits: int) -> Column:
    return _formatted(number, f"%+.{digits}f", digits)
