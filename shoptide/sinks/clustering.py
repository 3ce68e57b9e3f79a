"""Rows in Morton order (Z-order) of several columns, so that reads by any one of them skip most row groups by their statistics.

Each column gives a number of ``bits`` bits: the place of its value among the table's own quantiles, so skewed values are spread evenly. The bits of
all columns in turn make the code. The rows are dealt into files by ranges of it and sorted within each; a file is then narrow in every column.
Within a code the columns themselves and the ties decide, so one code, or one value that a third of the rows hold, may go over many files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE = "_morton_code"


def quantiles(df: DataFrame, by: dict[str, str], bits: int) -> tuple[int, dict[str, list]]:
    """Number of rows, and 2^bits - 1 cuts of each column: one pass, whose size for the driver does not grow with the rows."""
    parts = 1 << bits
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.percentile_approx(F.expr(c), [i / parts for i in range(1, parts)]).alias(n) for n, c in by.items()]).first()
    return row["_n"], {n: row[n] or [] for n in by}


def with_code(df: DataFrame, by: dict[str, str], cuts: dict[str, list], bits: int) -> DataFrame:
    """``df`` with its code; a value that is null has the first place."""
    def place(name: str) -> Column:
        bounds, value = F.array(*[F.lit(c) for c in cuts[name]]), F.expr(by[name])
        return F.size(F.filter(bounds, lambda c: c <= value)).cast("bigint") if cuts[name] else F.lit(0).cast("bigint")

    places = {f"_place_{name}": place(name) for name in by}
    code = F.lit(0).cast("bigint")
    for at, name in enumerate(places):
        for bit in range(bits):
            code = code + F.shiftleft(F.shiftright(F.col(name), bit).bitwiseAND(F.lit(1)), bit * len(by) + len(by) - 1 - at)
    return df.withColumns(places).withColumn(CODE, code).drop(*places)


def clustered(df: DataFrame, by: dict[str, str], ties: list[str], bits: int = 6, rows_per_file: int = 2_000_000) -> DataFrame:
    """The rows of ``df``, dealt and sorted for :meth:`BatchTables.commit`; ``by`` names numeric SQL expressions, the one that narrows most first.

    ``df`` is read three times (quantiles, ranges, rows), so give a stored or held one. Names that begin like ``_morton_code`` and ``_place_`` are taken.
    The number of files follows the number of rows; an empty table gives no rows.
    """
    if len(by) * bits > 62:
        raise ValueError("the codes of so many columns and bits do not fit a BIGINT")
    rows, cuts = quantiles(df, by, bits)
    order = [F.col(CODE), *map(F.expr, by.values()), *map(F.col, ties)]
    return (with_code(df, by, cuts, bits).repartitionByRange(max(1, -(-rows // rows_per_file)), *order)
            .sortWithinPartitions(*order).drop(CODE))
