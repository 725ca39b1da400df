"""Single rows by a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _single(n: Column, what: Column) -> Column:
    """True; running it fails where n is not 1."""
    return F.when(n == 1, True).otherwise(F.raise_error(F.concat(what, F.lit(": rows found: "), n.cast("string"))).cast("boolean"))


def by_key(df: DataFrame, column: str, value, strict: bool = False) -> DataFrame:
    """The row whose column equals value; no row if there is none.

    strict: running the result fails if there is not exactly one. The count is taken of the
    matching rows alone, with the filter still at the scan.
    """
    found = df.where(F.col(column) == value)
    if not strict:
        return found
    checked = found.agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*df.columns)).alias("_row"))
    return checked.where(_single(F.col("_n"), F.lit(f"{column} = {value}"))).select("_row.*")


def attach_or_null(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """df with the columns of the other table's row of the same key, null where there is none.

    Running the result fails if a key of df has several rows there. The other table is brought to a row a key first, so nothing fans out.
    """
    rest = [c for c in other.columns if c != key]
    one = other.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_row"))
    joined = df.join(one, key, "left")
    right = F.col("_n").isNull() | _single(F.col("_n"), F.concat(F.lit(f"{key} = "), F.col(key).cast("string")))
    return joined.where(right).select(*df.columns, *[F.col("_row").getField(c).alias(c) for c in rest])


def with_keys(df: DataFrame, column: str, keys: DataFrame, most: int = 1000) -> DataFrame:
    """Rows of df whose column has a value of the one column of `keys`; nulls match nothing.

    Up to `most` distinct keys are named in a filter, which the scan tests file by file and row group by row group; more are a
    semi join. Few keys must be cheap to find, as they are asked for at once.
    """
    name = keys.columns[0]
    values = [r[0] for r in keys.where(F.col(name).isNotNull()).distinct().limit(most + 1).collect()]
    if len(values) <= most:
        return df.where(F.col(column).isin(values)) if values else df.where("false")
    return df.join(keys.where(F.col(name).isNotNull()).withColumnRenamed(name, column), column, "left_semi").select(*df.columns)
