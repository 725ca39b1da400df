"""Numbers and running sums over many rows, without one task that sees all rows or all rows of one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.sources.shared import saved

#: Rows of a key from which on they are dealt to several tasks.
HOT_ROWS = 1_000_000


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds `name`, 1.. over all rows by `order`, whose columns together should tell rows apart.

    Rows are dealt by range of `order`, so no value of its first columns makes a part large, and written
    with their part. They are numbered within parts; only the parts' counts meet in one place.
    """
    dealt = saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", before.alias("_base"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("bigint")
    numbered = dealt.withColumn("_k", within).join(F.broadcast(parts), "_part")  # a row for each part
    return numbered.withColumn(name, F.col("_base") + F.col("_k")).drop("_part", "_k", "_base")


def split_hot(df: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys with up to `most` rows, and those of keys with more, if there are any. Counts combine before they meet."""
    hot = df.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("_hot")
    if hot.isEmpty():
        return df, None
    hot = saved(hot, "hot-keys")
    same = F.col(key).eqNullSafe(F.col("_hot"))
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def dealt_by_range(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """df as a table with `_part`: rows by range of (key, order), so a key's rows lie in parts that follow each other, however many they are."""
    return saved(df.repartitionByRange(F.col(key).asc_nulls_first(), *order).withColumn("_part", F.spark_partition_id()), "dealt")


def running_sum(df: DataFrame, key: str, order: list[Column], value: Column, name: str, most: int = HOT_ROWS) -> DataFrame:
    """Adds `name`, the sum of `value` over the rows of the same key up to and with this one, by `order`; nulls are a key too.

    Keys with more than `most` rows are dealt by range of the order: sums within parts, plus what the parts before hold of the key.
    """
    upto = lambda *keys: F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    few, many = split_hot(df, key, most)
    plain = few.withColumn(name, upto(key))
    if many is None:
        return plain
    dealt = dealt_by_range(many, key, order)
    each = dealt.groupBy("_part", F.col(key).alias("_key")).agg(F.sum(value).alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = each.select(F.col("_part").alias("_of"), "_key", before.alias("_base"))  # hot keys have few rows here: one for each part they touch
    summed = dealt.withColumn("_sum", upto("_part", key)).join(base, (F.col("_part") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")))
    return plain.unionByName(summed.withColumn(name, F.col("_base") + F.col("_sum")).select(*df.columns, name))


def number_within(df: DataFrame, key: str, order: list[Column], name: str, most: int = HOT_ROWS) -> DataFrame:
    """Adds `name`, 1.. over the rows of each key by `order`."""
    return running_sum(df, key, order, F.lit(1).cast("bigint"), name, most)
