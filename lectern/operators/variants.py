"""The three narration variants of a lesson."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import VARIANT_KEYS


def saved_variants(variants: DataFrame, key: str = "lesson_id") -> DataFrame:
    """One row per (lesson, lower-cased variant): the one with the highest id. `max_by` combines before the shuffle."""
    row = F.struct("narration", "audio_url")
    return (
        variants.where(F.col("variant").isNotNull())
        .groupBy(key, F.lower("variant").alias("variant"))
        .agg(F.max("id").alias("id"), F.max_by(row, "id").alias("_row"))
        .select(key, "variant", "id", "_row.narration", "_row.audio_url")
    )


def variant_spine(texts: DataFrame, variants: DataFrame, key: str = "lesson_id") -> DataFrame:
    """Exactly three rows per lesson. A saved row counts even if its narration is empty; else the lesson's own text."""
    spine = texts.withColumn("variant", F.explode(F.array(*map(F.lit, VARIANT_KEYS))))
    saved = saved_variants(variants, key).withColumn("_saved", F.lit(True))
    return spine.join(saved.drop("id"), [key, "variant"], "left").select(
        key,
        "variant",
        F.when(F.col("_saved"), F.col("narration")).otherwise(F.col("lesson_text")).alias("text"),
        F.when(F.col("_saved"), F.col("audio_url")).otherwise("").alias("audio_url"),
    )
