"""Adapter from a flat turn table `(conv_id, turn, role, text)` to nested raw conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: matches text with a character outside ASCII.
NON_ASCII = r"[^\x00-\x7F]"


def nest_turns(turns: DataFrame) -> DataFrame:
    """One raw conversation per `conv_id`, in the raw log schema.

    The grouping holds one conversation, which is also one value of the result. Hashes, users and languages are
    derived from ids and text so that hash collisions, users with several conversations and empty prompts occur.
    """
    grouped = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("spoken"),
        F.sum((F.col("role") == "user").cast("bigint")).alias("turn"),
        F.max(F.col("text").rlike(NON_ASCII)).alias("non_ascii"),
    )
    conv = F.col("conv_id")
    grouped = grouped.select(
        conv,
        "spoken",
        "turn",
        "non_ascii",
        F.md5((conv % 60).cast("string")).alias("conversation_hash"),
        F.md5(F.floor(conv / 3).cast("string")).alias("hashed_ip"),
        F.concat(F.lit("State "), (conv % 5).cast("string")).alias("state"),
        F.when(conv % 4 == 0, "France").when(conv % 4 == 1, "Canada").otherwise("India").alias("country"),
        F.timestamp_seconds(F.lit(1_700_000_000) + conv * 60).alias("timestamp"),
        F.struct(
            F.lit("en-US").alias("accept-language"), F.lit("browser").alias("user-agent")
        ).alias("header"),
    )

    def message(said, pos):
        empty_prompt = (F.col("turn") == 1) & (conv % 2 == 0) & (pos == 0)
        language = (
            F.when(empty_prompt | ((conv * 7 + pos * 3) % 23 == 0), "Nolang")
            .when(conv % 11 == 0, "Latin")
            .when(said["text"].rlike(NON_ASCII), "French")
            .otherwise("English")
        )
        return F.struct(
            said["text"].alias("content"),
            F.col("country").alias("country"),
            F.col("hashed_ip").alias("hashed_ip"),
            F.col("header").alias("header"),
            language.alias("language"),
            F.lit(False).alias("redacted"),
            said["role"].alias("role"),
            F.col("state").alias("state"),
            F.col("timestamp").alias("timestamp"),
            F.lit(False).alias("toxic"),
            F.floor(pos / 2).cast("bigint").alias("turn_identifier"),
        )

    return grouped.select(
        "conversation_hash",
        F.concat(F.lit("model-"), (conv % 2).cast("string")).alias("model"),
        "timestamp",
        F.transform("spoken", message).alias("conversation"),
        "turn",
        F.when(F.col("non_ascii") & (conv % 5 != 0), "French").otherwise("English").alias("language"),
        F.lit(False).alias("toxic"),
        F.lit(False).alias("redacted"),
        "state",
        "country",
        "hashed_ip",
        "header",
    )
