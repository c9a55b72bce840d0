"""Counts by grain, role, length and token."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions.text import explode_tokens


def messages_per_conversation(messages: DataFrame) -> DataFrame:
    """How many conversations have n messages."""
    lengths = messages.groupBy("conversation_id").agg(F.count("*").alias("n_messages"))
    return lengths.groupBy("n_messages").agg(F.count("*").alias("n_conversations"))


def messages_by_role(messages: DataFrame) -> DataFrame:
    counts = messages.groupBy("role").agg(F.count("*").alias("n_messages"))
    everything = F.sum("n_messages").over(Window.partitionBy())  # over one row per role
    return counts.withColumn("share", F.col("n_messages") / everything)


def row_counts_by_level(messages: DataFrame) -> DataFrame:
    """Rows at user, conversation and message grain in one row.

    Counted in steps, each reduced in its tasks before the shuffle, instead of a multi-distinct expansion.
    """
    conversations = messages.groupBy("hashed_ip", "conversation_id").agg(F.count("*").alias("n"))
    users = conversations.groupBy("hashed_ip").agg(
        F.sum("n").alias("n"), F.count("conversation_id").alias("conversations")
    )
    return users.agg(
        F.count("hashed_ip").alias("n_users"),
        F.sum("conversations").alias("n_conversations"),
        F.sum("n").alias("n_messages"),
    )


def conversations_per_user(messages: DataFrame) -> DataFrame:
    """Conversations of each user."""
    pairs = messages.select("hashed_ip", "conversation_id").where(F.col("conversation_id").isNotNull()).distinct()
    return pairs.groupBy("hashed_ip").agg(F.count("*").alias("n_conversations"))


def corpus_token_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each token in the corpus."""
    return explode_tokens(df, column).groupBy("token").agg(F.count("*").alias("n"))
