"""From messages back to one row per conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.operators.flatten import KEPT_LANGUAGES, NO_LANGUAGE, clean_messages, conversation_id, flatten_messages
from talkloom.runtime import cut, lookup_join

# Separator between messages, message columns without a value per conversation.
SEPARATOR = "\n\n"
MESSAGE_COLUMNS = ["content", "turn_identifier", "role", "timestamp", "language_message"]
TEXT_COLUMNS = ["first_user_content", "all_user_content", "all_assistant_content", "all_content"]


def _joined(said: Column, role: str | None = None) -> Column:
    if role is not None:
        said = F.filter(said, lambda m: m["role"] == role)
    return F.array_join(F.transform(said, lambda m: m["content"]), SEPARATOR)


def conversation_texts(said: Column) -> list[Column]:
    """The four texts of a conversation from its ordered messages. Null contents are skipped in joins; with no
    message of a role the join is empty, and the first user text is null."""
    first = F.get(F.filter(said, lambda m: m["role"] == "user"), F.lit(0))["content"]
    return [
        first.alias("first_user_content"),
        _joined(said, "user").alias("all_user_content"),
        _joined(said, "assistant").alias("all_assistant_content"),
        _joined(said).alias("all_content"),
    ]


def assemble_conversations(messages: DataFrame) -> DataFrame:
    """One row per conversation id: its texts and the first value of every other column.

    One shuffle and one buffer serve all texts. The buffer of a group holds what its result row holds.
    """
    carried = [c for c in messages.columns if c not in ["conversation_id", "pos", *MESSAGE_COLUMNS]]
    grouped = messages.groupBy("conversation_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "turn_identifier", "role", "content"))).alias("said"),
        F.min(F.struct("pos", *carried)).alias("first"),
    )
    return grouped.select(
        "conversation_id",
        *conversation_texts(F.col("said")),
        *[F.col("first")[c].alias(c) for c in carried],
    )


def assemble_sql(messages: DataFrame) -> DataFrame:
    """The same table written in SQL; ordered by position, since both messages of a turn share its identifier."""
    carried = [c for c in messages.columns if c not in ["conversation_id", "pos", *MESSAGE_COLUMNS]]
    first_values = ", ".join(f"min_by(`{c}`, pos) AS `{c}`" for c in carried)
    return messages.sparkSession.sql(
        f"""
        SELECT conversation_id,
               min_by(content, pos) FILTER (WHERE role = 'user') AS first_user_content,
               coalesce(listagg(content, '\\n\\n') WITHIN GROUP (ORDER BY pos)
                        FILTER (WHERE role = 'user'), '') AS all_user_content,
               coalesce(listagg(content, '\\n\\n') WITHIN GROUP (ORDER BY pos)
                        FILTER (WHERE role = 'assistant'), '') AS all_assistant_content,
               coalesce(listagg(content, '\\n\\n') WITHIN GROUP (ORDER BY pos), '') AS all_content,
               {first_values}
        FROM {{messages}}
        GROUP BY conversation_id
        """,
        messages=messages,
    )


def drop_null_texts(conversations: DataFrame, columns: str | list[str] = "first_user_content") -> DataFrame:
    """Drop conversations without the text; an empty text is not null and stays."""
    return conversations.na.drop(subset=[columns] if isinstance(columns, str) else list(columns))


def _assemble_in_row(raw: DataFrame) -> DataFrame:
    """Cleaning and assembly inside each raw row, for rows whose conversation id occurs once."""
    carried = ["conversation_hash", "turn", "lang_conv", "state", "country", "hashed_ip"]
    said = F.transform(
        "conversation",
        lambda m, i: F.struct(
            i.cast("int").alias("pos"), m["turn_identifier"].alias("turn_identifier"), m["role"].alias("role"),
            m["content"].alias("content"), m["language"].alias("language"),
        ),
    )
    empty_turns = F.when(
        F.col("turn") == 1,
        F.transform(F.filter("said", lambda m: m["language"] == NO_LANGUAGE), lambda m: m["turn_identifier"]),
    )
    kept = F.filter(
        "said",
        lambda m: m["language"].isin(KEPT_LANGUAGES)
        & ~F.coalesce(F.array_contains(F.col("empty_turns"), m["turn_identifier"]), F.lit(False)),
    )
    return (
        raw.select(conversation_id().alias("conversation_id"), *carried, said.alias("said"))
        .withColumn("empty_turns", empty_turns)
        .withColumn("said", kept)
        .where(F.size("said") > 0)
        .select("conversation_id", *conversation_texts(F.col("said")), *carried)
    )


def prepare_conversations(raw: DataFrame, null_ids: str = "separate") -> DataFrame:
    """Raw conversations to cleaned, assembled conversations without moving text between executors.

    All messages of a conversation already lie in one raw row, so they are cleaned and joined there. Only rows
    whose id is null or repeated need grouping: they are found from 8-byte hashes of the id columns (ids that share
    a hash by chance are grouped too, which changes nothing) and take the message route.

    A conversation of an unknown user keeps a row of its own. With `null_ids="group"` they make one row, and the result
    equals `assemble_conversations(clean_messages(flatten_messages(raw)))`; that group is as large as they are many.
    """
    if null_ids not in ("group", "separate"):
        raise ValueError("null_ids must be 'group' or 'separate'")
    unknown = F.col("conversation_hash").isNull() | F.col("hashed_ip").isNull()
    key = F.when(~unknown, F.xxhash64("conversation_hash", "hashed_ip"))
    counts = raw.select(key.alias("_key")).groupBy("_key").count()
    shared = cut(counts.where(F.col("_key").isNull() | (F.col("count") > 1)).select("_key"), "shared-ids")
    repeated = shared.where(F.col("_key").isNotNull())
    any_null = not shared.where(F.col("_key").isNull()).isEmpty()
    single, grouped = raw, []
    if any_null and null_ids == "group":
        single, grouped = raw.where(~unknown), [raw.where(unknown)]
    if not repeated.isEmpty():
        keyed = raw.where(~unknown).withColumn("_key", key)
        grouped.append(lookup_join(keyed, repeated, "_key", "left_semi", hot=False).drop("_key"))
        single = lookup_join(single.withColumn("_key", key), repeated, "_key", "left_anti", hot=False).drop("_key")
    result = _assemble_in_row(single)
    for part in grouped:
        messages = part.transform(flatten_messages).transform(clean_messages)
        result = result.unionByName(assemble_conversations(messages))
    return result
