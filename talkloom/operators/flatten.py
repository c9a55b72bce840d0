"""From nested conversations to cleaned messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.runtime import cut, lookup_join

# Names shared by messages and conversations, columns not carried on, languages kept.
SHARED_NAMES = ["language", "country", "state", "hashed_ip", "header"]
NESTED_DUPLICATES = ["hashed_ip_nested", "header_nested", "state_nested", "country_nested"]
NOT_CARRIED = [*NESTED_DUPLICATES, "toxic", "user-agent", "accept-language", "redacted", "model"]
NOT_CARRIED_LIGHT = [*NESTED_DUPLICATES, "toxic", "language_nested"]
KEPT_LANGUAGES = ["English", "Latin"]
NO_LANGUAGE = "Nolang"


def conversation_id() -> Column:
    """Hash and user joined; null if either is null (`concat_ws` would skip it)."""
    return F.concat("conversation_hash", F.lit("_"), "hashed_ip")


def explode_messages(raw: DataFrame) -> DataFrame:
    """One row per message, with its position, which every later "first" and "join" is ordered by."""
    others = [F.col(f"`{c}`") for c in raw.columns if c != "conversation"]
    return raw.select(*others, F.posexplode("conversation").alias("pos", "message"))


def rename_message_fields(exploded: DataFrame) -> DataFrame:
    """Suffix `_nested` to the message fields that also exist on the conversation."""
    fields = exploded.schema["message"].dataType.names
    renamed = F.struct(
        *[F.col("message")[f].alias(f"{f}_nested" if f in SHARED_NAMES else f) for f in fields]
    )
    return exploded.withColumn("message", renamed)


def unnest(df: DataFrame, *structs: str) -> DataFrame:
    """Replace struct columns by their fields."""
    columns = []
    for name in df.columns:
        if name in structs:
            columns += [F.col(name)[f].alias(f) for f in df.schema[name].dataType.names]
        else:
            columns.append(F.col(f"`{name}`"))
    return df.select(*columns)


def flatten_messages(raw: DataFrame, drop: list[str] = NOT_CARRIED) -> DataFrame:
    """Message table: explode, rename, unnest, drop, id. Column names come from the schema, no job is run."""
    present = [c for c in ("message", "header") if c == "message" or c in raw.columns]
    flat = raw.transform(explode_messages).transform(rename_message_fields).transform(unnest, *present).drop(*drop)
    if "language_nested" in flat.columns:
        flat = flat.withColumnRenamed("language_nested", "language_message")
    return flat.withColumn("conversation_id", conversation_id())


def empty_prompt_turns(messages: DataFrame) -> DataFrame:
    """Turns of single-round conversations that hold a message without language."""
    return (
        messages.where((F.col("turn") == 1) & (F.col("language_message") == NO_LANGUAGE))
        .select("conversation_id", "turn_identifier")
        .distinct()
    )


def first_message_turns(messages: DataFrame) -> DataFrame:
    """Turns whose opening message (position 0) has no language, whatever the length of the conversation."""
    return (
        messages.where((F.col("pos") == 0) & (F.col("language_message") == NO_LANGUAGE))
        .select("conversation_id", "turn_identifier")
        .distinct()
    )


def drop_empty_turns(messages: DataFrame, scope: str = "single_round") -> DataFrame:
    """Remove both messages of a turn with an empty prompt.

    The turns are few and are found without reading texts. They are cut, so that they can be broadcast after a check
    of their number, which spares the texts a shuffle; without any, the anti join is a no-op.
    """
    if scope not in ("single_round", "first_message"):
        raise ValueError("scope must be 'single_round' or 'first_message'")
    turns = empty_prompt_turns(messages) if scope == "single_round" else first_message_turns(messages)
    return lookup_join(messages, cut(turns, "empty-turns"), ["conversation_id", "turn_identifier"], "left_anti", hot=False)


def remove_nolang(messages: DataFrame) -> DataFrame:
    """Drop messages without language; an unknown (null) language stays."""
    return messages.where(~F.col("language_message").eqNullSafe(NO_LANGUAGE))


def keep_english_latin(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("language_message").isin(KEPT_LANGUAGES))


def clean_messages(messages: DataFrame, scope: str = "single_round") -> DataFrame:
    return messages.transform(drop_empty_turns, scope).transform(remove_nolang).transform(keep_english_latin)

