"""Queries on conversations: scans, flattening, cleaning, assembly, counts. Each maps to (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.checks.oracles import MESSAGES, tokens
from talkloom.operators import assemble, flatten, lemma, stats
from talkloom.plans.prepare import prepare_tables
from talkloom.runtime import scratch_path
from talkloom.sources import raw as sources
from talkloom.sources.turns import nest_turns

ASSEMBLED = (
    "conversation_id, first_user_content, all_user_content, all_assistant_content, all_content, conversation_hash, "
    "turn, lang_conv, state, country, hashed_ip"
)
FLAT = (
    "conversation_id, conversation_hash, hashed_ip, turn, lang_conv, state, country, pos, turn_identifier, role, content, "
    "language_message"
)


def nested(spark: SparkSession, sf: str) -> DataFrame:
    return nest_turns(spark.read.parquet(f"{sf}/conversations.parquet"))


def stored(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "raw")
    sources.write_table(nested(spark, sf), path)
    return path


def english(spark: SparkSession, sf: str) -> DataFrame:
    """English raw conversations as `scan_raw` returns them, without the detour over files."""
    raw = nested(spark, sf).drop(*sources.UNUSED_COLUMNS)
    return raw.where(F.col("language") == "English").withColumnRenamed("language", "lang_conv")


def messages(spark, sf) -> DataFrame:
    return flatten.flatten_messages(english(spark, sf))


def cleaned(spark, sf) -> DataFrame:
    return flatten.clean_messages(messages(spark, sf))


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c.strip()) for c in FLAT.split(",")]).withColumn("pos", F.col("pos").cast("bigint"))


def _raw_counts(df: DataFrame) -> DataFrame:
    return df.select(
        "conversation_hash", "hashed_ip", "turn", "lang_conv", "state", "country",
        F.size("conversation").cast("bigint").alias("n_messages"),
    )


RAW_SQL = f"""WITH {MESSAGES} SELECT conversation_hash, hashed_ip, turn, lang_conv, state, country, count(*) AS n_messages
FROM messages GROUP BY ALL"""


def scan_raw_english(spark, sf):
    return _raw_counts(sources.scan_raw(spark, f"{stored(spark, sf)}/*.parquet"))


def scan_single_file(spark, sf):
    """One of several files: each state's conversations are written to a file of their own, in a folder with a plain name."""
    path = scratch_path(spark, "raw-by-state")
    raw = nested(spark, sf).withColumn("part", F.regexp_replace("state", "[^A-Za-z0-9]", "_"))
    raw.repartition("part").write.partitionBy("part").parquet(path)
    return _raw_counts(sources.scan_raw(spark, f"{path}/part=State_1"))


def schema_struct_fields(spark, sf):
    """Fields of the message struct, found in the schema, with the number of messages that have a value."""
    raw = nested(spark, sf)
    fields = sources.message_fields(raw)
    exploded = flatten.explode_messages(raw)
    counts = exploded.agg(*[F.count(F.col("message")[f]).alias(f) for f in fields])
    return counts.unpivot([], fields, "field", "n")


def explode_messages(spark, sf):
    m = flatten.explode_messages(nested(spark, sf))
    return m.select("conversation_hash", "hashed_ip", F.col("pos").cast("bigint").alias("pos"), "message.role", "message.content")


def rename_struct_fields(spark, sf):
    m = flatten.rename_message_fields(flatten.explode_messages(english(spark, sf)))
    return m.select("conversation_hash", "lang_conv", "country", F.col("pos").cast("bigint").alias("pos"), "message.content",
                    "message.language_nested", "message.country_nested", "message.hashed_ip_nested", "message.state_nested")


def unnest_structs(spark, sf):
    m = flatten.rename_message_fields(flatten.explode_messages(english(spark, sf)))
    flat = flatten.unnest(m, "message", "header")
    return flat.select("conversation_hash", "hashed_ip", F.col("pos").cast("bigint").alias("pos"), "role", "content",
                       "language_nested", "model", F.col("accept-language"), F.col("user-agent"))


def drop_columns_light(spark, sf):
    raw = english(spark, sf)
    flat = flatten.flatten_messages(raw, drop=flatten.NOT_CARRIED_LIGHT)
    return flat.drop("timestamp", "redacted").withColumn("pos", F.col("pos").cast("bigint"))


def conversation_ids(spark, sf):
    return english(spark, sf).select(flatten.conversation_id().alias("conversation_id"), "turn")


def carry_first(spark, sf):
    a = assemble.assemble_conversations(cleaned(spark, sf))
    return a.select("conversation_id", "conversation_hash", "turn", "lang_conv", "state", "country", "hashed_ip")


def _text_query(column):
    return lambda spark, sf: assemble.assemble_conversations(cleaned(spark, sf)).select("conversation_id", column)


def sink_conversations(spark, sf):
    path = scratch_path(spark, "conversations")
    sources.write_table(assemble.prepare_conversations(english(spark, sf)), path)
    return sources.scan_columns(spark, path, [c.strip() for c in ASSEMBLED.split(",")])


def drop_null_messages(spark, sf):
    a = assemble.assemble_conversations(cleaned(spark, sf))
    return assemble.drop_null_texts(a).select("conversation_id", "first_user_content")


def _joined_tokens(df, column="first_user_content_tokens", key="conversation_id"):
    return df.select(key, F.array_join(column, " ").alias("tokens"), F.size(column).cast("bigint").alias("n_tokens"))


def process_message_tokens(spark, sf):
    done, _ = lemma.process_message_tokens(assemble.prepare_conversations(english(spark, sf)), "first_user_content")
    return _joined_tokens(done)


def prepared_conversations(spark, sf):
    """Scan to written tables: raw files, cleaned conversations, tokens, vocabulary."""
    tables = prepare_tables(spark, f"{stored(spark, sf)}/*.parquet", scratch_path(spark, "prepared"))
    return _joined_tokens(tables["conversations"])


def prepared_vocabulary(spark, sf):
    tables = prepare_tables(spark, f"{stored(spark, sf)}/*.parquet", scratch_path(spark, "prepared"))
    return tables["vocabulary"].select("term", "idx")


_CONV_TERMS = f"""WITH {MESSAGES},
conv_lists AS (SELECT conversation_id, {tokens('first_user_content')} AS tokens FROM assembled
               WHERE first_user_content IS NOT NULL),
conv_words AS (SELECT conversation_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM conv_lists),
{{lemmas}}"""


def _conv_sql(select: str) -> str:
    from talkloom.checks.oracles import IRREGULAR_ROWS, RULE

    lemmas = f"""irregular(token, listed) AS (VALUES {IRREGULAR_ROWS}),
conv_terms AS (SELECT conversation_id, pos, coalesce(listed, {RULE}) AS term FROM conv_words LEFT JOIN irregular USING (token))
"""
    return _CONV_TERMS.replace("{lemmas}", lemmas) + select


TOKENS_SQL = _conv_sql("""SELECT conversation_id, coalesce(string_agg(term, ' ' ORDER BY pos), '') AS tokens,
count(term) AS n_tokens FROM conv_lists LEFT JOIN conv_terms USING (conversation_id) GROUP BY conversation_id""")
VOCAB_SQL = _conv_sql("""SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM (SELECT DISTINCT term FROM conv_terms)""")


def _m(select: str) -> str:
    return f"WITH {MESSAGES} {select}"


QUERIES = {
    "scan_raw_english": (scan_raw_english, RAW_SQL),
    "scan_single_file": (
        scan_single_file, RAW_SQL.replace("FROM messages GROUP", "FROM messages WHERE state = 'State 1' GROUP")
    ),
    "schema_struct_fields": (
        schema_struct_fields,
        _m("""SELECT unnest(['content', 'country', 'hashed_ip', 'header', 'language', 'redacted', 'role', 'state',
        'timestamp', 'toxic', 'turn_identifier']) AS field, (SELECT count(*) FROM every) AS n"""),
    ),
    "explode_messages": (explode_messages, _m("SELECT conversation_hash, hashed_ip, pos, role, content FROM every")),
    "rename_struct_fields": (
        rename_struct_fields,
        _m("""SELECT conversation_hash, lang_conv, country, pos, content, language_message AS language_nested,
        country AS country_nested, hashed_ip AS hashed_ip_nested, state AS state_nested FROM messages"""),
    ),
    "unnest_structs": (
        unnest_structs,
        _m("""SELECT conversation_hash, hashed_ip, pos, role, content, language_message AS language_nested, model,
        'en-US' AS "accept-language", 'browser' AS "user-agent" FROM messages"""),
    ),
    "drop_columns": (lambda s, d: _flat(messages(s, d)), _m(f"SELECT {FLAT} FROM messages")),
    "drop_columns_light": (
        drop_columns_light,
        _m("""SELECT conversation_id, conversation_hash, hashed_ip, turn, lang_conv, state, country, pos,
        turn_identifier, role, content, model, 'en-US' AS "accept-language", 'browser' AS "user-agent" FROM messages"""),
    ),
    "conversation_id": (conversation_ids, _m("SELECT DISTINCT conversation_id, turn FROM messages")),
    "empty_single_turn": (
        lambda s, d: flatten.empty_prompt_turns(messages(s, d)),
        _m("SELECT conversation_id, turn_identifier FROM empty_turns"),
    ),
    "anti_join_nolang": (lambda s, d: _flat(flatten.drop_empty_turns(messages(s, d))), _m(f"SELECT {FLAT} FROM spoken")),
    "anti_join_first_message": (
        lambda s, d: _flat(flatten.drop_empty_turns(messages(s, d), scope="first_message")),
        _m(f"""SELECT {FLAT} FROM messages ANTI JOIN (SELECT conversation_id, turn_identifier FROM messages
        WHERE pos = 0 AND language_message = 'Nolang') USING (conversation_id, turn_identifier)"""),
    ),
    "remove_nolang": (
        lambda s, d: _flat(flatten.remove_nolang(messages(s, d))),
        _m(f"SELECT {FLAT} FROM messages WHERE language_message IS DISTINCT FROM 'Nolang'"),
    ),
    "keep_english_latin": (
        lambda s, d: _flat(flatten.keep_english_latin(messages(s, d))),
        _m(f"SELECT {FLAT} FROM messages WHERE language_message IN ('English', 'Latin')"),
    ),
    "clean_messages": (lambda s, d: _flat(cleaned(s, d)), _m(f"SELECT {FLAT} FROM cleaned")),
    "assemble_conversations": (
        lambda s, d: assemble.assemble_conversations(cleaned(s, d)),
        _m(f"SELECT {ASSEMBLED} FROM assembled"),
    ),
    "assemble_in_row": (
        lambda s, d: assemble.prepare_conversations(english(s, d)),
        _m(f"SELECT {ASSEMBLED} FROM assembled"),
    ),
    "assemble_sql": (lambda s, d: assemble.assemble_sql(cleaned(s, d)), _m(f"SELECT {ASSEMBLED} FROM assembled")),
    **{
        c: (_text_query(c), _m(f"SELECT conversation_id, {c} FROM assembled"))
        for c in assemble.TEXT_COLUMNS
    },
    "carry_first": (
        carry_first,
        _m("""SELECT conversation_id, conversation_hash, turn, lang_conv, state, country, hashed_ip FROM assembled"""),
    ),
    "drop_null_messages": (
        drop_null_messages,
        _m("SELECT conversation_id, first_user_content FROM assembled WHERE first_user_content IS NOT NULL"),
    ),
    "sink_conversations": (sink_conversations, _m(f"SELECT {ASSEMBLED} FROM assembled")),
    "messages_per_conversation": (
        lambda s, d: stats.messages_per_conversation(cleaned(s, d)),
        _m("""SELECT n_messages, count(*) AS n_conversations
        FROM (SELECT count(*) AS n_messages FROM cleaned GROUP BY conversation_id) GROUP BY n_messages"""),
    ),
    "messages_by_role": (
        lambda s, d: stats.messages_by_role(cleaned(s, d)).withColumn("share", F.round("share", 6)),
        _m("""SELECT role, count(*) AS n_messages, round(count(*) / (SELECT count(*) FROM cleaned), 6) AS share
        FROM cleaned GROUP BY role"""),
    ),
    "row_counts_by_level": (
        lambda s, d: stats.row_counts_by_level(cleaned(s, d)),
        _m("""SELECT count(DISTINCT hashed_ip) AS n_users, count(DISTINCT conversation_id) AS n_conversations,
        count(*) AS n_messages FROM cleaned"""),
    ),
    "conversations_per_user": (
        lambda s, d: stats.conversations_per_user(cleaned(s, d)),
        _m("SELECT hashed_ip, count(DISTINCT conversation_id) AS n_conversations FROM cleaned GROUP BY hashed_ip"),
    ),
    "process_message_tokens": (process_message_tokens, TOKENS_SQL),
    "prepared_conversations": (prepared_conversations, TOKENS_SQL),
    "prepared_vocabulary": (prepared_vocabulary, VOCAB_SQL),
}
