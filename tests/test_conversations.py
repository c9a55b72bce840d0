import duckdb
import pytest
from pyspark.sql import functions as F

from talkloom.checks import conversation_queries as C
from talkloom.checks.oracles import MESSAGES
from talkloom.operators import assemble, flatten, stats
from talkloom.sources import raw as sources
from talkloom.sources.turns import nest_turns

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def raw_path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw") / "conversations")
    sources.write_table(nest_turns(spark.read.parquet(f"{SF}/conversations.parquet")), path)
    return path


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_scan_reads_only_used_fields(spark, raw_path):
    raw = sources.scan_raw(spark, raw_path)
    plan = flatten.flatten_messages(raw)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "toxic" not in schema and "redacted" not in schema and "model" not in schema
    assert "EqualTo(language,English)" in plan
    assert sources.message_fields(raw) == [f for f in sources.message_fields(spark.read.parquet(raw_path)) if f in sources.MESSAGE_FIELDS]


@pytest.fixture(scope="module")
def counted():
    """Number of rows of a step, by SQL on the flat turns."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    return lambda select: con.execute(f"WITH {MESSAGES} {select}").fetchone()


def test_step_counts(spark, raw_path, counted):
    m = flatten.flatten_messages(sources.scan_raw(spark, raw_path))
    assert m.where("role = 'system'").count() > 0
    assert m.count() == counted("SELECT count(*) FROM messages")[0]
    assert flatten.empty_prompt_turns(m).count() == counted("SELECT count(*) FROM empty_turns")[0]
    after = flatten.drop_empty_turns(m)
    assert after.count() == counted("SELECT count(*) FROM spoken")[0]
    known = "SELECT count(*) FROM spoken WHERE language_message <> 'Nolang'"
    assert flatten.remove_nolang(after).count() == counted(known)[0]
    assert flatten.clean_messages(m).count() == counted("SELECT count(*) FROM cleaned")[0]
    counts = stats.row_counts_by_level(flatten.clean_messages(m)).first()
    wanted = "SELECT count(DISTINCT hashed_ip), count(DISTINCT conversation_id), count(*) FROM cleaned"
    assert (counts["n_users"], counts["n_conversations"], counts["n_messages"]) == counted(wanted)


def test_in_row_route_equals_message_route(spark, raw_path):
    """Also with null ids, repeated ids, shuffled input and other partitionings."""
    raw = sources.scan_raw(spark, raw_path)
    odd = raw.withColumn("hashed_ip", F.when(F.substring("hashed_ip", 1, 1) < "2", None).otherwise(F.col("hashed_ip")))
    more = odd.unionByName(raw.where(F.col("turn") == 2))
    for df in (raw, odd, more, more.repartition(7), more.orderBy(F.desc("turn")).coalesce(1)):
        by_message = assemble.assemble_conversations(flatten.clean_messages(flatten.flatten_messages(df)))
        assert rows(assemble.prepare_conversations(df, null_ids="group")) == rows(by_message)


def test_conversations_of_unknown_users_stay_apart(spark, raw_path, counted):
    raw = sources.scan_raw(spark, raw_path).withColumn("hashed_ip", F.lit(None).cast("string"))
    apart = assemble.prepare_conversations(raw)
    assert apart.count() == counted("SELECT count(*) FROM assembled")[0] and apart.where(F.col("conversation_id").isNotNull()).isEmpty()
    assert assemble.prepare_conversations(raw, null_ids="group").count() == 1
    with pytest.raises(ValueError):
        assemble.prepare_conversations(raw, null_ids="drop")


def test_in_row_route_moves_no_text(spark, raw_path):
    plan = assemble._assemble_in_row(sources.scan_raw(spark, raw_path))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def messages(spark, data):
    schema = "conversation_id string, pos int, turn_identifier bigint, role string, content string, turn bigint, language_message string"
    return spark.createDataFrame(data, schema)


def test_assembly_with_missing_messages(spark):
    m = messages(spark, [
        ("a", 1, 0, "assistant", "only", 1, "English"),
        ("b", 0, 0, "user", None, 2, "English"), ("b", 2, 1, "user", "x", 2, "English"),
        ("b", 1, 0, "assistant", None, 2, "English"), ("b", 3, 1, "assistant", "y", 2, "English"),
        (None, 0, 0, "user", "p", 1, "English"), (None, 1, 0, "user", "q", 1, "English"),
    ])
    for form in (assemble.assemble_conversations, assemble.assemble_sql):
        out = {r["conversation_id"]: r for r in form(m).collect()}
        assert (out["a"]["first_user_content"], out["a"]["all_user_content"]) == (None, "")
        assert (out["b"]["first_user_content"], out["b"]["all_user_content"]) == (None, "x")
        assert (out["b"]["all_assistant_content"], out["b"]["all_content"]) == ("y", "x\n\ny")
        assert out[None]["all_content"] == "p\n\nq"
        assert {r["conversation_id"] for r in assemble.drop_null_texts(form(m)).collect()} == {None}


def test_unknown_language_survives_one_filter_only(spark):
    m = messages(spark, [("a", 0, 0, "user", "x", 1, None), ("a", 1, 0, "assistant", "y", 1, "Nolang")])
    assert flatten.remove_nolang(m).count() == 1
    assert flatten.keep_english_latin(m).count() == 0
    with pytest.raises(ValueError):
        flatten.drop_empty_turns(m, scope="other")


def test_hot_conversation(spark):
    """One conversation with most messages; order and text stay whole."""
    n = 20_000
    m = spark.range(n).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("conversation_id"),
        F.col("id").cast("int").alias("pos"), F.col("id").alias("turn_identifier"), F.lit("user").alias("role"),
        F.col("id").cast("string").alias("content"), F.lit(1).alias("turn"), F.lit("English").alias("language_message"),
    )
    out = assemble.assemble_conversations(m.repartition(8)).where(F.col("conversation_id") == "hot").first()
    assert out["all_content"].split("\n\n") == [str(i) for i in range(n) if i % 3 > 0]


def test_tables_written_and_read(spark, raw_path, tmp_path, counted):
    from talkloom.plans.prepare import prepare_tables

    tables = prepare_tables(spark, f"{raw_path}/*.parquet", str(tmp_path / "out"))
    vocab = [r["term"] for r in tables["vocabulary"].orderBy("idx").collect()]
    assert vocab == sorted(set(vocab))
    used = tables["conversations"].select(F.explode("first_user_content_tokens")).distinct().collect()
    assert {r[0] for r in used} == set(vocab)
    assert tables["conversations_raw"].count() == counted("SELECT count(*) FROM assembled")[0]
    with_prompt = "SELECT count(*) FROM assembled WHERE first_user_content IS NOT NULL"
    assert tables["conversations"].count() == counted(with_prompt)[0]
    english = C.english(spark, SF)
    assert rows(tables["conversations_raw"]) == rows(assemble.prepare_conversations(english))
