"""From raw files to the clean tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkloom.operators.assemble import prepare_conversations
from talkloom.operators.lemma import process_message_tokens
from talkloom.sources.raw import read_vocabulary, scan_raw, write_table, write_vocabulary


def prepare_tables(
    spark: SparkSession,
    paths: str | list[str],
    out: str,
    columns: str | list[str] = "first_user_content",
    language: str = "English",
    lemmas: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Scan, clean and assemble raw conversations, tokenise and lemmatise, and write three tables under `out`:
    `conversations_raw` (texts), `conversations` (with tokens) and `vocabulary`.

    The raw files are read once: the text table is written first and the tokens are made from it.
    """
    write_table(prepare_conversations(scan_raw(spark, paths, language)), f"{out}/conversations_raw")
    texts = spark.read.parquet(f"{out}/conversations_raw")
    done, vocab = process_message_tokens(texts, columns, lemmas=lemmas, path=f"{out}/conversations")
    write_vocabulary(vocab, f"{out}/vocabulary")
    return {
        "conversations_raw": texts,
        "conversations": done,
        "vocabulary": read_vocabulary(spark, f"{out}/vocabulary"),
    }
