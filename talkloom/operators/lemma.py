"""Distinct tokens, lemmas, vocabulary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkloom.functions.lemmas import irregular_lemmas, lemmas_in_row, rule_lemma
from talkloom.functions.text import clean_and_tokenize, explode_tokens
from talkloom.operators.token_blocks import deal, fetch, opened
from talkloom.runtime import cut, dense_index, lookup_join


def _names(columns: str | list[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def distinct_tokens(df: DataFrame, columns: str | list[str]) -> DataFrame:
    """Distinct tokens of one or several token columns. Duplicates are removed in each task before the shuffle."""
    all_tokens = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in _names(columns)])
    return explode_tokens(df, all_tokens).distinct()


def distinct_tokens_sql(df: DataFrame, column: str) -> DataFrame:
    return df.sparkSession.sql(
        f"SELECT DISTINCT token FROM {{df}} LATERAL VIEW OUTER explode(`{column}`) AS token WHERE token IS NOT NULL",
        df=df,
    )


def lemma_table(
    tokens: DataFrame, lemmas: DataFrame | None = None, rule: Callable[[Column], Column] = rule_lemma
) -> DataFrame:
    """Lemma of each distinct token: the table's if listed, else the rule's. Every token is lemmatised once."""
    lemmas = irregular_lemmas(tokens.sparkSession) if lemmas is None else lemmas
    return lookup_join(tokens, lemmas.withColumnRenamed("lemma", "_listed"), "token", "left").select(
        "token", F.coalesce("_listed", rule(F.col("token"))).alias("lemma")
    )


def vocabulary(lemmas: DataFrame) -> DataFrame:
    """Distinct lemmas, numbered in alphabetical order: `(term, idx)`."""
    return dense_index(lemmas.select(F.col("lemma").alias("term")).distinct(), "term")


def lemma_dict_and_vocab(
    df: DataFrame, token_columns: str | list[str], lemmas: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Lemma table of the tokens in use (cut, so it is computed once) and its vocabulary."""
    table = cut(lemma_table(distinct_tokens(df, token_columns), lemmas), "lemmas")
    return table, vocabulary(table)


def lemmatize_tokens(df: DataFrame, token_columns: str | list[str], lemmas: DataFrame, key: str) -> DataFrame:
    """Replace tokens by their lemma; tokens that are not listed stay, order and repetitions too.

    Blocks of rows fetch the lemmas of their different tokens and put them in place, so `key` may be null or repeated.
    """
    changes = cut(lemmas.where(F.col("lemma") != F.col("token")).select("token", "lemma"), "lemma-changes")
    result = df
    for column in _names(token_columns):
        others = [c for c in df.columns if c != column]
        blocks = deal(result, column, F.xxhash64(key, column), others)
        known = fetch(blocks, changes, "token").groupBy("_block")
        schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in [*others, column]])
        result = blocks.groupBy("_block").cogroup(known).applyInArrow(_relisted(others, column), schema)
    return result.select(*df.columns)


def _relisted(others: list[str], column: str):
    """A block's rows with its lists again, as `column`, the known lemmas in place of their tokens."""

    def run(_, table, known):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        flat, _ = opened(table)
        place = pc.index_in(flat, known["token"].combine_chunks(), skip_nulls=True)
        lemmas = pc.coalesce(known["lemma"].combine_chunks().take(place), flat)
        lists = table["_sizes"].combine_chunks()
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        rebuilt = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), lemmas, mask=lists.is_null())
        return table.select(others).append_column(column, rebuilt)

    return run


def process_message_tokens(
    conversations: DataFrame,
    columns: str | list[str],
    pattern: str | None = None,
    lemmas: DataFrame | None = None,
    key: str = "conversation_id",
    path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Clean and tokenise, lemmatise, and return (conversations with token columns, vocabulary).

    The default lemmas are an expression, so rows are processed where they lie. A lemma table is joined to the
    distinct tokens and applied by `lemmatize_tokens`. The token table is written to `path` if given, so that the
    vocabulary is made from it without a second run.
    """
    cleaned = clean_and_tokenize(conversations, columns, pattern)
    token_columns = [f"{c}_tokens" for c in _names(columns)]
    if lemmas is None:
        done = cut(cleaned.withColumns({c: lemmas_in_row(c) for c in token_columns}), "lemmatised", path)
        terms = distinct_tokens(done, token_columns).withColumnRenamed("token", "term")
        return done, dense_index(terms, "term")
    cleaned = cut(cleaned, "tokens")
    table, vocab = lemma_dict_and_vocab(cleaned, token_columns, lemmas)
    done = lemmatize_tokens(cleaned, token_columns, table, key)
    return (cut(done, "lemmatised", path) if path else done), vocab


def duplicate_lemmas(lemmas: DataFrame) -> DataFrame:
    """Pairs (token, lemma) whose lemma belongs to several tokens."""
    shared = lemmas.groupBy("lemma").count().where(F.col("count") > 1).select("lemma")
    return lemmas.join(shared, "lemma", "left_semi").select("token", "lemma").orderBy("lemma", "token")


__all__ = [
    "distinct_tokens",
    "distinct_tokens_sql",
    "duplicate_lemmas",
    "lemma_dict_and_vocab",
    "lemma_table",
    "lemmatize_tokens",
    "process_message_tokens",
    "vocabulary",
]
