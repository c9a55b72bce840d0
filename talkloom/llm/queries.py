"""The operators of this package on the test tables, with production parameters, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm import quality, sql
from talkloom.llm.collocations import collocations
from talkloom.llm.decontaminate import contamination
from talkloom.llm.hilbert import hilbert_shards
from talkloom.llm.language import fit, held_out, identify
from talkloom.llm.lines import remove_lines
from talkloom.llm.minhash import near_duplicates
from talkloom.llm.packing import pack
from talkloom.llm.permutation import nearest_neighbours
from talkloom.llm.private import KINDS, personal_data, written
from talkloom.llm.ranked import rank_documents
from talkloom.llm.substrings import remove_repeats
from talkloom.llm.tables import documents
from talkloom.llm.token_file import read_token_file, write_token_file
from talkloom.llm.tokens import default_tokenizer
from talkloom.runtime import scratch_path

SHARDS = 40


def op1_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-file")
    write_token_file(documents(spark, sf_dir), path, default_tokenizer())
    return read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op3_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("row_key")


def op4_deletion_neighbourhood_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_lines(documents(spark, sf_dir))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    n_items = F.size("items").cast("bigint") + F.col("unnamed").cast("bigint")
    return found.select(
        "doc_id", "n_words", "n_hit", n_items.alias("n_items"), items.alias("items_sha256"),
        "contaminated",
    )


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = (F.octet_length(data) + 16).cast("bigint").alias("size")
    docs = documents(spark, sf_dir).select("doc_id", size, F.crc32(data).alias("text_crc32"), "lang", "source")
    sharded = hilbert_shards(docs, ["lang", "source", "size"], ["doc_id", "text_crc32"], SHARDS)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir))
    base = {k: F.col(f"base_{k}") for k in KINDS}
    return found.select(
        "doc_id", *(F.size(spans).cast("bigint").alias(f"n_{k}") for k, spans in base.items()),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written({k: F.concat(spans, F.col(f"added_{k}")) for k, spans in base.items()}).alias("spans"),
    )


def op8_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(documents(spark, sf_dir))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir), default_tokenizer())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op10_nearest_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op11_follow_the_leader_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out())
    found = quality.score(docs, quality.fit(docs, labels))
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", predicted)


def op12_setm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def op13_blas_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_elias_fano_tokens": (op1_elias_fano_tokens, None),
    "op2_permutation_index": (op2_permutation_index, None),
    "op3_circulant_minhash": (op3_circulant_minhash, sql.NEAR_DUPLICATES),
    "op4_deletion_neighbourhood_lines": (op4_deletion_neighbourhood_lines, sql.LINES),
    "op5_suffix_array_decontamination": (op5_suffix_array_decontamination, sql.DECONTAMINATION),
    "op6_hilbert_shards": (op6_hilbert_shards, None),
    "op7_weak_supervision_pii": (op7_weak_supervision_pii, None),
    "op8_difference_cover_dedup": (op8_difference_cover_dedup, sql.SUBSTRINGS),
    "op9_squares_packing": (op9_squares_packing, None),
    "op10_nearest_centroid_language": (op10_nearest_centroid_language, None),
    "op11_follow_the_leader_quality": (op11_follow_the_leader_quality, None),
    "op12_setm_collocations": (op12_setm_collocations, sql.COLLOCATIONS),
    "op13_blas_ranked_search": (op13_blas_ranked_search, sql.RANKED),
}
