"""The corpus pipeline: language, lines, near-duplicates, benchmark passages, packing.

Each stage gets the session, the documents that the stage before kept, and the folder of the test tables, and works on all
of them; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm.decontaminate import contamination
from talkloom.llm.language import fit, held_out, identify
from talkloom.llm.lines import remove_lines
from talkloom.llm.minhash import near_duplicates
from talkloom.llm.packing import pack
from talkloom.llm.tables import documents, without
from talkloom.llm.tokens import default_tokenizer
from talkloom.runtime import cut


# Near-duplicates have four fifths of their five-word shingles in common. A pair at that threshold is missed with probability
# (1 - 0.8 ** ROWS) ** BANDS = 1.3e-7.
PERCENT, BANDS, ROWS = 80, 40, 5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model, fitted on their labels, doesn't reject."""
    found = identify(docs, fit(docs.where(~held_out())))
    return without(docs, found, F.col("rejected"))


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one equals or nearly equals; n_chars counts what is left. A document that
    loses lines goes as a whole only if no line with more than white space is left of it."""
    left = remove_lines(docs).where(F.expr("n_removed = 0") | F.col("kept").rlike(r"[^ \t-\r]"))
    changed = {
        "doc_id": F.col("doc_id"), "text": F.col("kept"),
        "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(F.col("rest.n_chars")),
    }
    return left.select(*(
        changed.get(f.name, F.col("rest")[f.name]).cast(f.dataType).alias(f.name) for f in docs.schema
    ))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return without(docs, near_duplicates(docs, PERCENT, BANDS, ROWS), ~F.col("kept"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold benchmark passages."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found, F.col("contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: pieces of documents with their token ids."""
    return pack(docs, default_tokenizer())


STAGES = [
    ("language ID", known_language),
    ("line dedup", first_lines),
    ("MinHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]

# Language ID and tokenization can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written and read again before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
