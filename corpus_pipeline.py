"""The corpus pipeline: five stages from raw documents to token shards.

``STAGES`` lists (name, function); each takes (spark, docs, sf_dir) and returns the next one's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import decontaminate, jaccard, mixing, quality, tokens
from llm.registry import table
from scenelake.session import shared_folder


def _without(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns of these names under others, and how to name them back: an operator's own columns have those names."""
    other = {c: f"_own_{k}_{c}" for k, c in enumerate(docs.columns) if c in names}
    return docs.withColumnsRenamed(other), {v: k for k, v in other.items()}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged, with the columns of ``docs`` whatever their names.

    A null, empty or blank text has no words and goes. Texts are judged whole, however long; repeated rows and rows of
    one id are judged each by its text, so they stay or go alike. Without labels, or where all or none of their documents
    are good, only the base rules decide. An empty table stays empty.
    """
    rows, back = _without(docs, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "cut", "kept"))
    return quality.quality_rules(rows, table(spark, sf_dir, "labels")).where("kept").select(*rows.columns).withColumnsRenamed(back)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id, of one id that of the least text hash; a null id comes last.

    Texts are compared whole; equal rows become one. A null text, and one without words, is near to nothing and stays. An
    empty table stays empty; other columns are carried along under any name.
    """
    return jaccard.one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Null and empty texts hold none and stay; long ones are searched whole; repeated rows stay or go alike. Without items
    all stay, and an empty table stays empty. Columns are those of ``docs`` under any name.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources meet their target weights, in one global order.

    A null source is a source; a source without text, so also a null text that is alone in its source, comes 0 times. Rows of one id
    are repeated equally often, and repeated rows each. An empty table stays empty. Columns are those of ``docs`` under any name.
    """
    rows, back = _without(docs, ("copy", "_mix_key"))
    return mixing.mix_sources(rows).select(*rows.columns).withColumnsRenamed(back)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mixture in the order in which it was stored; one row per document as read back from them.

    ``nth`` numbers the rows of one id. A null or empty text is the end id alone; texts are encoded whole. A null id is a key like
    another. An empty table gives no rows; columns beside id and text are ignored, whatever their names. A table
    that does not come from files has no stored order and is written by id.
    """
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    if not docs.inputFiles():
        return tokens.encode_documents(spark, docs, path)
    at = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return tokens.encode_documents(spark, at, path, ["file", "row"])


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources", mixing_stage),
    ("token output", token_stage),
]

#: SQL can express neither the tokenizer nor the exact similarity join at this size; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder, read by the next stage, and then removed."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            used = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{number - 1}")
            used.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(used, True)
    return docs


Q = {"pipeline": (run, ORACLE_SQL)}
