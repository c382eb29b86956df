"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inferframe.llm import quality
from inferframe.llm.common import discard, saved, shared_dir, table
from inferframe.llm.decontaminate import decontaminated
from inferframe.llm.minhash_dedup import Settings, near_duplicates
from inferframe.llm.mixing import mix_sources
from inferframe.llm.tokens import read_tokens, write_tokens


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality classifier doesn't reject, each judged by its own text.

    A null or empty text scores as the labelled sample's share of good documents does. Ids play no part: rows with a null doc_id, and rows
    that share one, are judged like others; equal texts have equal scores. Whole texts are scored, however long. Other columns, by whatever names, are
    passed on. An empty table gives an empty result.
    """
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the one with the smallest doc_id.

    A null, empty or wordless text is linked with nothing and stays. A row with a null doc_id has no rank: it stays, and no other goes for it.
    Rows that share a doc_id are one document: they stay or go together, and stay if one of their texts belongs to no smaller doc_id. Whole texts are
    compared, however long. Other columns, by whatever names, are passed on. An empty table gives an empty result.
    """
    gone = near_duplicates(docs, Settings(words=5)).groupBy(F.col("doc_id").alias("_gone")).agg(F.max("kept").alias("_kept")).where("not _kept").select("_gone")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item, verbatim or paraphrased.

    A null, empty or wordless text holds none, nor does any text hold a null or wordless item. A row with a null doc_id can't be named by the
    search: it stays. Rows that share a doc_id stay or go together. Whole texts are searched, however long. Other columns, by whatever
    names, are passed on. Without documents or items the result is docs.
    """
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the target weights of their sources, dealt and sorted by a hash, so in random order; copies share their doc_id.

    A null source is a source of its own; a null text is repeated like others. Repeated rows, and rows that share a doc_id or have none, draw
    the same number of copies each. Columns of other names are passed on, but for copy_no, n_copies, rate and shuffle_key, which the operator
    makes and the stage drops unless docs has them. An empty table gives an empty result.
    """
    return mix_sources(docs, keep=docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files written and read back: a row per document with its place, length and checksum.

    Files keep the order of the rows, so that the mixed corpus stays mixed. A null or empty text is its end id alone; repeated rows, and rows
    that share a doc_id or have none, are written one by one. Other columns are ignored. An empty table gives an empty result.
    """
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), in_order=False)
    return read_tokens(spark, path, with_ids=False)


STAGES = [("quality classifier", quality_filter), ("minhash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("mixing", mix), ("token output", tokens)]
ORACLE_SQL = None  # classifier, latent search and tokenizer have no SQL; tests/llm/test_pipeline.py holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, saved(stage(spark, docs, sf_dir), f"stage-{i}-{name.replace(' ', '-')}")
        if i:
            discard(before)
    return docs
