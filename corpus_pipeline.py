"""Corpus preparation: the stages applied in turn to the documents table.

quality: documents that the quality rules reject go. near_dedup: one document of each group of near-duplicates stays.
pii: personal data in the texts is replaced by its kind, and n_chars follows. mixing: each document once for every pass
that the mix takes it, in training order, which its files keep: by number, and row by row. bpe: doc_id, source, ids, n_tokens and position, by
which the rows sort into the order of training.

Null and empty texts fail the quality rules, so no later stage of a run meets them; given such rows, near_dedup keeps them, pii leaves them as they
are, mixing never takes them and bpe gives them no ids. Null keys and sources are allowed in every stage, repeated rows are copies (near_dedup
keeps one), very long texts are read whole, an empty table passes every stage, and extra columns stay up to bpe, whatever their names.
"""

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from verdigris.llm import bpe, mixing, neardup, perplexity, pii
from verdigris.llm.common import Scratch, read_table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality(spark, docs, sf_dir):
    """Documents that pass the rules on words and lines and stay in their language's bands of perplexity."""
    return perplexity.judge_documents(docs).filter("kept").select(*docs.columns)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near-duplicates."""
    return neardup.drop_copies(docs).select(*docs.columns)


def personal_data(spark, docs, sf_dir):
    """Documents with their personal data replaced, and n_chars of what then stands there."""
    return pii.mask_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark, docs, sf_dir):
    """A row for each pass that takes a document, in training order."""
    return mixing.mix_documents(docs)


def file_order(docs):
    """The place of each row of a table written in order: number of its file, then row in the file. Rows that do not come straight
    from files are numbered as they come."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return docs.withColumn("position", F.monotonically_increasing_id())
    number = lambda at: F.coalesce(F.regexp_extract("_metadata.file_name", r"^part-(\d+).*?(?:-c(\d+))?\.", at).try_cast("long"), F.lit(0))
    return docs.withColumn("position", F.shiftleft(number(1), 44) + F.shiftleft(number(2), 32) + F.col("_metadata.row_index"))


def encode(spark, docs, sf_dir):
    """Token ids of each row, with its place in the order that the mix has written."""
    placed = file_order(docs.drop("position")).select("doc_id", "source", "text", "position")
    encoded = bpe.encode_documents(placed, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "position")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", personal_data), ("mixing", mix), ("bpe", encode)]
#: SQL cannot express the language model, the bootstrapped contexts or the encoder.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each written as Parquet and read again by the next."""
    scratch, docs = Scratch(spark, "pipeline"), read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
        scratch.keep(docs)  # what an earlier stage left has been read
    return STAGES[-1][1](spark, docs, sf_dir)
