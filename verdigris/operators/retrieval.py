"""BM25 retrieval over an inverted index, best paragraphs, and documents in force at a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from verdigris.functions.text import collapse, tokens

# BM25 parameters, hits a query, length of a snippet.
K1, B, TOP, SNIPPET = 1.5, 0.75, 5, 200


class Index:
    """Documents (doc_id, body) as lists of terms, and the size of the corpus; postings and document frequencies are made for the terms that are asked for."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", body: str = "body"):
        self.lists = docs.select(F.col(key).alias("doc_id"), tokens(F.col(body)).alias("t"))
        self.sizes = self.lists.agg(F.count("*").cast("double").alias("n_docs"), (F.coalesce(F.sum(F.size("t")), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("avg_len"))

    def postings(self, terms: DataFrame) -> DataFrame:
        """(term, doc_id, tf, len) of the given terms only: others are left out before anything is counted."""
        each = self.lists.select("doc_id", F.size("t").alias("len"), F.explode("t").alias("term"))
        return each.join(terms, "term", "left_semi").groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))

    def search(self, queries: DataFrame, k: int = TOP) -> DataFrame:
        """query_id, rank, doc_id, score of (query_id, query): ties to the smaller doc_id; a repeated term counts each time.

        Query terms are counted before the join, so each posting is read once a query.
        """
        asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        postings = self.postings(asked.select("term").distinct())
        df = postings.groupBy("term").agg(F.count("*").alias("df"))
        weighted = asked.join(df, "term").crossJoin(F.broadcast(self.sizes))  # one row
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        hits = weighted.withColumn("idf", idf).join(postings, "term")
        norm = K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
        part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
        scored = hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score")).filter(F.col("score") > 0)
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id"))
        return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def snippet(body: Column, query: Column, separator: str = "\n\n", length: int = SNIPPET) -> Column:
    """The paragraph that shares most distinct terms with the query (of equal ones the first), blanks collapsed, cut to `length`."""
    asked = F.array_distinct(tokens(query))
    parts = F.split(body, separator)
    ranked = F.transform(parts, lambda p, i: F.struct((-F.size(F.array_intersect(F.array_distinct(tokens(p)), asked))).alias("o"), i.alias("i"), p.alias("p")))
    return F.substring(collapse(F.array_min(ranked)["p"]), 1, length)


def hit_lines(hits: DataFrame) -> DataFrame:
    """query_id and its hits as text, one `id | title | snippet` a line."""
    line = F.concat_ws(" | ", "doc_id", "title", "snippet")
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def get_documents(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """asked (doc_id) with `text`, or an error where there is no such document."""
    found = docs.select("doc_id", F.col("text").alias("_t"))
    return asked.join(found, "doc_id", "left").withColumn("text", F.coalesce("_t", F.concat(F.lit("error: no document "), F.col("doc_id")))).drop("_t")


def current(rows: DataFrame, by: str, date: str, as_of, ties: list) -> DataFrame:
    """The latest row of each key at a date; of equal dates the first by `ties`."""
    w = W.partitionBy(by).orderBy(F.col(date).desc(), *ties)
    return rows.filter(F.col(date) <= F.lit(as_of)).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def effective(docs: DataFrame, as_of: str) -> DataFrame:
    """Documents in force: effective by the date, and not superseded by one that is."""
    live = docs.filter(F.col("effective_date") <= as_of)
    gone = live.filter(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("doc_id")).distinct()
    return live.join(gone, "doc_id", "left_anti")
