"""A kept inverted index, and BM25 top-k over it that leaves out blocks which cannot matter.

Documents are dealt to 2^bits segments by the first bits of a hash of their key. A term's postings in one segment are a block, so that the block of a document is known
from its key, and a term that stands in every document is no single row, task or file. Each block keeps its `peak`, the largest weight that any of its postings gets.
Blocks lie in folders (buckets) by term.

A search goes from headers to postings. Blocks with the highest peaks give first hits, whose full scores give each query a bar: no hit below it can be among the k best.
Terms whose peaks together stay below the bar name no candidates, and a block of the others is read only if its peak, with all that the query's other terms can
add, reaches the bar. What a candidate gets from frequent terms that name none is looked up in the blocks of its own segment, once the rest says that it can still reach the bar.
The result is exact.
"""

from __future__ import annotations

import math
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from verdigris.functions.text import TOKEN, tokens
from verdigris.operators.retrieval import B, K1, TOP
from verdigris.sources.scratch import Scratch, exists, shared_dir

#: Documents of a segment, on average; buckets at least and at most, and documents for each; tasks that write one bucket, as segments differ.
SEGMENT, BUCKETS, BUCKET_DOCS, SPREAD = 1024, (16, 4096), 16_384, 16
#: Strongest terms and blocks that give a query its first hits, and how many of these, for each of the k, get full scores.
SEED_TERMS, SEED_BLOCKS, SEED_HITS = 16, 64, 8
#: Terms that stand in at most this part of the documents are read at once, whether they name candidates or not, as their postings are few.
FEW = 1 / 32
#: A table of at most so many rows of a term and a few numbers is sent to all tasks; a larger one is joined by a shuffle.
SENT_ROWS = 100_000
#: Words whose texts one task counts, and rows of a join or sum that one task holds, where that takes more tasks than the session's number of shuffle partitions.
TASK_WORDS, TASK_ROWS = 1 << 19, 1 << 19
#: Changes with the layout of the folders, so that no index of another layout is opened.
LAYOUT = 3
#: Sums in another order differ by less than this.
SLACK = 1e-9


def weight(tf: Column, length: Column, average: Column) -> Column:
    return tf / (tf + K1 * (1 - B + B * length / average))


def segment(doc: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc), 64 - bits) if bits else F.lit(0).cast("long")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def sent(table: DataFrame) -> DataFrame:
    """A written table, broadcast if its counted rows are few."""
    return F.broadcast(table) if table.count() <= SENT_ROWS else table


def spread(table: DataFrame, rows: int, *by: str) -> DataFrame:
    """`table`, of so many rows, dealt by columns over as many tasks as keep their rows to TASK_ROWS; as it is where the session's own number of partitions does."""
    parts = math.ceil(rows / TASK_ROWS)
    return table.repartition(parts, *by) if parts > int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) else table


def frequencies(docs: DataFrame, key: str, body: str, tasks: int = 1) -> DataFrame:
    """(doc, length, term, tf). Texts are dealt by key first, over so many tasks, so that counting their terms needs no shuffle of terms; rows without a key are left out."""
    dealt = docs.select(F.col(key).alias("doc"), F.col(body).alias("body")).filter("doc is not null").repartition(tasks, "doc")
    # the outer form, as the inner one would have Spark tokenise before the shuffle too, to leave out empty texts
    each = dealt.select("doc", tokens(F.col("body")).alias("t")).select("doc", F.size("t").alias("length"), F.explode_outer("t").alias("term"))
    return each.filter("term is not null").groupBy("doc", "length", "term").agg(F.count("*").cast("int").alias("tf"))


class Index:
    """An index that `save` has written: `meta` (one row), `terms` (term, df, peak) and `blocks` (term, block, n, peak, docs, tfs, lengths), both in folders by bucket."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        meta = spark.read.parquet(f"{path}/meta").head()
        self.n_docs, self.average, self.bits, self.buckets = meta["n_docs"], meta["average"], meta["bits"], meta["buckets"]
        doc = meta["doc"]
        self.terms = spark.read.schema("term string, df long, peak double, bucket int").parquet(f"{path}/terms")
        self.blocks = spark.read.schema(f"term string, block long, n int, peak double, docs array<{doc}>, tfs array<int>, lengths array<int>, bucket int").parquet(f"{path}/blocks")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        return cls(spark, path)

    @classmethod
    def save(cls, docs: DataFrame, path: str, key: str = "doc_id", body: str = "body") -> Index:
        """Index `docs` into an empty folder; their texts are read once for the average length and once for the postings, and texts and postings are shuffled once. `meta` is written last, so
        a folder with it is whole. Null bodies have no terms but count as documents."""
        spark = docs.sparkSession
        n_docs, words = docs.agg(F.count("*"), F.sum(F.regexp_count(F.lower(F.col(body)), F.lit(TOKEN)))).head()
        average = (words or 0) / max(n_docs, 1)
        bits = max(0, math.ceil(math.log2(n_docs / SEGMENT))) if n_docs else 0
        buckets = 1 << min(max(math.ceil(math.log2(max(n_docs / BUCKET_DOCS, 1))), int(math.log2(BUCKETS[0]))), int(math.log2(BUCKETS[1])))
        tasks = max(1, math.ceil((words or 0) / TASK_WORDS))
        each = frequencies(docs, key, body, tasks).select("doc", "length", "term", "tf", segment(F.col("doc"), bits).alias("block"), bucket_of(F.col("term"), buckets).alias("bucket"))
        each = each.withColumn("lane", (F.col("block") % SPREAD).cast("int")).repartition(min(tasks, buckets * SPREAD), "bucket", "lane")
        # one row after the other goes to all three lists, and none holds nulls, so their entries stand side by side
        lists = [F.collect_list(c).alias(f"{c}s") for c in ("doc", "tf", "length")]
        posts = each.groupBy("bucket", "lane", "term", "block").agg(*lists)
        peak = F.array_max(F.zip_with("tfs", "lengths", lambda tf, length: weight(tf, length, F.lit(average))))
        made = posts.select("term", "block", F.size("docs").alias("n"), peak.alias("peak"), "docs", "tfs", "lengths", "bucket")
        made.sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
        heads = spark.read.schema("term string, n int, peak double, bucket int").parquet(f"{path}/blocks")
        every = heads.groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.max("peak").alias("peak")).repartition("bucket")
        every.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
        meta = [(n_docs, float(average), bits, buckets, docs.schema[key].dataType.simpleString())]
        spark.createDataFrame(meta, "n_docs long, average double, bits int, buckets int, doc string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        return cls(spark, path)

    def asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, df, weight, upper) of the terms of (query_id, query) that the index has; a repeated term weighs as often; upper: the most it can add to a score."""
        each = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        each = each.withColumn("bucket", bucket_of(F.col("term"), self.buckets))
        idf = F.log(1 + (F.lit(float(self.n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        found = each.join(self.only(self.terms, each), ["bucket", "term"]).withColumn("weight", F.col("times") * idf * (K1 + 1))
        return found.select("query_id", "term", "df", "weight", (F.col("weight") * F.col("peak")).alias("upper"))

    def only(self, table: DataFrame, wanted: DataFrame) -> DataFrame:
        """The folders of `table` that `wanted` names; at most as many numbers as there are buckets come to the driver."""
        return table.filter(F.col("bucket").isin([r[0] for r in wanted.select("bucket").distinct().collect()]))

    def headers(self, asked: DataFrame) -> DataFrame:
        """`asked` with block, n and bound, the most that a posting of the block adds: a row for each query, term and block. No postings are read."""
        heads = self.only(self.blocks, asked.select(bucket_of(F.col("term"), self.buckets).alias("bucket"))).select("term", "block", "n", F.col("peak").alias("block_peak"))
        return asked.join(heads, "term").withColumn("bound", F.col("weight") * F.col("block_peak")).drop("block_peak")

    def postings(self, wanted: DataFrame, scratch: Scratch) -> DataFrame:
        """(term, doc, part) of the blocks (term, block) asked for: the part that a term of weight 1 adds to a document's score."""
        wanted = scratch.table(wanted.select("term", "block", bucket_of(F.col("term"), self.buckets).alias("bucket")).distinct())
        read = self.only(self.blocks, wanted).join(sent(wanted), ["bucket", "term", "block"], "left_semi")
        each = read.select("term", F.explode(F.arrays_zip("docs", "tfs", "lengths")).alias("p"))
        return each.select("term", F.col("p.docs").alias("doc"), weight(F.col("p.tfs"), F.col("p.lengths"), F.lit(self.average)).alias("part"))

    def looked_up(self, candidates: DataFrame, asked: DataFrame, scratch: Scratch) -> DataFrame:
        """(query_id, doc, score) of candidates (query_id, doc) from the terms in `asked`, from the blocks in which their postings can be; no row where there are none."""
        weights = asked.select("query_id", "term", "weight")
        places = candidates.select("query_id", segment(F.col("doc"), self.bits).alias("block")).distinct()
        blocks = places.join(weights, "query_id").select("term", "block")
        parts = self.postings(blocks, scratch)
        looked = candidates.select("query_id", "doc").join(weights, "query_id")
        counts = candidates.groupBy("query_id").agg(F.count("*").alias("n")).join(weights.groupBy("query_id").agg(F.count("*").alias("terms")), "query_id")
        n = counts.agg(F.sum(F.col("n") * F.col("terms"))).head()[0] or 0
        return spread(looked, n, "term", "doc").join(spread(parts, n, "term", "doc"), ["term", "doc"]).groupBy("query_id", "doc").agg(F.sum(F.col("weight") * F.col("part")).alias("score"))

    def bars(self, asked: DataFrame, k: int, scratch: Scratch) -> DataFrame:
        """(query_id, bar): the k-th best full score among first hits; no row for queries with fewer of them."""
        best = lambda df, by, n: df.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy(*by))).filter(F.col("_r") <= n).drop("_r")
        strong = best(asked, [F.col("upper").desc(), "term"], SEED_TERMS)
        seeds = scratch.table(best(self.headers(strong), [F.col("bound").desc(), "term", "block"], SEED_BLOCKS).select("query_id", "term", "block", "weight"))
        weights = sent(scratch.table(seeds.drop("block").distinct()))
        hits = self.postings(seeds, scratch).join(weights, "term").groupBy("query_id", "doc").agg(F.sum(F.col("weight") * F.col("part")).alias("score"))
        scored = self.looked_up(best(hits, [F.col("score").desc(), "doc"], SEED_HITS * k).select("query_id", "doc"), asked, scratch)
        last = scored.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc())))
        return scratch.table(last.filter(F.col("_r") == k).select("query_id", (F.col("score") - SLACK).alias("bar")))

    def plan(self, asked: DataFrame, bars: DataFrame) -> DataFrame:
        """asked with bar, all (the most that all terms add), naming (whether the term names candidates), scanned (whether its blocks are read for that), first (of the others,
        whether it is among the strong ones that are looked up first), rest and later (the most that terms not scanned add, and that those of them which are not first add)."""
        low, every = W.partitionBy("query_id").orderBy("upper", "term"), W.partitionBy("query_id")
        ranked = asked.join(bars, "query_id", "left").fillna(0.0, ["bar"])
        below = F.sum("upper").over(low.rowsBetween(W.unboundedPreceding, W.currentRow)) * (1 + SLACK)
        ranked = ranked.withColumn("naming", below >= F.col("bar")).withColumn("all", F.sum("upper").over(every) * (1 + SLACK))
        ranked = ranked.withColumn("scanned", F.col("naming") | (F.col("df") <= FEW * self.n_docs))
        left = F.when(~F.col("scanned"), F.col("upper"))
        total = lambda x, w=every: F.coalesce(F.sum(x).over(w), F.lit(0.0)) * (1 + SLACK)
        ranked = ranked.withColumn("rest", total(left)).withColumn("first", ~F.col("scanned") & (total(left, low.rowsBetween(W.unboundedPreceding, W.currentRow)) > F.col("rest") / 2))
        return ranked.withColumn("later", total(F.when(~F.col("first"), left)))

    def wanted(self, planned: DataFrame) -> DataFrame:
        """headers() of the scanned terms, with `read`: not for a block of a term that names candidates whose peak, with all that the other terms add, stays below the bar.
        No document in such a block is among the k best."""
        reach = F.col("bound") + F.col("all") - F.col("upper") >= F.col("bar")
        return self.headers(planned.filter("scanned")).withColumn("read", ~F.col("naming") | reach)

    def search(self, queries: DataFrame, k: int = TOP) -> DataFrame:
        """query_id, rank, doc_id, score of (query_id, query): the k best documents by BM25, ties (to nine digits) to the smaller doc_id."""
        scratch = Scratch(self.spark, "search")
        asked = scratch.table(self.asked(queries))
        planned = scratch.table(self.plan(asked, self.bars(asked, k, scratch)))
        wanted = scratch.table(self.wanted(planned).filter("read"))
        weights = sent(scratch.table(wanted.select("query_id", "term", "weight").distinct()))
        found = self.postings(wanted, scratch).join(weights, "term")
        near = spread(found, wanted.agg(F.sum("n")).head()[0] or 0, "query_id", "doc").groupBy("query_id", "doc").agg(F.sum(F.col("weight") * F.col("part")).alias("score"))
        limits = planned.select("query_id", "bar", "rest", "later").distinct()

        def able(rows: DataFrame, rest: str) -> DataFrame:
            return scratch.table(rows.join(limits, "query_id").filter(F.col("score") * (1 + SLACK) + F.col(rest) >= F.col("bar")).select("query_id", "doc", "score"))

        def with_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
            more = self.looked_up(rows, terms, scratch).withColumnRenamed("score", "more")
            return rows.join(more, ["query_id", "doc"], "left").select("query_id", "doc", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))

        candidates = able(with_terms(able(near, "rest"), planned.filter("first")), "later")
        scored = with_terms(candidates, planned.filter("not scanned and not first"))
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc"))
        top = scratch.table(scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("doc").alias("doc_id"), "score"))
        scratch.keep(top)
        return top


def fingerprint(docs: DataFrame) -> int | None:
    """A number that changes with the files that `docs` reads (path, size, time of change), or None where it does not come straight from files. No text is read."""
    try:
        files = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    except AnalysisException:
        return None
    return files.distinct().agg(F.bit_xor(F.xxhash64("*"))).head()[0] or 0


def kept(docs: DataFrame, key: str = "doc_id", body: str = "body") -> Index:
    """The index of `docs` in the shared folder: the one that is there if the files are as they were, else a new one."""
    spark, mark = docs.sparkSession, fingerprint(docs)
    made = f"{shared_dir(spark)}/bm25-{uuid.uuid4().hex if mark is None else f'{mark & (1 << 64) - 1:016x}'}-{LAYOUT}-{key}-{body}"
    return Index.open(spark, made) if exists(spark, f"{made}/meta/_SUCCESS") else Index.save(docs, made, key, body)
