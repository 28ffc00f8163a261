"""The three tools of an agent as table functions, to be called in SQL over `TABLE(...) PARTITION BY ...`.

`register(spark)` makes them known. Spark deals the rows, sorts them and calls a function for each partition; what a partition holds is bounded by the
caller's partitioning: a question's blocks in one segment of the documents (search_docs), one document at a time (get_doc), nothing (calculate).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from verdigris.functions import calculator


def _columns(table: AnalyzeArgument, *wanted: str) -> dict:
    """Types of the wanted columns of a table argument; others are allowed and ignored."""
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(...) PARTITION BY ...")
    types = {f.name: f.dataType for f in table.dataType.fields}
    if missing := [c for c in wanted if c not in types]:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    return types


class SearchDocs:
    """search_docs(TABLE(query_id, block, docs, parts) PARTITION BY (query_id, block), k): query_id, doc_id, score of the k best documents of each partition.

    A row holds a term's postings in one segment of the documents: `docs` and, beside it, `parts`, what the term adds to their scores. All postings of a document
    lie in one segment, so a partition's sums are whole; the k best of all segments are the k best of all. Ties (to nine digits) go to the smaller document.
    Rows with null arrays add nothing; a partition without postings gives no row.
    """

    @staticmethod
    def analyze(hits: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
        types = _columns(hits, "query_id", "docs", "parts")
        if not isinstance(types["docs"], ArrayType) or not isinstance(types["parts"], ArrayType):
            raise ValueError("docs and parts are arrays")
        if not k.isConstantExpression or not isinstance(k.value, int) or k.value < 1:
            raise ValueError("k is a whole number from 1")
        return AnalyzeResult(schema=StructType().add("query_id", types["query_id"]).add("doc_id", types["docs"].elementType).add("score", DoubleType()))

    def __init__(self):
        self.query, self.k, self.scores = None, 0, {}

    def eval(self, hits, k):
        self.query, self.k = hits["query_id"], k
        for doc, part in zip(hits["docs"] or (), hits["parts"] or ()):
            self.scores[doc] = self.scores.get(doc, 0.0) + part

    def terminate(self):
        for doc in sorted(self.scores, key=lambda d: (-round(self.scores[d], 9), d))[: self.k]:
            yield self.query, doc, self.scores[doc]


class GetDoc:
    """get_doc(TABLE(doc_id, text, asked) PARTITION BY doc_id ORDER BY asked): doc_id, text for each row that asks.

    Rows that ask have `asked` true and no text; documents have it false and so come first. Of several documents with one id the last that Spark's order gives is told.
    An id without a document gives `error: no document <id>`; a document whose text is null gives null.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        types = _columns(rows, "doc_id", "text", "asked")
        return AnalyzeResult(schema=StructType().add("doc_id", types["doc_id"]).add("text", StringType()))

    def __init__(self):
        self.known, self.text = False, None

    def eval(self, rows):
        if rows["asked"]:
            yield rows["doc_id"], self.text if self.known else f"error: no document {rows['doc_id']}"
        else:
            self.known, self.text = True, rows["text"]


class Calculate:
    """calculate(expression): value, error; one of them is null, both for a null expression. Called as `LATERAL calculate(column)`."""

    @staticmethod
    def analyze(expression: AnalyzeArgument) -> AnalyzeResult:
        if expression.isTable or not isinstance(expression.dataType, StringType):
            raise ValueError("calculate takes one expression as text")
        return AnalyzeResult(schema=StructType().add("value", StringType()).add("error", StringType()))

    def eval(self, expression):
        said = calculator.answer(expression)
        wrong = said is not None and said.startswith("error: ")
        yield None if wrong else said, said[len("error: ") :] if wrong else None


def register(spark: SparkSession) -> None:
    for name, tool in (("search_docs", SearchDocs), ("get_doc", GetDoc), ("calculate", Calculate)):
        spark.udtf.register(name, F.udtf(tool))


def question_blocks(index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, block, docs, parts) of (query_id, query), the input of search_docs: a row for each term of a question and each segment in which the term stands.

    Segments in which a question's terms together add less than its bar, the k-th best score among first hits, hold none of its k best documents: their postings are not read.
    """
    from verdigris.operators.index import bucket_of, sent, weight
    from verdigris.sources.scratch import Scratch

    scratch = Scratch(index.spark, "blocks")
    asked = scratch.table(index.asked(queries))
    heads = index.headers(asked).withColumn("_most", F.sum("bound").over(W.partitionBy("query_id", "block")))
    reached = heads.join(index.bars(asked, k, scratch), "query_id", "left").filter(F.col("_most") * (1 + 1e-9) >= F.coalesce("bar", F.lit(0.0)))
    wanted = scratch.table(reached.select("query_id", "block", "term", "weight", bucket_of(F.col("term"), index.buckets).alias("bucket")))
    posts = index.only(index.blocks, wanted).join(sent(wanted), ["bucket", "term", "block"])
    parts = F.zip_with("tfs", "lengths", lambda tf, length: weight(tf, length, F.lit(index.average)))
    return posts.select("query_id", "block", "docs", F.transform(parts, lambda p: p * F.col("weight")).alias("parts"))
