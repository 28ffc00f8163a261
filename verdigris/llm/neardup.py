"""Near-duplicate documents: MinHash with banding, signature and exact verification, components by alternating stars.

A document is the set of its distinct 3-word shingles. Equal texts are one node first (named by 128 bits of their SHA-256), so a
group of exact copies, however large, is one node; texts that differ but have equal sets are compared like all others. Nodes with an equal band of minima share a bucket. In a bucket, every member is
compared with a pivot, never all with all; what is then linked needs no more comparing. Members whose components still differ
are compared with further pivots, and the few that stay apart after PIVOTS rounds with each other: directly in small
buckets, and in larger ones only where two share one of their rarest shingles, which sets as similar as asked must do. No link is lost to a cap.

With 6 minima a band and 32 bands, a pair at the threshold 0.85 misses every bucket with probability 2.6e-7, one at 0.9
with 2e-11.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import Scratch, Words, free_names, give_back, mix, slices, utf8

SHINGLE, PERCENT = 3, 85
MINIMA, BANDS = 6, 32
K = MINIMA * BANDS
#: Estimated similarity below which a pair is not looked at further: the threshold less six standard errors of K minima.
LEAST_ESTIMATE = PERCENT / 100 - 6 * (PERCENT / 100 * (1 - PERCENT / 100) / K) ** 0.5
PIVOTS = 3
#: Residual buckets of more members than this are compared by rare shingles.
SMALL_BUCKET = 8
_random = np.random.default_rng(20240501)
MULTIPLY = _random.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _random.integers(0, 1 << 63, K, dtype=np.uint64)


def shingle_sets(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, end to end, and how many each text has."""
    w = Words(raw, off)
    h, at = w.windows(SHINGLE)
    row = w.row[at]
    n_words = np.diff(w.first)
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):  # one shingle, the whole sequence
        with np.errstate(over="ignore"):
            first = w.hash[w.first[short]]
            second = np.where(n_words[short] > 1, w.hash[np.minimum(w.first[short] + 1, len(w.hash) - 1)], np.uint64(0))
            extra = mix(first * np.uint64(0xA0761D6478BD642F) + second + n_words[short].astype(np.uint64))
        h, row = np.concatenate([h, extra]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    ends = np.searchsorted(row, np.arange(w.n_rows + 1))
    sets = [np.unique(h[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.array([len(s) for s in sets], np.int64)


def signatures(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the texts that have shingles: minima (rows x K, uint64), band keys (rows x BANDS, int64)."""
    counts = counts[counts > 0]
    if not len(counts):
        return np.zeros((0, K), np.uint64), np.zeros((0, BANDS), np.int64)
    starts = np.cumsum(counts) - counts
    minima = np.empty((len(counts), K), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(K):
            minima[:, k] = np.minimum.reduceat(flat * MULTIPLY[k] + ADD[k], starts)
        key = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(counts), 0)
        for i in range(MINIMA):
            key = mix(key * np.uint64(0xE7037ED1A0B428DB) + minima[:, i::MINIMA])
    return minima, key.view(np.int64)


def digest_of(text: Column) -> Column:
    """128 bits of the SHA-256 of a text; null texts are empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_shingles, bands, sig (low 16 bits of each minimum) of (doc_id, digest, text); the last two null without shingles."""

    def run(batches):
        for b in batches:
            raw, off = utf8(b.column(2))
            for lo, hi in slices(off):
                flat, counts = shingle_sets(raw, off[lo : hi + 1])
                minima, bands = signatures(flat, counts)
                empty = counts == 0
                place = np.where(empty, 0, np.cumsum(~empty) - 1).astype(np.int32)
                take = pa.array(place, mask=empty)
                low = np.ascontiguousarray(minima.astype(np.uint16))
                band_lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo),
                    b.column(1).slice(lo, hi - lo),
                    pa.array(counts),
                    band_lists.take(take),
                    pa.array([s.tobytes() for s in low], pa.binary()).take(take),
                ], names=["doc_id", "digest", "n_shingles", "bands", "sig"])
        give_back()

    return docs.mapInArrow(run, "doc_id long, digest binary, n_shingles long, bands array<long>, sig binary")


def likely(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) whose signatures agree often enough."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, K) for i in (2, 3))
                ok = (x == y).mean(1) >= LEAST_ESTIMATE
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return pairs.mapInArrow(run, pairs.select("a", "b").schema)


def text_shingles(text: str | None) -> set:
    words = (text or "").encode().lower().split()
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE))))


def confirmed(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, text_a, text_b) whose full sets reach the threshold."""

    def run(batches):
        kept_id, kept = None, set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                ok = []
                for a, x, y in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if kept_id != a:
                        kept_id, kept = a, text_shingles(x)
                    other = text_shingles(y)
                    both = len(kept & other)
                    ok.append(100 * both >= PERCENT * (len(kept) + len(other) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(run, pairs.select("a", "b").schema)


def rare_shingles(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, token, place, size): each text's rarest shingles among `texts`, from the rarest on (place from 1), as many as two similar sets cannot both be without."""

    def run(batches):
        for b in batches:
            raw, off = utf8(b.column(1))
            for lo, hi in slices(off):
                flat, counts = shingle_sets(raw, off[lo : hi + 1])
                nodes = b.column(0).slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), counts)))
                size = np.repeat(counts, counts)
                yield pa.RecordBatch.from_arrays([nodes, pa.array(size), pa.array(flat.view(np.int64))], names=["node", "size", "token"])

    tokens = scratch.table(texts.select("node", "text").mapInArrow(run, "node binary, size long, token long"))
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    ranked = tokens.join(often, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("list"))
    size = F.size("list")
    need = size - F.ceil(size * F.lit(PERCENT / 100) - 1e-9) + 1
    first = ranked.select("node", size.alias("size"), F.posexplode(F.slice("list", F.lit(1), need.cast("int"))).alias("place", "x"))
    return first.filter("x.often > 1").select("node", "x.token", F.col("place") + 1, "size").toDF("node", "token", "place", "size")


#: Two sets whose first common shingle, in order of rarity, stands at these places can still be similar enough. It is the first common one that
#: must fulfil this, so no similar pair is lost.
WITHIN_REACH = f"{100 + PERCENT} * (least(size_a - place_a, size_b - place_b) + 1) >= {PERCENT} * (size_a + size_b) and 100 * least(size_a, size_b) >= {PERCENT} * greatest(size_a, size_b)"


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of links (a, b): component is the smallest node reachable. Alternating large-star and small-star."""

    def written(df):
        return scratch.table(df.filter("u > v").distinct())

    def settled(edges):
        """Each node has one edge to a smaller one, which has none: the components are stars around their smallest nodes."""
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("center")).union(edges.select("v", F.lit(0), F.lit(1)))
        return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("center").alias("center")).filter("up > 1 or (up = 1 and center = 1)").isEmpty()

    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while not settled(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first, so that the join deals out both sides anew and the edges of a hub can be split over tasks
        least = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        scratch.drop(least)
        least = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")))
        found = written(large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))))
        scratch.drop(edges, large, least)
        edges = found
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def find_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of `docs`.

    Texts that are null, empty or without words have no shingles and link with nothing; rows without a key link with nothing
    and are kept; of a key that stands on several texts, each text is a document of its own; component_id is the smallest key of the component;
    repeated rows get equal rows; very long texts are read whole; other columns are ignored; an empty table gives an empty result.
    """
    return grouped(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))).drop("digest")


def grouped(source: DataFrame) -> DataFrame:
    """find_groups of (doc_id, text), with the digest of each row's text."""
    scratch = Scratch(source.sparkSession, "neardup")
    source = source.select("doc_id", digest_of(F.col("text")).alias("digest"), "text")
    prints = scratch.table(fingerprints(source))
    usable = prints.filter("doc_id is not null and n_shingles > 0")
    classes = scratch.table(usable.groupBy("digest").agg(F.min("doc_id").alias("least")))
    reps = classes.select(F.col("digest").alias("node"), "least")
    of_rep = (F.col("digest") == F.col("node")) & (F.col("doc_id") == F.col("least"))
    nodes = scratch.table(usable.join(reps, of_rep).groupBy("node").agg(*(F.first(c).alias(c) for c in ("n_shingles", "bands", "sig"))))
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    # written first, so that the join deals out both sides anew and a bucket with many members can be split over tasks
    shared = scratch.table(members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).filter("n > 1"))
    buckets = scratch.table(members.join(shared, "bucket").select("bucket", "node", "pivot"))
    wanted = buckets.select(F.col("node").alias("w")).distinct()
    some = reps.join(wanted, F.col("node") == F.col("w"), "left_semi")
    texts = scratch.table(source.join(some, of_rep).groupBy("node").agg(F.first("text").alias("text")))
    marks = scratch.table(nodes.join(wanted, F.col("node") == F.col("w"), "left_semi").select("node", "n_shingles", "sig"))

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda s: marks.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"))
        sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
        some = scratch.table(likely(sized.select("a", "b", "sig_a", "sig_b")).distinct())
        left, right = (texts.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}")) for s in ("a", "b"))
        return scratch.table(confirmed(some.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")).distinct())

    links = verify(buckets.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    whole = components(links, scratch)
    rest = buckets.filter("node <> pivot").select("bucket", "node")

    def unsettled(rest: DataFrame, whole: DataFrame) -> DataFrame:
        """Members of buckets that still hold two components at least."""
        rest = scratch.table(rest.join(whole, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component")))
        of = scratch.table(rest.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).filter("x <> y"))
        return scratch.table(rest.join(of, "bucket").select("bucket", "node", "component", "n"))

    rest = unsettled(rest, whole)
    for turn in range(1, PIVOTS):
        if rest.isEmpty():
            break
        pivot = rest.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "component")).alias("p")).select("bucket", "p.node", "p.component").toDF("bucket", "pivot", "of")
        pivot = scratch.table(pivot)
        tried = rest.join(pivot, "bucket").filter("node <> pivot")
        more = tried.filter("component <> of").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
        links = scratch.table(whole.select(F.col("component").alias("a"), F.col("node").alias("b")).union(verify(more)))
        whole = components(links, scratch)
        rest = unsettled(tried.select("bucket", "node"), whole)
    if not rest.isEmpty():
        sides = lambda t, by: [t.select(by, *(F.col(c).alias(f"{c}_{s}") for c in t.columns if c != by)) for s in ("a", "b")]
        apart = "component_a <> component_b and node_a < node_b"
        x, y = sides(rest.filter(F.col("n") <= SMALL_BUCKET).drop("n"), "bucket")
        more = x.join(y, "bucket").filter(apart).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        large = scratch.table(rest.filter(F.col("n") > SMALL_BUCKET).select("node", "component").distinct())
        if not large.isEmpty():
            rare = rare_shingles(texts.join(large, "node", "left_semi").dropDuplicates(["node"]), scratch).join(large, "node")
            rare = scratch.table(rare)
            of = rare.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("token")
            x, y = sides(scratch.table(rare.join(scratch.table(of), "token")), "token")
            more = more.union(x.join(y, "token").filter(f"{apart} and {WITHIN_REACH}").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
        links = scratch.table(whole.select(F.col("component").alias("a"), F.col("node").alias("b")).union(verify(more.distinct())))
        whole = components(links, scratch)
    of = scratch.table(reps.join(whole, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")))
    ids = of.groupBy("component").agg(F.min("least").alias("component_id"))
    # only texts that share a component need its smallest key looked up
    of = scratch.table(of.join(ids, "component").select(F.col("node").alias("d"), "component_id"))
    scratch.keep(prints, of)
    out = prints.select("doc_id", "n_shingles", "digest").join(of, F.col("digest") == F.col("d"), "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "digest").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one document of each group: that with the smallest key. A row goes only for its own text: if the text links to one of a smaller
    key, or if another row has the same key and text; different texts under one key stay unless they are linked to others. Of rows that
    share key and text, one stays, whichever; rows whose text is null, empty or without words stay, and so do rows without a key (equal ones once);
    an empty table gives an empty result; all columns stay, whatever their names."""
    key_, digest = free_names(docs, "key", "digest")
    found = grouped(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")))
    gone = found.filter("not kept").select(F.col("doc_id").alias(key_), F.col("digest").alias(digest)).distinct()
    named = docs.withColumn(digest, digest_of(F.col(text)))
    left = named.join(gone, (F.col(key).cast("long") == gone[key_]) & (named[digest] == gone[digest]), "left_anti")
    # rows alike in key and text, which only tables with repeated keys hold: found by key and digest alone, and only they are gathered
    twice = found.groupBy(F.col("doc_id").alias(key_), F.col("digest").alias(digest)).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    if twice.isEmpty():
        return left.drop(digest)
    same = F.col(key).cast("long").eqNullSafe(twice[key_]) & (left[digest] == twice[digest])
    return left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates([key, digest])).drop(digest)
