"""The trie of conversations that begin alike, without ever gathering a conversation or a group of them in one task.

A node is a distinct sequence of first turns; it belongs to the smallest conversation that starts with it. Whoever owns a node owns all further nodes on its
own way down, so a conversation owns a chain: from its first owned depth to its end. That depth is found by binary search, all conversations at once: each
round joins the digest of the prefix in the middle with the smallest conversation known for that digest. (owner, depth) then names a node.

What a subtree sums to is taken chain by chain from the ends upwards: sums along a chain up to each of its nodes, and the total of each chain given to all nodes
above its top, which its own conversation's prefixes name. This needs one aggregation, however deep chains hang on chains.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from verdigris.llm.common import Scratch

#: Turns of a conversation that one window holds; ids of members that are joined to one piece of text.
BLOCK, PIECE = 1024, 4096
KEY = ["depth", "hi", "lo"]


def numbered(conversations: DataFrame, scratch: Scratch, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, lengths): (conv, pos from 0, digest of role and text, bytes of the text), and (conv, n).

    Turns go by `turn`, nulls first; turns alike in it by digest. Null roles and texts are empty; rows without a key are of no conversation. Rows are sorted over
    all partitions and numbered where they stand, so a conversation may lie in many of them; at most one conversation continues into each partition, and what
    lies before it is all that is broadcast.
    """
    said, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said).cast("binary"), 256), 1, 32))
    rows = conversations.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(said).cast("long").alias("bytes"))
    order = ["conv", "turn", "digest"]

    def count(batches):
        last, held = None, 0
        for batch in batches:
            conv = batch.column("conv").to_numpy()
            if not len(conv):
                continue
            begins = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            k = np.arange(len(conv)) - np.repeat(begins, np.diff(begins, append=len(conv)))
            if last == conv[0]:
                k[: begins[1] if len(begins) > 1 else len(conv)] += held
            last, held = conv[-1], int(k[-1]) + 1
            yield pa.RecordBatch.from_pydict({"part": np.full(len(conv), TaskContext.get().partitionId()), "conv": conv, "k": k, "digest": batch.column("digest"), "bytes": batch.column("bytes")})

    own = scratch.table(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(count, "part long, conv long, k long, digest binary, bytes long"))
    counts = own.groupBy("conv", "part").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    moved = counts.select("conv", "part", earlier.alias("earlier")).filter("earlier > 0")
    turns = own.join(F.broadcast(moved), ["conv", "part"], "left").select("conv", (F.col("k") + F.coalesce("earlier", F.lit(0))).alias("pos"), "digest", "bytes")
    return turns, counts.groupBy("conv").agg(F.sum("n").alias("n"))


def with_shared_heads(turns: DataFrame, lengths: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of conversations rebuilt: the first `head` turns (at most `most`) of conversation `base`, then their own turns from `head` on. base and head
    are of column conv."""
    plan = lengths.select("conv", "n", base.alias("base"), head.alias("head"))
    of_base = lengths.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    plan = plan.join(of_base, "base", "left").withColumn("kept", F.least("head", F.coalesce("n_base", F.lit(0))))
    first = turns.filter(F.col("pos") < most).withColumnRenamed("conv", "base")
    heads = first.join(plan.select("conv", "base", "head"), "base").filter("pos < head").select("conv", "pos", "digest", "bytes")
    tails = turns.join(plan.select("conv", "head", "kept"), "conv").filter("pos >= head").select("conv", (F.col("pos") - F.col("head") + F.col("kept")).alias("pos"), "digest", "bytes")
    return heads.unionByName(tails), plan.select("conv", (F.col("kept") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("n"))


def running(rows: DataFrame, at: str, names: list[str], fold: Callable[[str], Column], both: Callable[[Column, Column], Column]) -> DataFrame:
    """rows with each of the columns folded over the rows of its conversation up to its own, by the whole number `at`: in blocks, then over blocks."""
    rows = rows.withColumn("_block", F.expr(f"{at} div {BLOCK}"))
    inside = W.partitionBy("conv", "_block").orderBy(at).rowsBetween(W.unboundedPreceding, W.currentRow)
    blocks = rows.groupBy("conv", "_block").agg(*(fold(c).alias(c) for c in names))
    before = W.partitionBy("conv").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("conv", "_block", *(fold(c).over(before).alias(f"_{c}") for c in names)).filter("_block > 0")
    rows = rows.withColumns({c: fold(c).over(inside) for c in names}).join(blocks, ["conv", "_block"], "left")
    return rows.withColumns({c: both(F.col(c), F.coalesce(f"_{c}", F.lit(0))) for c in names}).drop("_block", *(f"_{c}" for c in names))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, hi, lo, bytes) for each conversation's first `depth` turns, 1 at least: their digest is the exclusive or, in 128 bits, of a hash of each
    turn with its place, and `bytes` is the last text's."""
    term = lambda n: F.xxhash64(F.lit(n), "pos", "digest")
    rows = turns.select("conv", "pos", term(1).alias("hi"), term(2).alias("lo"), "bytes")
    rows = running(rows, "pos", ["hi", "lo"], F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    return rows.select("conv", (F.col("pos") + 1).alias("depth"), "hi", "lo", "bytes")


def first_owned(lengths: DataFrame, longest: int, paths: DataFrame, minima: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, last, first): the least depth of 1 and more at which the conversation owns its prefix, last + 1 if it owns none."""
    state = scratch.table(lengths.select("conv", F.col("n").alias("last"), F.lit(1).cast("long").alias("low"), (F.col("n") + 1).alias("high")))
    owners = minima.select(*KEY, "owner")
    for _ in range(longest.bit_length()):
        asked = state.filter("low < high").select("conv", F.expr("(low + high) div 2").alias("depth"))
        told = asked.join(paths.select("conv", *KEY), ["conv", "depth"]).join(owners, KEY).select("conv", F.col("depth").alias("mid"), (F.col("owner") == F.col("conv")).alias("owned"))
        after = state.join(told, "conv", "left")
        low = F.when(F.col("owned") == F.lit(False), F.col("mid") + 1).otherwise(F.col("low"))
        high = F.when(F.col("owned"), F.col("mid")).otherwise(F.col("high"))
        done, state = state, scratch.table(after.select("conv", "last", low.alias("low"), high.alias("high")))
        scratch.drop(done)
    return state.select("conv", "last", F.col("low").alias("first"))


def digests(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, depth, ends_sha256) of (conv, depth, member): the digest of a node's members in ascending order, comma-joined.

    Members are sorted over all partitions and joined to pieces there, so a node of very many reaches its one digest as few long rows that stream by.
    """

    def pieces(batches):
        node, first, held = None, None, []
        made = {"conv": [], "depth": [], "first": [], "ids": []}

        def put():
            for name, x in zip(made, (*node, first, ",".join(held))):
                made[name].append(x)

        for batch in batches:
            for conv, depth, member in zip(*(batch.column(c).to_pylist() for c in ("conv", "depth", "member"))):
                if (conv, depth) != node or len(held) >= PIECE:
                    if held:
                        put()
                    node, first, held = (conv, depth), member, []
                held.append(str(member))
            if made["conv"]:
                yield pa.RecordBatch.from_pydict(made, schema=piece)
                for x in made.values():
                    x.clear()
        if held:
            put()
            yield pa.RecordBatch.from_pydict(made, schema=piece)

    def hashed(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv", "depth", "ids"))):
                if (conv, depth) != node:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (conv, depth), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else ((), (), ()), digest.types)], schema=digest)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*node, state.hexdigest()), digest.types)], schema=digest)

    piece = pa.schema([("conv", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    digest = pa.schema([("conv", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    order = ["conv", "depth", "member"]
    joined = scratch.table(ends).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "conv long, depth long, first long, ids string")
    streams = joined.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "first")
    return streams.mapInArrow(hashed, "conv long, depth long, ends_sha256 string")


def build(turns: DataFrame, lengths: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of the trie of conversations: turns (conv, pos from 0, digest, bytes), lengths (conv, n), a row for each conversation, those without turns too.

    conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children, n_leaves (childless nodes of the subtree, its top
    included), saved_tokens (over the subtree, the bytes of each node's last text for all members but one), ends_sha256 (of the members that end at the node). No
    conversations give no nodes.
    """
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    lengths = scratch.table(lengths)
    root, n_convs, longest = lengths.agg(F.min("conv"), F.count("*"), F.max("n")).head()
    if root is None:
        return lengths.sparkSession.createDataFrame([], ", ".join(f"{c} long" for c in names) + ", ends_sha256 string")
    at_root = F.lit(root).cast("long")
    paths = scratch.table(prefixes(turns))
    minima = scratch.table(paths.groupBy(*KEY).agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes")))
    found = first_owned(lengths, longest, paths, minima, scratch)
    # the owner of the root owns all of its way
    owns = scratch.table(found.withColumn("first", F.when(F.col("conv") == at_root, F.lit(0).cast("long")).otherwise(F.col("first"))))
    chains = owns.filter("first <= last")
    owner_of = lambda asked: asked.join(paths.select("conv", *KEY), ["conv", "depth"]).join(minima.select(*KEY, "owner"), KEY)
    below_root = chains.filter("first = 1").select("conv", "first", "last", at_root.alias("parent"))
    tops = owner_of(chains.filter("first > 1").withColumn("depth", F.col("first") - 1)).select("conv", "first", "last", F.col("owner").alias("parent")).unionByName(below_root)
    tops = scratch.table(tops.unionByName(chains.filter("first = 0").select("conv", "first", "last", F.lit(None).cast("long").alias("parent"))))
    hanging = tops.filter("first > 0").groupBy(F.col("parent").alias("conv"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("hanging"))

    top_row = lengths.sparkSession.createDataFrame([(root, 0, n_convs, 0)], "conv long, depth long, n_convs long, bytes long")
    nodes = minima.select(F.col("owner").alias("conv"), "depth", "n_convs", "bytes").unionByName(top_row)
    nodes = nodes.join(tops, "conv").join(hanging, ["conv", "depth"], "left")
    children = F.coalesce("hanging", F.lit(0)) + (F.col("depth") < F.col("last")).cast("long")
    parent = F.when(F.col("depth") > F.col("first"), F.col("conv")).otherwise(F.col("parent"))
    nodes = nodes.select("conv", "depth", "first", parent.alias("parent"), "n_convs", children.alias("children"), (children == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    nodes = scratch.table(nodes)

    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    totals = scratch.table(nodes.groupBy("conv", "first").agg(*sums))
    hung = totals.filter("first > 0")
    above = paths.join(hung, "conv").filter("depth < first").groupBy(*KEY).agg(*sums).join(minima.select(*KEY, "owner"), KEY)
    above = above.select(F.col("owner").alias("conv"), "depth", "leaves", "saved").unionByName(hung.agg(at_root.alias("conv"), F.lit(0).cast("long").alias("depth"), *sums))
    above = above.select("conv", "depth", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    so_far = running(nodes.select("conv", "depth", F.col("leaves").alias("l"), F.col("saved").alias("s")), "depth", ["l", "s"], F.sum, lambda a, b: a + b)
    whole = totals.select("conv", F.col("leaves").alias("all_leaves"), F.col("saved").alias("all_saved"))
    summed = nodes.join(so_far, ["conv", "depth"]).join(whole, "conv").join(above, ["conv", "depth"], "left")
    from_here = lambda name, up_to: F.col(f"all_{name}") - F.col(up_to) + F.col(name) + F.coalesce(f"more_{name}", F.lit(0))

    guests = owner_of(owns.filter("first > last and last > 0").withColumn("depth", F.col("last"))).select(F.col("owner").alias("conv"), "depth", F.col("conv").alias("member"))
    silent = owns.filter("last = 0").select(at_root.alias("conv"), F.col("last").alias("depth"), F.col("conv").alias("member"))
    hosts = chains.filter("last > 0").select("conv", F.col("last").alias("depth"), F.col("conv").alias("member"))
    ended = digests(guests.unionByName(silent).unionByName(hosts), scratch)
    out = summed.join(ended, ["conv", "depth"], "left")
    none = F.lit(hashlib.sha256().hexdigest())
    made = [F.col("conv"), F.col("depth"), F.col("parent"), F.col("n_convs"), F.col("children"), from_here("leaves", "l"), from_here("saved", "s")]
    return out.select(*(c.cast("long").alias(n) for c, n in zip(made, names)), F.coalesce("ends_sha256", none).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of conversations as they are; see `build` for the columns and `numbered` for nulls and ties. Repeated rows are turns of their own; texts are digested whole;
    other columns are ignored."""
    scratch = Scratch(conversations.sparkSession, "trie")
    return build(*numbered(conversations, scratch, key, turn, role, text), scratch)


def shared_trie(conversations: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """The trie after conversation c has taken over the first crc32(c) % (most + 1) turns of conversation c - c % every in place of as many of its own; where that
    one is absent, or shorter, none or all of it. Nulls and ties as in `prefix_trie`."""
    scratch = Scratch(conversations.sparkSession, "trie")
    turns, lengths = numbered(conversations, scratch)
    base, head = F.col("conv") - F.col("conv") % every, F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)
    return build(*with_shared_heads(turns, lengths, base, head, most), scratch)
