import random

import numpy as np
import public_tokenizers

from verdigris.llm import packing


def slow_best_fit(lengths, length):
    rows, free = [], []
    for s in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [i for i in range(len(rows)) if free[i] >= lengths[s]]
        if fits:
            i = min(fits, key=lambda i: free[i])
        else:
            i = len(rows)
            rows.append([])
            free.append(length)
        rows[i].append(s)
        free[i] -= lengths[s]
    return rows


def test_segment_tree_packs_as_well_as_a_search_of_all_rows():
    r = random.Random(6)
    for length in (1, 7, 64, 100):
        lengths = np.array([r.randrange(1, length + 1) for _ in range(300)])
        rows = packing.best_fit_decreasing(lengths, length)
        assert sorted(s for row in rows for s in row) == list(range(300))
        assert all(lengths[row].sum() <= length for row in rows)
        assert len(rows) == len(slow_best_fit(lengths.tolist(), length))


def test_packing_is_lossless(spark):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma!", "dé"]) for _ in range(r.randrange(0, 200)))) for i in range(120)] + [(500, "long text " * 4000), (501, None), (502, ""), (None, "no key")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = packing.pack_documents(docs, path, public_tokenizers.PATTERN, length=256, shard_tokens=3000).collect()
    encode, n_ids = packing.library_encoder(open(path, "rb").read(), public_tokenizers.PATTERN)
    got = {}
    for x in out:
        ids, cu = np.frombuffer(x["ids"], np.uint16), x["cu_seqlens"]
        assert len(ids) == 256 and cu[0] == 0 and cu[-1] == x["n_tokens"] <= 256 and (ids[cu[-1] :] == n_ids).all()
        assert x["position_resets"] == cu[:-1] and len(cu) == len(x["doc_ids"]) + 1
        for a, b, d, o in zip(cu, cu[1:], x["doc_ids"], x["doc_offsets"]):
            assert (d, o) not in got
            got[d, o] = ids[a:b].tolist()
    for d, t in rows:
        have = [i for k in sorted(o for e, o in got if e == d) for i in got[d, k]]
        assert have == (encode(t, disallowed_special=()).tolist() if t else [])
    assert packing.pack_documents(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0
