import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from verdigris.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CHARS = "abcdefghijent    \n\n\t0123éüßñ'.,!#\x1c\x85 世界\U0001f600́"


def test_random_texts_agree_with_the_library_and_round_trip():
    r = random.Random(3)
    texts = ["".join(r.choice(CHARS) for _ in range(r.randrange(0, 120))) for _ in range(2000)] + ["a" * 3000, " " * 999 + "x", "the " * 500]
    found = bpe.encode_texts(bpe.read_vocabulary(PATH), public_tokenizers.PATTERN, texts)
    assert found == [LIBRARY.encode_ordinary(t) for t in texts]
    table = bpe.PrefixBPE(bpe.read_vocabulary(PATH))
    assert [table.decode(x).decode() for x in found] == texts


def test_pairs_are_judged_as_merging_does():
    table, r = bpe.PrefixBPE(bpe.read_vocabulary(PATH)), random.Random(4)
    tokens = [t for t in table.tokens if t]
    for _ in range(5000):
        x, y = r.choice(tokens), r.choice(tokens)
        assert table.follows(table.ranks[x], table.ranks[y]) == (table.merge(x + y) == [x, y])


def test_appends_and_edits_are_exact_and_local():
    table, r = bpe.PrefixBPE(bpe.read_vocabulary(PATH)), random.Random(5)
    data = bytes(r.choice(b"abcdeinorst") for _ in range(4000))
    kept = bpe.PrefixTable(table, data[:1500])
    kept.append(data[1500:])
    assert kept.ids() == bpe.PrefixTable(table, data).ids()
    for _ in range(30):
        at, gone = r.randrange(0, 3500), r.randrange(0, 8)
        more = bytes(r.choice(b"abcxyz") for _ in range(r.randrange(0, 9)))
        data = data[:at] + more + data[at + gone :]
        assert kept.edit(at, gone, more) < 600
        assert kept.data == data and kept.ids() == bpe.PrefixTable(table, data).ids()


def test_rows_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (None, None, None), (3, "", "y"), (4, "Grüße " * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode_documents(bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN), PATH)
    got = {(r["doc_id"], bytes(r["decoded"])): r["ids"] for r in out.collect()}
    assert out.count() == 5 and got[None, b""] == [] and got[3, b""] == []
    assert got[4, ("Grüße " * 5000).encode()] == LIBRARY.encode_ordinary("Grüße " * 5000)
    digest = bpe.digest_columns(out).filter("doc_id = 1").first()
    ids = LIBRARY.encode_ordinary("hello world")
    assert digest["n_tokens"] == len(ids) and digest["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_a_vocabulary_over_the_bound_is_refused(tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_VOCAB_BYTES", 10)
    (tmp_path / "v").write_bytes(b"x" * 11)
    with pytest.raises(ValueError):
        bpe.read_vocabulary(str(tmp_path / "v"))
