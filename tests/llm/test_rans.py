import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import rans
from lodestar.llm.rans import LANES, STEPS, Table, encode_corpus, read_blocks, scaled


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 5000), st.integers(1, 300), st.integers(0, 9))
def test_round_trip(n, kinds, seed):
    ids = (np.random.default_rng(seed).zipf(1.3, n) % kinds).astype(np.uint16)
    t = Table(*scaled(dict(zip(*[x.tolist() for x in np.unique(ids, return_counts=True)], strict=True))))
    if n:
        states, words, _ = t.encode(ids)
        assert (t.decode(n, states, words) == ids).all()


def test_decoding_from_checkpoints_and_size():
    ids = (np.random.default_rng(1).zipf(1.5, LANES * STEPS * 3 + 17) % 40000).astype(np.uint16)
    sym, n = np.unique(ids, return_counts=True)
    t = Table(*scaled(dict(zip(sym.tolist(), n.tolist(), strict=True))))
    states, words, marks = t.encode(ids)
    assert [m[0] for m in marks] == [STEPS, 2 * STEPS, 3 * STEPS]
    for step, word, s in marks:
        assert (t.decode(len(ids), s, words, step, word) == ids[step * LANES :]).all()
    assert (t.decode_block(len(ids), states, words, marks) == ids).all()
    entropy = -(n * np.log2(n / n.sum())).sum() / 8
    assert len(words) < 1.02 * entropy + 8 * LANES


@pytest.mark.parametrize("n", [1, 5, LANES - 1, LANES, LANES * STEPS, LANES * STEPS + 1, LANES * (STEPS + 1), LANES * STEPS * 2 - 3, LANES * STEPS * 2])
def test_stretches_between_checkpoints(n):
    ids = np.random.default_rng(n).integers(0, 70_000, n).astype(np.uint32)
    sym, c = np.unique(ids, return_counts=True)
    t = Table(*scaled(dict(zip(sym.tolist(), c.tolist(), strict=True))))
    states, words, marks = t.encode(ids)
    assert (t.decode_block(n, states, words, marks) == ids).all() and (t.decode(n, states, words) == ids).all()


def test_frequencies():
    s, f = scaled({5: 1, 9: 10**12, 7: 3})
    assert s == [5, 7, 9] and sum(f) == 1 << rans.SCALE and min(f) >= 1
    assert scaled({}) == ([], [])


def test_file(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(rans, "BLOCK", 200)
    texts = {i: f"word{i} " * (i % 30) for i in range(0, 200)} | {500: None, 501: "", 502: "a b c " * 4000}
    rows = [(i, t, "x") for i, t in texts.items()] + [(7, texts[7], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    path = encode_corpus(docs, str(P.path("byte_bpe_50k.json")), 2)
    got = sorted(read_blocks(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([i for i, _, _ in rows])
    t, at = Tokenizer.from_file(str(P.path("byte_bpe_50k.json"))), 0
    for r in got:
        ids = np.array(t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (at, len(ids) // 4, zlib.crc32(ids), ids)
        at += r.n_tokens
    assert read_blocks(spark, encode_corpus(docs.limit(0), str(P.path("byte_bpe_50k.json")))).count() == 0


def test_damage_is_seen(spark):
    docs = spark.createDataFrame([(1, "a b c d " * 50)], "doc_id long, text string")
    path = encode_corpus(docs, str(P.path("byte_bpe_50k.json")))
    b = spark.read.parquet(path + "/blocks").toPandas()
    b["crc32"] = b["crc32"] + 1
    spark.createDataFrame(b, rans.BLOCKS).write.parquet(path + "x/blocks")
    spark.read.parquet(path + "/table").write.parquet(path + "x/table")
    with pytest.raises(Exception, match="damaged"):
        read_blocks(spark, path + "x").collect()
