import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from lodestar.llm.encoding import Coder, stretches
from lodestar.llm.packing import pack
from lodestar.llm.token_counts import count_tokens, lengths, parts_of, processor

ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "x\n\ny z", "é à b c", "don't can't  we'll", "<|endoftext|> a <|endoftext|>", "漢字 かな a b", "a\tb c", "\x1c a \x1d b", "tab\t end ", "a\u0085b c d", "x " * 50, "1 22 333 a1 b2", ", a", ". b", "a , b . c", "a,, b.. c", "one, two. Three.\nFour, five.", "é», b. ǀ, x", "12, 3. x,\ny", "a\0, b", "... !! a!! b ?", "\r\n a\r\nb c", "😀 a 😀 b"]


def random_text(rng):
    return "".join(rng.choice(["a", "the", " ", " ", "  ", "\n", "é", "!", "12", "漢", "'s", "\t", ", ", ". ", ".\n", "<s>", "</s>"]) for _ in range(rng.randrange(60)))


TEXTS = ODD + [random_text(random.Random(i)) for i in range(400)]


def test_cut_pieces_give_the_librarys_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    c = Coder(str(P.path("byte_bpe_50k.json")))
    for x in TEXTS + ["long words here " * 100]:
        assert np.frombuffer(c.ids(x), c.dtype).tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)
    assert "".join(stretches("ab cd " * 50, 7)) == "ab cd " * 50


def test_many_texts_at_once(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from lodestar.llm import encoding

    t, path = Tokenizer.from_file(str(P.path("byte_bpe_50k.json"))), str(P.path("byte_bpe_50k.json"))
    more = TEXTS + ["a\u00a0 \u00a0b c", "x\u2003 y", "„a“ – b", None, "é, à. ×, ÷. b", "a,\nb", "end.", "end,", "a.b, c", "1, 2.\n3", "x" * 3000 + " y"]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in more]
    p = encoding.Pieces(path)
    for _ in range(2):
        assert [np.frombuffer(x, p.dtype).tolist() for x in p.column(pa.array(more))] == want
    monkeypatch.setattr(encoding, "SLOTS", 64)
    monkeypatch.setattr(encoding, "GROUP", 50)
    p = encoding.Pieces(path)
    assert [np.frombuffer(x, p.dtype).tolist() for x in p.column(pa.array(more))[:60]] == want[:60]


def test_parts_add_up():
    m = processor(str(P.path("piece_bpe_32k.model")))
    for x in TEXTS:
        for cut in (1, 5, 20):
            assert lengths(m, [x], 30, cut)[0] == len(m.encode(x)), (repr(x), cut)
    assert len(parts_of("ab cd " * 50, 7)) > 10


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(5000, None, None), (3, ODD[3], "x"), (6000, "word and more " * 3000, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


def test_packing_is_a_gapless_cut(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    pieces = pack(docs, str(P.path("byte_bpe_50k.json")), 1, 64).collect()
    by_seq, by_doc = {}, {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault(p.doc_id, []).append(p)
    for s, x in by_seq.items():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at == 64 or s == max(by_seq)
    for i, x in ((i, r) for i, r in by_doc.items() if i != 3):
        ids = t.encode(dict([(5000, ""), (6000, "word and more " * 3000)]).get(i, TEXTS[i] if i < len(TEXTS) else ""), add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(x, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    assert pack(docs.limit(0), str(P.path("byte_bpe_50k.json"))).count() == 0


def test_counts(docs):
    m = processor(str(P.path("piece_bpe_32k.model")))
    got = count_tokens(docs, str(P.path("piece_bpe_32k.model")), limit=100).collect()
    assert len(got) == docs.count()
    for r in got:
        x = "word and more " * 3000 if r.doc_id == 6000 else "" if r.doc_id == 5000 else TEXTS[r.doc_id]
        assert (r.n_bytes, r.n_tokens) == (len(x.encode()), len(m.encode(x)))
        assert r.over_limit == (r.n_tokens > 100)
    assert count_tokens(docs.limit(0), str(P.path("piece_bpe_32k.model"))).count() == 0
