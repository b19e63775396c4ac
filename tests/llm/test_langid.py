import math
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from lodestar.llm import langid
from lodestar.llm.common import fold
from lodestar.llm.langid import Model, SuffixAutomaton, identify, learn, parse, predict
from lodestar.llm.wordhash import bytes_of

SF = "/root/testdata/sf0.001"


def brute_phrases(text, w):
    if len(w) > langid.LONGEST:
        return sum(brute_phrases(text, w[i : i + langid.LONGEST]) for i in range(0, len(w), langid.LONGEST))
    n = i = 0
    while i < len(w):
        k = 1
        while i + k < len(w) + 1 and w[i : i + k] in text:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def one(m, text):
    langs, score, _ = m.predict(pa.array([text], pa.string()))
    return langs[0], score[0]


def test_automaton_against_brute_force(monkeypatch):
    rng = random.Random(2)
    for longest in (7, 130, 4096):
        monkeypatch.setattr(langid, "LONGEST", longest)
        for _ in range(25):
            texts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 60))).encode() for _ in range(3)]
            automata = [SuffixAutomaton(x) for x in texts]
            words = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([0, 3, 12, 130, 300]))) for _ in range(30)]
            want = [[brute_phrases(t, w.encode()) for t in texts] for w in words]
            assert parse(automata, *bytes_of(pa.array(words))).tolist() == want


def test_model():
    m = Model({"en": (" the cat and the dog are ", 5), "de": (" der hund und die katze ist ", 3)})
    assert one(m, "The dog and cat")[0] == "en" and one(m, "die katze und hund!")[0] == "de"
    for t in (None, "", "123 !!", "²½ 7"):
        assert one(m, t) == ("und", 0.0)
    assert 0 < one(m, "x")[1] <= 1 and one(m, "zzz")[0] == "en"
    assert one(Model({}), "abc") == ("und", 0.0)


def test_phrases_cross_words():
    m = Model({"a": ("red cat green dog", 1), "b": ("red dog green cat", 1)})
    assert one(m, "RED, dog")[0] == "b" and one(m, "red cat")[0] == "a"


def test_query_against_brute_force(spark):
    d = spark.read.parquet(SF + "/documents.parquet")
    samples = learn(d.where(fold("doc_id", 4) != 2), chars=5000)
    assert all(2000 < len(t) <= 5000 + 200 for t, _ in samples.values())
    plain = lambda t: re.sub(r"[\W\d_]+", " ", (t or "").lower()).encode()
    got = {r.doc_id: r for r in predict(d, samples).collect()}
    order = sorted(samples, key=lambda k: (-samples[k][1], k))
    for r in d.orderBy("n_chars").limit(60).collect():
        cost = [brute_phrases(plain(samples[k][0]), plain(r.text)) * math.log2(len(plain(samples[k][0])) + 2) for k in order]
        best = min(cost)
        assert got[r.doc_id].lang_pred == order[cost.index(best)], r.text
        assert abs(got[r.doc_id].score - 1 / sum(2 ** -min(60, 0.25 * (c - best)) for c in cost)) < 1e-9
        assert abs(got[r.doc_id].level - best / len(plain(r.text))) < 1e-9


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = identify(d).join(d.select("doc_id", "lang"), "doc_id").where(fold("doc_id", 4) == 2)
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97, right


def test_odd_rows(spark):
    d = spark.createDataFrame([(1, "the cat", "en", 1.0), (3, "der hund", "de", 1.0), (3, "der hund", "de", 1.0), (4, None, None, 0.0), (5, "cat cat " * 30000, None, 0.0), (6, "12", "de", 0.0), (None, "der hund ist hier", "de", 0.0)], "doc_id long, text string, lang string, score double").repartition(2)
    s = learn(d)
    assert set(s) == {"en", "de"}
    got = {(r.doc_id, r.lang_pred) for r in predict(d, s).collect()}
    assert got == {(1, "en"), (3, "de"), (4, "und"), (5, "en"), (6, "und"), (None, "de")}
    kept = predict(d, s, keep=True, suffix="_x")
    assert kept.columns == [*d.columns, "lang_pred_x", "score_x", "level_x"] and kept.count() == 7
    assert predict(d.limit(0), learn(d.limit(0))).count() == 0
    assert "hier" in learn(d.where("doc_id is null"))["de"][0]
    long = learn(spark.createDataFrame([(1, "x" * 90, "a"), (2, "yy " * 20, "a")], "doc_id long, text string, lang string"), chars=40)
    assert long["a"][0] == ("yy " * 20)[:40]
    tied = predict(d, {"b": ("same words", 1), "a": ("same words", 1)})
    assert {r.lang_pred for r in tied.where("doc_id in (1, 3)").collect()} == {"a"}


def test_null_ids_teach(spark):
    d = spark.createDataFrame([(None, "der hund ist hier", "de"), (7, "the dog is here", "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in identify(d).where("doc_id is null").collect()} == {"de"}
