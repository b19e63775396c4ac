"""Toxicity of texts whose words may be disguised.

Noisy channel: a token that isn't a word of the model and has digits or symbols among letters, a repeated letter, or
letters set apart is a lattice of what its writer may have meant; three or more single characters in a row, on one line or
several, may be several words, so each place of their lattice may start one. Viterbi search under a character language
model finds the cheapest reading. Both the token's own letters and the words of its reading are looked up in a lexicon of
whole words and word starts that labelled documents tie to toxicity, and so are words cut in two by white space, unless
both halves are words; a logistic model of the hits gives the score. A reading that only leaves out one of two equal
letters counts as whole words, as many plain words have such letters.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import drop, fold, prepare, resident, written
from lodestar.llm.wordhash import NOT_SPACE, Words, bytes_of, groups, runs

#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l", "¡": "i"}
#: Costs, in natural logarithms, of reading a sign as a letter, of leaving it out, and of shortening a run.
SIGN, OMIT, RUN = 1.0, 3.0, 0.5
#: The longest token that is remembered; longer ones are worked out each time.
LONGEST = 64
#: Features of a text in which so many different kinds of tokens hit the lexicon.
SEVERAL = ((2, "#2"), (3, "#3"), (5, "#5"))
#: The share of toxic documents from which a feature decides alone.
SURE = 0.95
#: Letters of the shortest word that is looked for in two halves.
HALVED = 4
#: Tokens, and steps of the character model, that a worker remembers, and characters of such tokens.
STORE, STORE_CHARS = 300_000, 4_000_000
#: Bits of the filter of labelled ids: for each id, and at most (a million words of it are 64 bits each).
ID_BITS, MOST_BITS = 16, 1 << 26

_LETTERS = re.compile(r"[^\W\d_]+")
_SIGNS = re.escape("".join(LEET))
_SIGN = re.compile(f"[{_SIGNS}]")
_BROKEN = re.compile(r"([^\W\d_])\1\1|[^\W\d_][.\-_*~'][^\W\d_]")
_DOUBLED = re.compile(r"([^\W\d_])\1")
_TAIL = re.compile(r"[\s.,;:?!\"'“”»«()\[\]{}]+$|([#*%&$!|<>+=~^-])\1+$")
_HEAD = re.compile(r"^[\s.,;:?\"'“”»«()\[\]{}#*%&<>=~^-]+")
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
#: Signs that _TAIL and _HEAD take off a token whatever else it has.
_AFTER, _BEFORE = ".,;:?!\"'“”»«()[]{}", ".,;:?\"'“”»«()[]{}#*%&<>=~^-"


class CharModel:
    """Interpolated character model of words with contexts of up to `order` characters."""

    def __init__(self, words: dict[str, float], order: int = 3) -> None:
        self.order = order
        self.words = frozenset(words)
        self.counts: dict[str, Counter] = {}
        self.cache: dict[tuple[str, str], float] = {}
        for w, n in words.items():
            x = "^" * order + w + "$"
            for i in range(order, len(x)):
                for k in range(order + 1):
                    self.counts.setdefault(x[i - k : i], Counter())[x[i]] += n
        self.totals = {c: (sum(v.values()), len(v)) for c, v in self.counts.items()}

    def cost(self, context: str, c: str) -> float:
        """-log p(c | context), Witten-Bell."""
        got = self.cache.get((context, c))
        if got is None:
            if len(self.cache) > STORE:
                self.cache.clear()
            p = 1 / 200
            for k in range(self.order + 1):
                ctx = context[len(context) - k :] if k else ""
                if t := self.totals.get(ctx):
                    p = (self.counts[ctx][c] + t[1] * p) / (t[0] + t[1])
            got = self.cache[context, c] = -math.log(p)
        return got


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Readings of each run of equal characters with their costs."""
    out = []
    i = 0
    while i < len(token):
        c = token[i]
        j = i
        while j < len(token) and token[j] == c:
            j += 1
        n = j - i
        if c.isalpha():
            out.append([(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, RUN)] if n == 2 else [(c, RUN), (c * 2, RUN)])
        else:
            options = [("", OMIT if c in LEET else 0.5)]
            for x in LEET.get(c, ""):
                options.append((x, SIGN))
                if n > 1:
                    options.append((x * 2, SIGN + (RUN if n > 2 else 0.0)))
            out.append(options)
        i = j
    return out


def parted(token: str) -> list[list[tuple[str, float]]]:
    """The lattice of a token in which a sign that is left out may part two words."""
    signs = [x for x, _ in itertools.groupby(token)]
    return [options if x.isalnum() else [*options, (" ", options[0][1])] for x, options in zip(signs, lattice(token), strict=True)]


def apart(run: str) -> list[list[tuple[str, float]]]:
    """The lattice of characters set apart, in which each letter but the first may start a word: a space before it."""
    out = []
    for options in lattice(run):
        both = [*options, *((f"{s[0]} {s[1]}", extra) for s, extra in options if len(s) == 2)]
        out.append([*both, *((" " + s, extra) for s, extra in both if s)])
    return out


def _cheapest(places: list[list[tuple[str, float]]], model: CharModel) -> str:
    """The cheapest reading: the best path to each context at each place. A space ends a word and starts another."""
    k = model.order
    start = "^" * k
    paths = {start: (0.0, None)}
    for options in places:
        new: dict[str, tuple[float, tuple | None]] = {}
        for ctx, (cost, text) in paths.items():
            for s, extra in options:
                total, at = cost + extra, ctx
                if s[:1] == " " and at == start:
                    continue
                for c in s:
                    total += model.cost(at, "$" if c == " " else c)
                    at = start if c == " " else (at + c)[-k:]
                if at not in new or total < new[at][0]:
                    new[at] = (total, (text, s) if s else text)
        paths = new
    text, out = paths[min(paths, key=lambda x: (paths[x][0] + model.cost(x, "$"), x))][1], []
    while text:
        text, s = text
        out.append(s)
    return "".join(reversed(out)).strip()


def decode(token: str, model: CharModel) -> str:
    """The cheapest reading of a token as one word."""
    return _cheapest(lattice(token), model)


def words_of(run: str, model: CharModel) -> list[str]:
    """The cheapest words of a run of characters set apart; each has its own start and end under the model."""
    return _cheapest(apart(run), model).split()


def _disguised(token: str) -> bool:
    return bool(_LETTERS.search(token) and _SIGN.search(token) or _BROKEN.search(token))


def _stripped(token: str) -> str:
    before = None
    while token != before:
        before, token = token, _TAIL.sub("", token)
    return _HEAD.sub("", token)


def heads(places: list[list[tuple[str, float]]], n: int = 3) -> set[str]:
    """The first n letters of every reading of a lattice."""
    got, short = set(), {""}
    for options in places:
        new = {x + s for x in short for s, _ in options}
        got.update(x[:n] for x in new if len(x) >= n)
        if not (short := {x for x in new if len(x) < n}):
            break
    return got | short


def starts(word: str) -> list[str]:
    """The word and its starts, which are marked."""
    return [word, *(word[:k] + "-" for k in range(3, min(8, len(word))))]


class Reader:
    """Features of texts: what their tokens and the restored tokens hit in the lexicon (all, if that is None). known: plain
    words, those of the model if there is one."""

    def __init__(self, model: CharModel | None, lexicon: dict[str, float] | None, known: frozenset[str] = frozenset()) -> None:
        self.model, self.lexicon = model, lexicon
        self.known = model.words if model else known
        self.heads = None if lexicon is None else {f[:3] for f in lexicon}
        self.halves: dict[str, dict[str, str]] = {}
        for w in lexicon or ():
            if len(w) >= HALVED and w.isalpha():
                for i in range(1, len(w)):
                    if not (w[:i] in self.known and w[i:] in self.known):
                        self.halves.setdefault(w[:i], {})[w[i:]] = w
        self.memory: dict[str, tuple[str, ...]] = {}
        self.held = 0

    def restored(self, token: str) -> str:
        x = _stripped(token)
        if self.model and x not in self.known and (_disguised(x) or _DOUBLED.search(x)) and (y := _cheapest(parted(x), self.model)):
            return y
        return x

    def spaced(self, run: str) -> list[str]:
        """The words of a run of characters set apart; without a model one word."""
        x = _stripped("".join(run.split()))
        return words_of(x, self.model) if self.model and _LETTERS.search(x) else [x]

    def _hits(self, token: str) -> tuple[str, ...]:
        """Features of a token. What is letters only, but for signs around it, has one word and one-word readings; these are
        searched if any of them starts like something in the lexicon."""
        x = token.rstrip(_AFTER).lstrip(_BEFORE)
        if x.isalpha():
            plain = not self.model or x in self.known or not _DOUBLED.search(x)
            if self.heads is not None and (x[:3] not in self.heads if plain else self.heads.isdisjoint(heads(lattice(x)) | {x[:3]})):
                return ()
            if plain:
                return tuple(f for f in starts(x) if self.lexicon is None or f in self.lexicon)
        words, read = set(_LETTERS.findall(token)), _LETTERS.findall(self.restored(token))
        whole = set() if _disguised(_stripped(token)) else set(read) - words
        found = dict.fromkeys(f for w in sorted(words.union(read)) for f in ([w] if w in whole else starts(w)))
        return tuple(f for f in found if self.lexicon is None or f in self.lexicon)

    def _learn(self, token: str) -> tuple[str, ...]:
        out = self._hits(token)
        if len(token) <= LONGEST:
            self.memory[token] = out
            self.held += len(token)
        return out

    def features(self, text: str | None) -> set[str]:
        text = (text or "").lower()
        order = text.split()
        tokens = set(order)
        if len(self.memory) > STORE or self.held > STORE_CHARS:
            self.memory.clear()
            self.held = 0
        got = set(map(self.memory.get, tokens))
        if None in got:
            got.discard(None)
            got.update(self._learn(t) for t in tokens if t not in self.memory)
        for m in _SPACED.finditer(text):
            for t in {"".join(m[0].split()), *self.spaced(m[0])}:
                got.add(self.memory[t] if t in self.memory else self._learn(t))
        for i in [i for i, t in enumerate(order[:-1]) if t in self.halves] if not self.halves.keys().isdisjoint(tokens) else ():
            if (end := _LETTERS.match(order[i + 1])) and (w := self.halves[order[i]].get(end[0])):
                got.add(self.memory[w] if w in self.memory else self._learn(w))
        hits = {f for x in got for f in x}
        if self.lexicon is not None:
            several = sum(1 for x in got if x)
            hits.update(f for n, f in SEVERAL if several >= n)
        return hits

    def _plain(self, token: str) -> str:
        x = token.lower()
        y = self.restored(x)
        return y if _disguised(_stripped(x)) or (y != _stripped(x) and self.lexicon and y in self.lexicon) else token

    def text(self, text: str | None) -> str | None:
        """The text with its disguised tokens restored; one of two equal letters goes if that gives a word of the lexicon."""
        if text is None:
            return None
        joined = _SPACED.sub(lambda m: " ".join(self.spaced(m[0].lower())) if _LETTERS.search(m[0]) else m[0], text)
        return re.sub(r"\S+", lambda m: self._plain(m[0]), joined)


def score_of(hits: set[str], weights: dict[str, float]) -> float:
    """The logistic model; the weight of "" is the constant."""
    z = weights.get("", -5.0) + sum(weights.get(f, 0.0) for f in hits)
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def fit(rows: DataFrame, names: list[str], penalty: float = 0.02) -> dict[str, float]:
    """Logistic regression in Spark over rows (hits, toxic): only the weights of `names` reach the driver, none of them
    below zero."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel
    from pyspark.ml.linalg import Matrices

    # Rows with the same hits and label count together.
    alike = written(rows.groupBy("hits", "toxic").agg(F.count("*").cast("double").alias("n")), "toxic-hits")
    n = alike.agg(F.sum("n")).first()[0]
    vectors = CountVectorizerModel.from_vocabulary(names, "hits", "x").setBinary(True).transform(alike)
    bounds = Matrices.dense(1, len(names), [0.0] * len(names))
    model = LogisticRegression(featuresCol="x", labelCol="toxic", weightCol="n", regParam=penalty / n, standardization=False, lowerBoundsOnCoefficients=bounds, maxIter=200).fit(vectors)
    drop(alike)
    return {"": max(-30.0, min(30.0, model.intercept)), **dict(zip(names, map(float, model.coefficients.toArray()), strict=True))}


def _key(column: pa.Array) -> np.ndarray:
    """A text's smallest hash of three words: mostly the same for near copies."""
    data, offsets = bytes_of(column)
    out = []
    for lo, hi in groups(offsets, 1 << 20):
        w = Words(data, offsets[lo : hi + 1], NOT_SPACE)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            out.append(int(runs(w.hash[a:b], min(3, b - a)).min()) if b > a else 0)
    return np.array(out, np.uint64).view(np.int64)


def likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids, and few others: by a bit for each id's hash. The filter's size is bounded, so
    that it can be broadcast whatever the number of ids; what it lets through in vain a join has to sift."""
    n, bits = ids.count(), 1 << 6
    while bits < min(MOST_BITS, ID_BITS * n):
        bits *= 2

    def hashed(df: DataFrame) -> DataFrame:
        return df.withColumn("_at", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(bits))).withColumn("_word", F.shiftright("_at", 6))

    words = hashed(ids.select("doc_id")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, int(_at & 63))")).alias("_bits"))
    return hashed(docs).join(F.broadcast(words), "_word").where("shiftright(_bits, int(_at & 63)) & 1 = 1").select(*docs.columns)


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of the lexicon's features and words for the character model, from all labelled rows of docs; of near copies with
    one label one row counts. A feature enters if chance would hardly tie it to toxic documents so closely (log-likelihood
    ratio against the number of features tried) and most of its documents are toxic."""
    prepare(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # Texts of other rows aren't shuffled, and those of labelled ones in the same way at any size.
    picked = likely(docs.where(F.col("text").isNotNull()).select("doc_id", "text"), known).join(known.hint("merge"), "doc_id")

    def keyed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_key(b.column(1))), b.column(1), b.column(2)], ["key", "text", "toxic"])

    rows = written(picked.mapInArrow(keyed, "key long, text string, toxic int").dropDuplicates(["key", "toxic"]), "toxic")
    totals = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)

    def counts(df: DataFrame, wanted: set[str] | None) -> DataFrame:
        def run(batches):
            reader, total = Reader(None, None), Counter()
            for b in batches:
                for t in b.column(0).to_pylist():
                    f = reader.features(t)
                    total.update(f if wanted is None else f & wanted)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["f", "n"])

        return df.select("text").mapInArrow(run, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))

    seen = {r.f: r.n for r in counts(rows.where("toxic = 1"), None).where("n >= 3").collect()}
    clean = {r.f: r.n for r in counts(rows.where("toxic = 0"), set(seen)).collect()} if n0 and seen else {}
    need = 2 * math.log(max(2, len(seen))) + 8
    found: list[tuple[float, str]] = []
    alone: list[str] = []
    for f, a in seen.items():
        b = clean.get(f, 0)
        expected = (a + b) * n1 / (n1 + n0)
        parts = ((a, expected), (b, a + b - expected), (n1 - a, n1 - expected), (n0 - b, n0 - (a + b - expected)))
        g = 2 * sum(o * math.log(o / e) for o, e in parts if o > 0 and e > 0)
        if a > b and a > expected and (g > need or not n0):
            found.append((g, f))
            if (a + 0.5) / (a + b + 1) >= SURE:
                alone.append(f)
    lexicon = {f: 1.0 for _, f in sorted(found, reverse=True)}
    known = frozenset(f for f in seen if not f.endswith("-"))

    def hits(batches):
        reader = Reader(None, lexicon, known)
        for b in batches:
            got = [sorted(reader.features(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.string())), b.column(1)], ["hits", "toxic"])

    names = [*sorted(lexicon), *(f for _, f in SEVERAL)]
    weights = fit(rows.select("text", "toxic").mapInArrow(hits, "hits array<string>, toxic int"), names) if lexicon else {}
    for f in alone:  # such a hit alone makes a text toxic with a probability of 0.6, however many others it mostly comes with
        if f in weights:
            weights[f] = max(weights[f], 0.4 - weights[""])
    words: dict[str, float] = {f: float(n) for f, n in seen.items() if not f.endswith("-")}
    for f in lexicon:
        if not f.endswith("-"):
            words[f] *= 20.0  # what is disguised is mostly what is not wanted
    return weights, words


def _reader(key: int, words: dict[str, float], lexicon: dict[str, float]) -> Reader:
    return resident(("toxicity", key), lambda: Reader(CharModel(words), {f: w for f, w in lexicon.items() if f and f[0] != "#"}))


def score(docs: DataFrame, learned: tuple[dict[str, float], dict[str, float]], threshold: float = 0.3, keep: bool = False, suffix: str = "") -> DataFrame:
    """doc_id, score, predicted and the lexicon's hits, or with keep all columns of docs and these three, named with
    suffix. Null and empty texts have no hits. Repeated rows stay; an empty table gives no rows."""
    spark = docs.sparkSession
    prepare(spark)
    names = [x + suffix for x in ("score", "predicted", "hits")]
    if keep and set(names) & set(docs.columns):
        raise ValueError(f"docs has {sorted(set(names) & set(docs.columns))}; give a suffix")
    cols = docs.columns if keep else ["doc_id", "text"]
    own = cols if keep else ["doc_id"]
    shared = spark.sparkContext.broadcast(learned)  # grows with the vocabulary of toxic texts, not with rows
    key = hash((tuple(sorted(learned[0].items())), tuple(sorted(learned[1].items()))))
    schema = docs.select(*own, F.lit(0.0).alias(names[0]), F.lit(0).alias(names[1]), F.array(F.lit("")).alias(names[2])).schema
    place = cols.index("text")

    def run(batches):
        lexicon, words = shared.value
        reader = _reader(key, words, lexicon)
        for b in batches:
            hits = [reader.features(t) for t in b.column(place).to_pylist()]
            s = np.array([score_of(h, lexicon) for h in hits], np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array([sorted(h) for h in hits], pa.list_(pa.string()))], [*own, *names])

    return docs.select(*cols).mapInArrow(run, schema)


def restore(docs: DataFrame, learned: tuple[dict[str, float], dict[str, float]]) -> DataFrame:
    """doc_id and the text with disguised tokens restored; null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches):
        reader = Reader(CharModel(shared.value[1]), shared.value[0])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([reader.text(t) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string")


def detect(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.3, keep: bool = False, suffix: str = "") -> DataFrame:
    """Learns from the labelled rows whose fold is not held_out and scores all rows."""
    return score(docs, learn(docs.where(fold("doc_id", folds) != held_out), labels), threshold, keep=keep, suffix=suffix)
