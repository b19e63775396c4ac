"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of a sample of its labelled texts. A text, lower-cased, with one space for
whatever is neither letter nor mark, is cut greedily from its start to its end into the longest phrases that occur in
the sample, across words; a byte that the sample lacks is a phrase of its own. Phrases times the logarithm of the
sample's length are the bits that the text costs in that language (the Ziv-Merhav estimate of cross entropy);
the cheapest language wins.

The automata are tables of next states by state and byte. Many texts are parsed side by side by array operations; every
LONGEST bytes of a long text are parsed on their own, which adds a phrase at most in each language.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import fold, prepare, resident
from lodestar.llm.wordhash import bytes_of, groups

#: How fast bits turn into certainty.
SHARPNESS = 0.25
#: Bytes that are parsed from their own start, bytes of texts side by side, and steps for which codes are laid out.
LONGEST, GROUP, STRETCH = 1 << 12, 1 << 23, 128
#: In a table's entries: the phrases that a step ends lie above the next state.
_SHIFT = 29
_STATE = (1 << _SHIFT) - 1


def plain(texts: pa.Array) -> pa.Array:
    """Lower case; a space for each run of other characters than letters and marks."""
    return pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")), r"[^\p{L}\p{M}]+", " ")


class SuffixAutomaton:
    """All substrings of a text. table[state * width + codes[byte]] is the next state times width and, above it, the
    phrases that end with this step: one where the byte can't follow, one more where it doesn't occur at all.
    Code 0 is no byte and leaves the state as it is, code 1 is a byte that the text lacks."""

    def __init__(self, text: bytes) -> None:
        nxt: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        seen = sorted(set(text))
        self.width = len(seen) + 2
        if len(nxt) * self.width > _STATE:
            raise ValueError("the sample is too long for its table")
        self.codes = np.ones(256, np.uint8 if self.width < 257 else np.uint16)
        self.codes[seen] = np.arange(2, self.width)
        start = np.zeros(self.width, np.int64)
        for c, to in nxt[0].items():
            start[self.codes[c]] = to * self.width
        missing = np.where(np.arange(self.width) == 1, 1, 0) << _SHIFT
        table = np.empty((len(nxt), self.width), np.int32)
        table[:] = start + missing + (1 << _SHIFT)
        table[0] = start + missing
        at = np.repeat(np.arange(len(nxt)), [len(x) for x in nxt])
        table[at, self.codes[[c for x in nxt for c in x]]] = np.fromiter((to for x in nxt for to in x.values()), np.int64, len(at)) * self.width
        table[:, 0] = np.arange(len(nxt)) * self.width
        self.table = table.ravel()


def parse(automata: list[SuffixAutomaton], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Phrases of each text (rows) in each automaton (columns). Every LONGEST bytes of a text begin anew."""
    pieces = np.maximum(1, -(-np.diff(offsets) // LONGEST))
    text = np.repeat(np.arange(len(pieces)), pieces)
    start = offsets[text] + LONGEST * (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    size = np.minimum(LONGEST, offsets[text + 1] - start)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    state = np.zeros((len(automata), len(size)), np.int64)
    total = np.zeros((len(automata), len(size)), np.int64)
    for at in range(0, int(size.max(initial=0)), STRETCH):
        k = int(np.searchsorted(-size, -at, "left"))  # pieces longer than at
        place = np.arange(at, at + STRETCH)
        codes = data[np.minimum(start[:k, None] + place, len(data) - 1)]
        inside = place < size[:k, None]
        for i, a in enumerate(automata):
            s, e, n = state[i, :k], np.empty(k, np.int32), np.zeros(k, np.int32)
            for c in np.where(inside, a.codes[codes], 0).T.astype(np.int64, order="C"):
                c += s
                np.take(a.table, c, out=e, mode="clip")  # always inside; this mode needs no buffer
                np.bitwise_and(e, _STATE, out=s)
                e >>= _SHIFT
                n += e
            total[i, :k] += n
    out = np.zeros((len(pieces), len(automata)), np.int64)
    np.add.at(out, text[order], (total + (state != 0)).T)
    return out


class Model:
    """samples: for each language a text and its number of documents."""

    def __init__(self, samples: dict[str, tuple[str, int]]) -> None:
        self.languages = sorted(samples, key=lambda k: (-samples[k][1], k))  # ties go to the more frequent one
        texts = [plain(pa.array([samples[k][0]]))[0].as_py().encode() for k in self.languages]
        self.automata = [SuffixAutomaton(x) for x in texts]
        self.bits = np.array([math.log2(len(x) + 2) for x in texts])

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, certainties, and bits for each byte of the plain text."""
        langs, score, level = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        _, raw = bytes_of(texts)
        for lo, hi in groups(raw, GROUP) if self.languages else ():
            some = plain(texts.slice(lo, hi - lo))
            data, offsets = bytes_of(some)
            cost = parse(self.automata, data, offsets) * self.bits
            for j in np.flatnonzero(np.asarray(pc.match_substring_regex(some, r"\p{L}"))).tolist():
                best = int(np.argmin(cost[j]))
                langs[lo + j] = self.languages[best]
                score[lo + j] = 1 / np.exp2(np.maximum(-60.0, (cost[j, best] - cost[j]) * SHARPNESS)).sum()
                level[lo + j] = cost[j, best] / (offsets[j + 1] - offsets[j])
        return langs, score, level


def learn(docs: DataFrame, rows: int = 200, chars: int = 60_000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, tuple[str, int]]:
    """For each language a sample of its labelled texts and the number of its documents. Of about `rows` rows, taken by the
    hash of their id, different texts of at most a quarter of `chars` characters are joined, by that hash, while they
    have `chars` characters together; a language that has only longer ones gives the start of its shortest. Rows
    without language, text or letters teach nothing. Only the samples reach the driver."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit("sample")).alias("u"))
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}  # as many rows as languages
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, rows / n))])
    picked = known.where(F.pmod("u", F.lit(1 << 20)) / (1 << 20) < share[F.col("lang")]).withColumns({"h": F.xxhash64("text"), "n": F.length("text").cast("long")})
    once = picked.groupBy("lang", "h", "n").agg(F.min("u").alias("u"), F.min("text").alias("text"))
    first = Window.partitionBy("lang").orderBy((F.col("n") > chars // 4).cast("int"), F.when(F.col("n") > chars // 4, F.col("n")), "u", "h")
    placed = once.withColumns({"upto": F.sum("n").over(first.rowsBetween(Window.unboundedPreceding, 0)), "k": F.row_number().over(first)})
    found: dict[str, list[tuple[int, str]]] = {}
    for r in placed.where((F.col("k") == 1) | (F.col("upto") <= chars) & (F.col("n") <= chars // 4)).select("lang", "k", F.substring("text", 1, chars).alias("text")).collect():
        found.setdefault(r.lang, []).append((r.k, r.text))
    return {k: (" ".join(x for _, x in sorted(of)), counts[k]) for k, of in found.items()}


def predict(docs: DataFrame, samples: dict[str, tuple[str, int]], keep: bool = False, id_col: str = "doc_id", text_col: str = "text", suffix: str = "") -> DataFrame:
    """doc_id, lang_pred, score and level (bits for each byte in that language), or with keep all columns of docs and
    these three, named with suffix. A null text, or one without letters, is `und` with 0 and 0, as is every text if nothing
    was learned. Equally cheap languages: that with more documents, then the first by name. Repeated rows stay."""
    prepare(docs.sparkSession)
    names = ["lang_pred" + suffix, "score" + suffix, "level" + suffix]
    if keep and set(names) & set(docs.columns):
        raise ValueError(f"docs has {sorted(set(names) & set(docs.columns))}; give a suffix")
    cols = docs.columns if keep else [id_col, text_col]
    place, key = cols.index(text_col), hash(tuple(sorted((k, v[0]) for k, v in samples.items())))
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    own = cols if keep else cols[:1]
    out = docs.select(*cols).withColumns({names[0]: F.lit("").cast("string"), names[1]: F.lit(0.0), names[2]: F.lit(0.0)}).select(*own, *names)

    def run(batches):
        m = resident(("languages", key), lambda: Model(shared.value))
        for b in batches:
            langs, score, level = m.predict(b.column(place))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], pa.array(langs, pa.string()), pa.array(score), pa.array(level)], [*own, *names])

    return docs.select(*cols).mapInArrow(run, out.schema)


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2, keep: bool = False, suffix: str = "") -> DataFrame:
    """Learns from the rows whose fold is not held_out (rows without id: none) and predicts all rows."""
    samples = learn(docs.where(F.coalesce(fold("doc_id", folds), F.lit(0)) != held_out))
    return predict(docs, samples, keep, suffix=suffix)
