"""Set-similarity join on word shingles with PartEnum signatures.

Two sets of sizes m and n with Jaccard similarity of at least P percent differ in at most
k = (100 - P) / (100 + P) * (m + n) elements. Bands of sizes are so wide that linked sets lie in one band or in two
neighbours; each set signs for its own band and for the next. For a band whose pairs differ in at most k elements the
hash domain is partitioned into n1 = k // 2 + 1 parts, so that in one of them two linked sets differ in one element at
most. That part is partitioned again into three, and each subset of two of these is enumerated: one of the subsets
holds no difference, and the hash of its elements is a signature that both sets have.

An empty subset says little. Large bands have t parts more, so that in t + 1 parts at least linked sets differ in
one element at most: a set with at most t parts that have an empty subset need not sign for empty ones, and only one with
more does. In small bands the signatures of a second, independent partition stand in the place of an empty subset.

Equal texts, told by 128 bits of hash, are one class and sign once. Classes that share a signature form buckets. Buckets are compared in
blocks by odd sketches: bit vectors in which every element flips one bit, so that two sets differ in at least as many
elements as bits differ. What a sketch can't exclude is compared exactly; links then go to components. Of each
bucket only the pairs of a spanning forest are compared at first, and where such a pair fails, all pairs of sets that
are still in different components. No link between different texts is lost, and no bucket's pairs are all emitted.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import prepare, reclaim, release, written
from lodestar.llm.components import components
from lodestar.llm.wordhash import NOT_SPACE, Words, bytes_of, groups, mix, runs

#: Classes of a bucket that are compared at once, and bytes of texts.
BLOCK, GROUP = 256, 1 << 20
#: Subparts of a part, of which all but one are a subset. Bands of at most so many parts have no spare parts, but up to
#: so many partitions.
SUB, SMALL, _DEEPEST = 3, 8, 3


class Bands:
    """Sizes from 1 on, cut so that size * percent / 100 of a band's last size lies below the band's start or in it."""

    def __init__(self, percent: int) -> None:
        self.percent, starts = percent, [1]
        while starts[-1] < 1 << 40:
            starts.append(starts[-1] * 100 // percent + 1)
        self.starts = np.array(starts)
        self.known: dict[int, tuple[int, int]] = {}

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.starts, n, "right")) - 1

    def parts(self, band: int) -> tuple[int, int, int]:
        """Parts, subparts of each, and t. Two linked sets of at most the band's largest size differ in one element at most
        in t + 1 parts at least (in none where there is one subpart); t is what a set of the band before rarely exceeds
        in parts with an empty subset."""
        if band not in self.known:
            differ = (100 - self.percent) * 2 * (int(self.starts[band + 1]) - 1) // (100 + self.percent)
            least, smallest, t = differ // 2 + 1, int(self.starts[max(0, band - 1)]), 0
            for _ in range(2 if least > SMALL else 0):
                weak = (least + t) * SUB * math.exp(-smallest / (SUB * (least + t))) ** (SUB - 1)
                t = math.ceil(weak + (2 if weak < 5 else 4) * math.sqrt(weak) + 0.5)
            self.known[band] = (least + t, SUB if differ else 1, t)
        return self.known[band]


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    """s: the set's hashes, sorted and distinct."""
    out: list[np.ndarray] = []

    def sign(band: int, family: int, tag: np.uint64) -> None:
        parts, sub, spare = bands.parts(band)
        cells = parts * sub
        at = (mix(s ^ mix(np.array([family + 1], np.uint64))) % np.uint64(cells)).astype(np.int64)
        total = np.zeros(cells, np.uint64)
        np.add.at(total, at, mix(s + np.uint64(family + 77)))
        total, n = total.reshape(parts, sub), np.bincount(at, minlength=cells).reshape(parts, sub)
        if sub > 1:  # each subset leaves one subpart out
            total, n = total.sum(axis=1, keepdims=True) - total, n.sum(axis=1, keepdims=True) - n
        place = np.arange(cells, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        signs, empty = mix(total.ravel() + mix(place + tag)), n.ravel() == 0
        out.append(signs[~empty])
        if parts <= SMALL and family + 1 < _DEEPEST:
            for p in np.flatnonzero(empty).tolist():
                sign(band, family + 1, mix(place[p : p + 1] + tag + np.uint64(1))[0])
        elif int((n == 0).any(axis=1).sum()) > spare:
            out.append(signs[empty])

    own = bands.of(len(s))
    for band in (own, own + 1):
        sign(band, 0, mix(np.array([band + 1], np.uint64))[0])
    return np.unique(np.concatenate(out))


def sketch(s: np.ndarray) -> bytes:
    """Parities of elements by hash; a power of two of bits, at least 512 and one for each element."""
    bits = 512
    while bits < len(s):
        bits *= 2
    odd = np.bincount((mix(s + np.uint64(5)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sets_of(column: pa.Array, k: int):
    """The sorted distinct hashes of each text's runs of k words; of all its words if it has fewer."""
    data, offsets = bytes_of(column)
    for lo, hi in groups(offsets, GROUP):
        w = Words(data, offsets[lo : hi + 1], NOT_SPACE)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            n = min(k, b - a)
            yield np.unique(runs(w.hash[a:b], n, k - n)) if n else np.zeros(0, np.uint64)


def _signed(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """texts: h, h2, null_id, doc_id, text. Those without words are left out."""

    def run(batches):
        release()
        bands = Bands(percent)
        for b in batches:
            sets = list(sets_of(b.column(4), k))
            at = [i for i, s in enumerate(sets) if len(s)]
            own = [c.take(pa.array(at, pa.int64())) for c in b.columns[:4]]
            sets = [sets[i] for i in at]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array([len(s) for s in sets], pa.int64()), pa.array([signatures(s, bands).view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([sketch(s) for s in sets], pa.binary())],
                ["h", "h2", "null_id", "doc_id", "n", "signs", "sketch"],
            )

    return texts.mapInArrow(run, "h long, h2 long, null_id boolean, doc_id long, n long, signs array<long>, sketch binary")


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one length: halves of the longer ones are added, which keeps the bound."""
    width = min(map(len, sketches)) // 8
    rows = []
    for x in sketches:
        v = np.frombuffer(x, "<u8")
        while len(v) > width:
            v = v[: len(v) // 2] ^ v[len(v) // 2 :]
        rows.append(v)
    return np.stack(rows)


def _possible(bits: np.ndarray, sizes: np.ndarray, comps: np.ndarray, i: int, to: np.ndarray, percent: int) -> np.ndarray:
    """Those of `to` that may be linked with i and lie in other components."""
    to = to[comps[to] != comps[i]]
    differ = np.bitwise_count(bits[to] ^ bits[i]).sum(axis=1, dtype=np.int64)
    return to[differ * (100 + percent) <= (100 - percent) * (sizes[to] + sizes[i])]


class _Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _blocks(batches, width: int):
    """Groups of rows with the same first three columns; rows come sorted by them. width: the other columns."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, of in groupby(rows, lambda r: r[:3]):
        yield key, [list(c) for c in zip(*(r[3 : 3 + width] for r in of), strict=True)]


def _sides(key: tuple, side: list[int]) -> list[tuple[int, np.ndarray]]:
    """Each row with the rows that it is compared with: all later ones, or those of the other block."""
    s = np.array(side)
    if key[1] == key[2]:
        return [(i, np.arange(i + 1, len(s))) for i in range(len(s) - 1)]
    other = np.flatnonzero(s == key[2])
    return [(int(i), other) for i in np.flatnonzero(s == key[1])]


def _forest(percent: int):
    """Pairs of a spanning forest of all pairs that the sketches allow, in each block."""

    def run(batches):
        release()
        for key, (side, rep, comp, n, sk) in _blocks(batches, 5):
            o = np.argsort(rep)
            side, rep, sk = [side[i] for i in o], [rep[i] for i in o], [sk[i] for i in o]
            bits, sizes, comps = _folded(sk), np.array(n)[o], np.array(comp)[o]
            u, pairs = _Union(len(rep)), []
            for i, to in _sides(key, side):
                for j in _possible(bits, sizes, comps, i, to, percent).tolist():
                    if u.join(i, j):
                        pairs.append((rep[i], rep[j]))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.int64()), pa.array([max(p) for p in pairs], pa.int64())], ["a", "b"])

    return run


def _members(percent: int):
    """Rows of a block that the sketches allow a link with another component."""

    def run(batches):
        release()
        for key, (side, rep, comp, n, sk) in _blocks(batches, 5):
            bits, sizes, comps = _folded(sk), np.array(n), np.array(comp)
            found = np.zeros(len(rep), bool)
            for i, to in _sides(key, side):
                hit = _possible(bits, sizes, comps, i, to, percent)
                found[hit] = True
                found[i] |= len(hit) > 0
            at = np.flatnonzero(found).tolist()
            if at:
                yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(at), pa.int64()) for x in key), *(pa.array([v[i] for i in at], pa.int64()) for v in (side, rep, comp))], ["sign", "lo", "hi", "side", "rep", "comp"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _exact(percent: int):
    """Links of a block between components, as a spanning forest."""

    def run(batches):
        release()
        for key, (side, rep, comp, raw) in _blocks(batches, 4):
            sets = [np.frombuffer(x, "<u8") for x in raw]
            ids = {c: i for i, c in enumerate(dict.fromkeys(comp))}
            u, pairs = _Union(len(ids)), []
            for i, to in _sides(key, side):
                for j in to.tolist():
                    a, b = ids[comp[i]], ids[comp[j]]
                    if u.find(a) != u.find(b) and _linked(sets[i], sets[j], percent):
                        u.join(a, b)
                        pairs.append((rep[i], rep[j]))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["a", "b"])

    return run


def _in_blocks(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of buckets (sign, m, rep, comp) once for each pair of blocks that they are in, sorted."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("long")
    b = buckets.withColumn("side", F.pmod(F.xxhash64("rep"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    b = b.select("sign", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "rep", "comp")
    return b.join(classes.select("rep", "n", "sketch"), "rep").select("sign", "lo", "hi", "side", "rep", "comp", "n", "sketch").repartition("sign", "lo", "hi").sortWithinPartitions("sign", "lo", "hi")


def _buckets(classes: DataFrame, i: int, rounds: int) -> DataFrame:
    """Classes with a signature that others have too, for a share of all signatures. sign, m, rep, comp. Near copies share
    most of their signatures, so of signatures that the very same classes have, told by their number and 128 bits
    of hash, one stands for all."""
    own = F.filter("signs", lambda x: F.pmod(x, F.lit(rounds)) == i) if rounds > 1 else F.col("signs")
    signs = classes.select(F.explode(own).alias("sign"), "rep")
    shared = signs.groupBy("sign").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit("second"), "rep")).alias("y")).where("m > 1")
    one = shared.groupBy("m", "x", "y").agg(F.min("sign").alias("sign")).select("sign", "m")
    out = written(signs.join(one, "sign").select("sign", "m", "rep", F.col("rep").alias("comp")), "buckets")
    reclaim(classes.sparkSession)
    return out


def similar(docs: DataFrame, k: int = 5, percent: int = 80, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, n_shingles, component, least_id and least_h for each row, h being the xxhash64 of its text: the texts' sets of
    k-word shingles (fewer words: all of them as one) are linked when their Jaccard similarity is at least percent.
    component is the same in all linked rows; least_id and least_h are the smallest id of the component and the
    h of its text, a null id coming last. Null texts and those without words have 0 shingles, no component and
    their own id and h. Ids may name several texts and texts have several ids; repeated rows stay; other columns are not read.
    Signatures are dealt out in `rounds` parts, one after the other, which bounds the disk that they need."""
    spark = docs.sparkSession
    prepare(spark)
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit("second"), text).alias("h2"), text.alias("text"))
    # Copies meet before they are shuffled; of each different text one row goes on, and signs are never shuffled whole.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id")).alias("first")
    once = texts.where(F.col("text").isNotNull()).groupBy("h", "h2").agg(first, F.first("text").alias("text"))
    signed = _signed(once.select("h", "h2", "first.null_id", "first.doc_id", "text"), k, percent)
    signed = signed.select("h", "h2", F.struct("null_id", "doc_id", "h").alias("first"), "n", "signs", "sketch")
    classes = written(signed.withColumn("rep", F.monotonically_increasing_id()), "classes")  # a written table keeps these numbers
    reclaim(spark)
    buckets = reduce(DataFrame.union, [_buckets(classes, i, rounds) for i in range(rounds)])
    pairs = written(_in_blocks(buckets, classes).mapInArrow(_forest(percent), "a long, b long").distinct(), "pairs")

    needed = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    wanted = classes.select("rep", F.col("first.doc_id").alias("doc_id"), "h", "h2").join(needed, "rep", "left_semi")

    def as_sets(batches):
        release()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets_of(b.column(1), k)], pa.binary())], ["rep", "set"])

    of = (texts["h"] == wanted["h"]) & (texts["h2"] == wanted["h2"]) & texts["doc_id"].eqNullSafe(wanted["doc_id"])
    sets = texts.join(wanted, of).select("rep", "text").mapInArrow(as_sets, "rep long, set binary")
    sets = written(sets.dropDuplicates(["rep"]), "sets")

    def compare(batches):
        release()
        for b in batches:
            ok = [_linked(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), percent) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    a, b = sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), sets.select(F.col("rep").alias("b"), F.col("set").alias("y"))
    links = written(pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "first")

    reclaim(spark)
    found = written(components(links), "components")
    at = buckets.drop("comp").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("sign", "m", "rep", F.coalesce("component", "rep").alias("comp"))
    open_ = at.groupBy("sign").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("sign")
    near = _in_blocks(at.join(open_, "sign"), classes).mapInArrow(_members(percent), "sign long, lo long, hi long, side long, rep long, comp long")
    rest = written(near, "rest").join(sets, "rep").select("sign", "lo", "hi", "side", "rep", "comp", "set").repartition("sign", "lo", "hi").sortWithinPartitions("sign", "lo", "hi")
    more = written(rest.mapInArrow(_exact(percent), "a long, b long"), "second")
    if not more.isEmpty():
        found = written(components(links.union(more)), "components")
    label = classes.select("h", "h2", "n", "rep", "first").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("h", "h2", "n", F.coalesce("component", "rep").alias("component"), "first")
    least = label.groupBy("component").agg(F.min("first").alias("first"))
    label = label.drop("first").join(least, "component")
    own = F.col("component").isNull()
    return (
        texts.drop("text")
        .join(label, ["h", "h2"], "left")
        .select("doc_id", "h", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), "component", F.when(own, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("least_id"), F.when(own, F.col("h")).otherwise(F.col("first.h")).alias("least_h"))
    )


def similarity_components(docs: DataFrame, k: int = 5, percent: int = 80, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest id among the linked rows, for each row of similar(). It is null where
    no linked row has an id. Repeated rows are linked, as are equal texts."""
    return similar(docs, k, percent, rounds, id_col, text_col).select("doc_id", "n_shingles", F.col("least_id").alias("component_id"))


def without_copies(docs: DataFrame, k: int = 5, percent: int = 80, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which one of each group of linked ones stays: that with the smallest id, of these that whose
    text has the smallest hash, and of rows that are alike in both one. Rows without words stay, all of them. Rows
    are told by id and text."""
    found = similar(docs, k, percent, rounds, id_col, text_col).where("component is not null")
    rows = found.groupBy(F.col("doc_id").alias("id__"), F.col("h").alias("h__")).agg(F.count("*").alias("many__"), F.first("least_id").alias("id2__"), F.first("least_h").alias("h2__"))
    stays = F.col("id__").eqNullSafe(F.col("id2__")) & (F.col("h__") == F.col("h2__"))
    odd = rows.select("id__", "h__", stays.alias("stays__"), "many__").where("not stays__ or many__ > 1")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("id__")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("h__"))
    once = docs.join(odd, same, "left_anti").select(*docs.columns)
    again = docs.join(odd.where("stays__"), same).dropDuplicates(["id__", "h__"]).select(*docs.columns)
    return once.union(again)
