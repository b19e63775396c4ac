"""Samplers: star, path and shape queries from a graph, as rows of query records.

A pass makes one candidate for each start; all choices are md5 uniforms of (seed, pass, entity, place), so a pass can be
repeated and another pass differs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions.hashing import order_key, uniform
from lodestar.operators.graph import capped, dense_choice, first_paths, random_walks, simple_paths
from lodestar.operators.ranges import kept, places
from lodestar.plans.cycles import is_triangle, triangle_matches
from lodestar.plans.shapes import BOUND, PROB, Edge, nodes, plan
from lodestar.plans.walks import predicate_tuples


def iri(c: Column) -> Column:
    return F.concat(F.lit("<"), c, F.lit(">"))


def rendered(o: str, kind: str = "o_is_iri") -> Column:
    return F.when(F.col(kind), iri(F.col(o))).otherwise(F.col(o))


def query_text(triples: Column, graph: str | None = None) -> Column:
    source = f"SELECT * FROM <{graph}> WHERE {{ " if graph else "SELECT * WHERE { "
    return F.concat(F.lit(source), F.array_join(F.transform(triples, lambda t: F.array_join(t, " ")), " . "), F.lit(" }"))


def star_samples(raw: DataFrame, n: int, seed, pass_no: int = 0) -> DataFrame:
    """n triples, without replacement, of each subject that has as many: slot 0 to n - 1. Repeated triples are
    separate ones. raw: s, p, o, o_is_iri."""
    twin = W.partitionBy("s", "p", "o").orderBy("o_is_iri")
    key = order_key(seed, pass_no, *[F.col(c) for c in ("s", "p", "o", "d")])
    w = W.partitionBy("s")
    d = raw.repartition("s").withColumn("d", F.row_number().over(twin))  # all windows are within subjects
    d = d.withColumn("slot", F.row_number().over(w.orderBy(key)) - 1).withColumn("star_size", F.count("*").over(w))
    return d.where((F.col("star_size") >= n) & (F.col("slot") < n)).select("s", "p", "o", "o_is_iri", "slot", F.col("star_size").cast("bigint").alias("star_size"))


def star_queries(raw: DataFrame, n: int, seed=0, pass_no: int = 0, min_objects: int = 0, max_objects: int = 0, p_predicate: float = 1.0, graph: str | None = None) -> DataFrame:
    """A star query of n patterns for each suitable subject: between min_objects and max_objects objects are bound, and
    each predicate with probability p_predicate."""
    lo, hi = sorted((max(0, min(min_objects, n)), max(0, min(max_objects, n))))
    s, slot = F.col("s"), F.col("slot")
    k = F.lit(lo) + F.floor(uniform(seed, pass_no, s, "k") * (hi - lo + 1))
    place = F.row_number().over(W.partitionBy("s").orderBy(order_key(seed, pass_no, s, "o", slot)))
    d = star_samples(raw, n, seed, pass_no).withColumn("k", k).withColumn("bound", place <= F.col("k"))
    d = d.withColumn("pb", uniform(seed, pass_no, s, "p", slot) < p_predicate)
    row = F.struct(
        "slot",
        F.array(F.lit("?s"), F.when(F.col("pb"), iri(F.col("p"))).otherwise(F.concat(F.lit("?p"), slot.cast("string"))), F.when(F.col("bound"), rendered("o")).otherwise(F.concat(F.lit("?o"), slot.cast("string")))).alias("t"),
        "p",
        rendered("o").alias("o"),
        "bound",
        "pb",
    )
    g = d.groupBy(F.col("s").alias("source_subject"), "star_size", F.col("k").cast("bigint").alias("n_objects_instantiated")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    pick = lambda test, get: F.transform(F.filter("r", test), get)
    triples = F.transform("r", lambda x: x["t"])
    parts = F.sort_array(F.transform("r", lambda x: F.concat(x["p"], F.lit("="), F.when(x["bound"], x["o"]).otherwise("?"))))
    return g.select(
        query_text(triples, graph).alias("query"),
        triples.alias("triples"),
        pick(lambda x: x["pb"], lambda x: x["p"]).alias("x"),
        F.lit(-1).cast("bigint").alias("y"),
        "source_subject",
        "star_size",
        F.md5(F.array_join(parts, "|")).alias("query_hash"),
        F.transform("r", lambda x: x["p"]).alias("predicates_used"),
        pick(lambda x: x["bound"], lambda x: x["o"]).alias("instantiated_objects"),
        pick(lambda x: x["bound"], lambda x: x["slot"].cast("bigint")).alias("object_instantiation_pattern"),
        "n_objects_instantiated",
    )


def sampled_paths(edges: DataFrame, k: int, seed=0, pass_no: int = 0, starts: int | None = None, method: str = "dfs", attempts: int = 100, rounds: int = 20, name: Callable[[Column], Column] | None = None) -> DataFrame:
    """Simple paths of k edges: start, nodes, preds. dfs and bfs give one for each start that has one, the first by md5
    at each hop; starts: of only so many starts, chosen first, before any join. Both orders of search come to the same path,
    so they differ in their md5 only. random_walk (and random_walk_optimized) draws a start with replacement for each of
    `attempts` and walks without going back; an attempt whose walks end early draws again, in up to `rounds`
    rounds of more and more walks. start is the node, or the attempt's number for a walk. name: for dfs and bfs, the term of a node
    that edges have as a number."""
    if method not in ("random_walk", "random_walk_optimized", "dfs", "bfs"):
        raise ValueError(f"unknown method {method!r}")
    subjects, tag = edges.select("s").distinct(), f"{seed}|{pass_no}|{method}"
    if method in ("dfs", "bfs"):
        if starts is not None:
            subjects = subjects.orderBy(order_key(seed, pass_no, "start", name(F.col("s")) if name else F.col("s")), "s").limit(starts)
        starts_of = subjects.select(F.col("s").alias("walk"), "s")
        if name is None:
            return first_paths(edges, k, starts_of, tag).withColumnRenamed("walk", "start")
        return first_paths(edges, k, starts_of, tag, name).select(name(F.col("walk")).alias("start"), F.transform("nodes", name).alias("nodes"), "preds")
    dense = places(subjects, "at", F.col("s")).withColumn("at", F.col("at") - 1)
    spark = edges.sparkSession
    missing, found, tries = list(range(attempts)), [], 1
    for n in range(rounds):
        draws = spark.createDataFrame([(i, t) for i in missing for t in range(tries)], "attempt long, try int").select("attempt", "try", F.concat_ws(".", "attempt", F.lit(n), "try").alias("walk"))
        chosen = dense_choice(dense, draws.withColumn("u", uniform(tag, "walk", F.col("walk"))), "at").select("walk", "attempt", "try", "s")
        walked = random_walks(edges, k, chosen, tag).join(chosen.select("walk", "attempt", "try"), "walk")
        one = walked.groupBy("attempt").agg(F.min(F.struct("try", "nodes", "preds")).alias("b")).select(F.col("attempt").cast("string").alias("start"), "b.nodes", "b.preds")
        got = one.collect()  # `attempts` rows at most
        found += [tuple(r) for r in got]
        missing = sorted(set(missing) - {int(r.start) for r in got})
        if not missing:
            break
        tries = min(64, 4 * tries)
    return spark.createDataFrame(found, "start string, nodes array<string>, preds array<string>")


def path_queries(paths: DataFrame, seed=0, pass_no: int = 0, p_edge: float = 1.0, p_start_end: float = 0.3) -> DataFrame:
    """Records of paths: the ends are bound with probability p_start_end, predicates with p_edge, inner nodes never."""
    start = F.col("start")
    n = F.size("preds")
    at = lambda c, i: F.get(c, i)
    text = lambda name, i: F.concat(F.lit(name), i.cast("string"))
    first, last = uniform(seed, pass_no, start, "s") < p_start_end, uniform(seed, pass_no, start, "e") < p_start_end
    bound = lambda i: uniform(seed, pass_no, start, "p", i) < p_edge
    row = F.transform(
        "preds",
        lambda p, i: F.struct(
            F.array(
                F.when((i == 0) & first, iri(at("nodes", i))).otherwise(text("?o", i)),
                F.when(bound(i), iri(p)).otherwise(text("?p", i + 1)),
                F.when((i == n - 1) & last, iri(at("nodes", i + 1))).otherwise(text("?o", i + 1)),
            ).alias("t"),
            F.filter(F.array(F.when((i == 0) & first, at("nodes", i)), F.when((i == n - 1) & last, at("nodes", i + 1)), F.when(bound(i), p)), lambda v: v.isNotNull()).alias("x"),
        ),
    )
    r = paths.select("start", row.alias("r"))
    triples = F.transform("r", lambda v: v["t"])
    return r.select(F.flatten(F.transform("r", lambda v: v["x"])).alias("x"), F.lit(-1).cast("bigint").alias("y"), query_text(triples).alias("query"), triples.alias("triples"), "start")


def matches(edges: DataFrame, shape: list[Edge], injective: bool = True, cap: int | None = 50, seed=0, roots: DataFrame | None = None) -> DataFrame:
    """All matches of a shape: n_<node> and e_<number>. Edges are joined in the order of plan(). cap bounds the edges of a
    known node that are tried at each step, before used nodes are ruled out; None tries all, a triangle by its neighbour
    arrays."""
    root, order = plan(shape)
    if cap is None and injective and is_triangle(shape):
        return triangle_matches(edges, shape, roots, root)
    df = roots if roots is not None else edges.select("s").distinct()
    df = df.select(F.col("s").alias(f"n_{root}"))
    known = [root]
    for i in order:
        e = shape[i]
        s, o = f"n_{e.subject}", f"n_{e.object}"
        if e.subject in known and e.object in known:
            df = df.join(edges.select(F.col("s").alias(s), F.col("p").alias(f"e_{i}"), F.col("o").alias(o)), list(dict.fromkeys([s, o]))) if s != o else df.join(edges.where("s = o").select(F.col("s").alias(s), F.col("p").alias(f"e_{i}")), s)
            continue
        forward = e.subject in known
        old, new = (s, o) if forward else (o, s)
        some = capped(edges, "s" if forward else "o", cap, f"{seed}|{i}") if cap else edges
        df = df.join(some.select(F.col("s").alias(s), F.col("p").alias(f"e_{i}"), F.col("o").alias(o)), old)
        if injective:
            for k in known:
                df = df.where(F.col(new) != F.col(f"n_{k}"))
        known.append(e.object if forward else e.subject)
    return df.select(*[f"n_{x}" for x in nodes(shape)], *[f"e_{i}" for i in range(len(shape))])


def _keyed(edges: DataFrame, shape: list[Edge], cap: int | None, tag: str, roots: DataFrame) -> DataFrame:
    """matches() by different nodes with k_<number>, each edge's md5 in its step; closing edges have no cap."""
    found = matches(edges, shape, True, cap, tag, roots)
    return found.withColumns({f"k_{i}": order_key(f"{tag}|{i}", F.col(f"n_{e.subject}"), F.col(f"e_{i}"), F.col(f"n_{e.object}")) for i, e in enumerate(shape)})


def fruitful(edges: DataFrame, shape: list[Edge]) -> DataFrame:
    """s of the nodes that can be the shape's root, as far as its edges without those that close a cycle tell: from the leaves to
    the root, each node must have an edge to a node that can be its neighbour."""
    root, order = plan(shape)
    known, steps = {root}, []
    for i in order:
        e = shape[i]
        if e.subject in known and e.object in known:
            continue
        forward = e.subject in known
        steps.append((e.subject, e.object, True) if forward else (e.object, e.subject, False))
        known |= {e.subject, e.object}
    may: dict[str, DataFrame] = {}
    for old, new, forward in reversed(steps):
        near, far = ("s", "o") if forward else ("o", "s")
        some = edges.select(F.col(near).alias("v"), F.col(far).alias("far"))
        if new in may:
            some = some.join(may[new].withColumnRenamed("v", "far"), "far", "left_semi")
        some = some.select("v").distinct()
        may[old] = some if old not in may else may[old].join(some, "v", "left_semi")
    return may[root].withColumnRenamed("v", "s")


def first_matches(edges: DataFrame, shape: list[Edge], seed=0, pass_no: int = 0, widths: tuple[int, ...] = (4,), roots: DataFrame | None = None) -> DataFrame:
    """One match of each root that has any, by different nodes: n_<node> and e_<number>. At each step a node's edges come in
    an order by md5. Roots are searched in rounds with the first widths[0] edges of each node, then widths[1], and at last with
    all; a root that has a match stops there, and its first one by the steps' orders is taken. Only roots that are
    still open go on, so hubs' matches aren't all made, and the last round leaves out no root that has a match."""
    root, order = plan(shape)
    tag, n_root = f"{seed}|{pass_no}", f"n_{root}"
    open_ = fruitful(edges, shape)
    open_ = open_ if roots is None else open_.join(roots.select("s").distinct(), "s", "left_semi")
    names = [*[f"n_{x}" for x in nodes(shape)], *[f"e_{i}" for i in range(len(shape))]]
    rest = [c for c in names if c != n_root]
    found = None
    for width in (*widths, None):
        m = _keyed(edges, shape, width, tag, open_)
        best = m.groupBy(n_root).agg(F.min(F.struct(*[f"k_{i}" for i in order], *rest)).alias("b"))
        one = kept(best.select(*[c if c == n_root else F.col(f"b.{c}").alias(c) for c in names]))
        found = one if found is None else found.unionByName(one)
        if width is not None:
            open_ = kept(open_.join(one.select(F.col(n_root).alias("s")), "s", "left_anti"))
    return found


def one_match(found: DataFrame, root: str, seed=0, pass_no: int = 0) -> DataFrame:
    """One match of each root: the first by md5 of all of it. Sums come before rows, so hubs' matches aren't gathered."""
    cols = found.columns
    key = order_key(seed, pass_no, *[F.col(c) for c in cols])
    best = found.groupBy(f"n_{root}").agg(F.min(F.struct(key.alias("k"), *[c for c in cols if c != f"n_{root}"])).alias("b"))
    return best.select(*[c if c == f"n_{root}" else F.col(f"b.{c}").alias(c) for c in cols])


def shape_queries(found: DataFrame, shape: list[Edge], seed=0, pass_no: int = 0, p_edge: float = 1.0, p_node: float = 0.3, graph: str | None = None, per_occurrence: bool = False) -> DataFrame:
    """Records of matches. A node that is bound by chance is bound in all its patterns or in none; per_occurrence
    decides for each pattern anew, which may part the query."""
    root, _ = plan(shape)
    kinds = nodes(shape)
    key = F.col(f"n_{root}")

    def node(name: str, i: int, end: str) -> tuple[Column, Column]:
        chance = uniform(seed, pass_no, key, "n", name, *([i, end] if per_occurrence else [])) < p_node
        bound = F.lit(kinds[name] == BOUND) if kinds[name] != PROB else chance
        return bound, F.when(bound, iri(F.col(f"n_{name}"))).otherwise(f"?{name}")

    rows, entities = [], []
    for i, e in enumerate(shape):
        sb, s = node(e.subject, i, "s")
        ob, o = node(e.object, i, "o")
        pb = F.lit(e.predicate == BOUND) if e.predicate != PROB else uniform(seed, pass_no, key, "e", i) < p_edge
        rows.append(F.array(s, F.when(pb, iri(F.col(f"e_{i}"))).otherwise(f"?p{i}"), o))
        entities += [F.when(sb, F.col(f"n_{e.subject}")), F.when(pb, F.col(f"e_{i}")), F.when(ob, F.col(f"n_{e.object}"))]
    r = found.select(F.array(*rows).alias("triples"), F.filter(F.array(*entities), lambda v: v.isNotNull()).alias("x"), key.alias("start"))
    return r.select(query_text(F.col("triples"), graph).alias("query"), "triples", "x", F.lit(-1).cast("bigint").alias("y"), "start")


def extended_paths(edges: DataFrame, seed_hops: int, more_hops: int, k_seeds: int, limit: int, seed=0) -> DataFrame:
    """Seed, then extend: k distinct predicate tuples of seed_hops, the first by md5, each with more_hops further
    predicates: distinct whole tuples, the first `limit` of each seed by md5."""
    tuples = predicate_tuples(edges, seed_hops)
    chosen = tuples.orderBy(order_key(seed, "seed", F.array_join("preds", " ")), F.array_join("preds", " ")).limit(k_seeds)
    whole = predicate_tuples(edges, seed_hops + more_hops).select(F.slice("preds", 1, seed_hops).alias("seed"), "preds")
    whole = whole.join(F.broadcast(chosen.select(F.col("preds").alias("seed"))), "seed")
    w = W.partitionBy("seed").orderBy(order_key(seed, "more", F.array_join("preds", " ")), F.array_join("preds", " "))
    return whole.withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit).drop("k")


def with_star(path: list[tuple[str, str, str]], end: str, star: list[tuple[str, str, str]], prefix: str) -> list[tuple[str, str, str]]:
    """A flower: the star's subject becomes a path's node, its other variables get the prefix. Apply it to both ends
    of the path for a snowflake."""
    subject = star[0][0]
    name = lambda t: end if t == subject else f"?{prefix}{t[1:]}" if t.startswith("?") else t
    return [*path, *[(name(s), name(p), name(o)) for s, p, o in star]]


def bind(patterns: list[tuple[str, str, str]], values: dict[str, str]) -> list[tuple[str, str, str]]:
    """Patterns with variables (with ?) replaced by terms, term by term."""
    return [tuple(values.get(t, t) for t in p) for p in patterns]


def combination_stars(triples: DataFrame, n: int, k: int, seed=0, max_bound: int = 0) -> DataFrame:
    """k star templates, drawn with replacement from all combinations of n distinct predicates that subjects have, and
    instantiated from a subject that has them: up to max_bound objects that are IRIs are bound, by md5; the other
    predicates extend the star with variable objects. triples: s, p, o, o_is_iri. Records with `start` = draw."""
    from lodestar.operators.graph import predicate_combinations

    dense = places(predicate_combinations(triples, n), "place", F.array_join("combo", " ")).withColumn("place", F.col("place") - 1)
    draws = triples.sparkSession.range(k).select(F.col("id").alias("draw"), uniform(seed, F.col("id")).alias("u"))
    chosen = dense_choice(dense, draws, "place").select("draw", F.col("first_subject").alias("s"), F.posexplode("combo").alias("slot", "p"))
    key = order_key(seed, F.col("draw"), F.col("p"), F.col("o"))
    got = triples.join(F.broadcast(chosen), ["s", "p"]).groupBy("draw", "s", "slot", "p").agg(F.min(F.struct(key.alias("k"), "o", "o_is_iri")).alias("b"))
    place = F.row_number().over(W.partitionBy("draw").orderBy((~F.col("b.o_is_iri")), order_key(seed, F.col("draw"), "b", F.col("slot"))))
    n_bound = F.floor(uniform(seed, F.col("draw"), "n") * (max_bound + 1))
    d = got.withColumn("bound", F.col("b.o_is_iri") & (place <= n_bound))
    row = F.struct("slot", F.array(F.lit("?s"), iri(F.col("p")), F.when(F.col("bound"), iri(F.col("b.o"))).otherwise(F.concat(F.lit("?o"), F.col("slot").cast("string")))).alias("t"), "p", F.when(F.col("bound"), F.col("b.o")).alias("o"))
    g = d.groupBy("draw").agg(F.array_sort(F.collect_list(row)).alias("r"))
    t = F.transform("r", lambda x: x["t"])
    x = F.filter(F.flatten(F.transform("r", lambda v: F.array(v["p"], v["o"]))), lambda v: v.isNotNull())
    return g.select(query_text(t).alias("query"), t.alias("triples"), x.alias("x"), F.lit(-1).cast("bigint").alias("y"), F.col("draw").alias("start"))


def seeded_path_queries(edges: DataFrame, seed_hops: int, more_hops: int, k_seeds: int, limit: int, seed=0, p_start_end: float = 0.3) -> DataFrame:
    """Records of extended_paths(): each predicate tuple instantiated by one of its paths. Where no end is ever bound, paths
    show nothing in a record and are not made."""
    chosen = extended_paths(edges, seed_hops, more_hops, k_seeds, limit, seed).select("preds")
    if p_start_end <= 0:
        bare = chosen.select("preds", F.array().cast("array<string>").alias("nodes"), F.array_join("preds", " ").alias("start"))
        return path_queries(bare, seed, 0, 1.0, p_start_end)
    paths = simple_paths(edges, seed_hops + more_hops).join(F.broadcast(chosen), "preds")
    key = order_key(seed, F.array_join("nodes", " "))
    one = paths.groupBy("preds").agg(F.min(F.struct(key.alias("k"), "nodes")).alias("b")).select("preds", "b.nodes", F.array_join("preds", " ").alias("start"))
    return path_queries(one, seed, 0, 1.0, p_start_end)


def flower_shape(hops: int, leaves: int) -> str:
    """A path with a star at its end, in the shape language."""
    return ", ".join([f"?o{i} B ?o{i + 1}" for i in range(hops)] + [f"?o{hops} B ?y{i}" for i in range(leaves)])


def snowflake_shape(hops: int, leaves: int) -> str:
    """A path with a star at each end."""
    return ", ".join([flower_shape(hops, leaves)] + [f"?o0 B ?x{i}" for i in range(leaves)])


def cached_seeds(triples: DataFrame, folder: str, source: str, n: int, seed=0) -> DataFrame:
    """n subjects, the first by md5, kept as a table that is named by the source. One that can't be read is made anew."""
    import hashlib

    from lodestar.operators.graph import random_top

    path = f"{folder}/seeds-{hashlib.md5(source.encode()).hexdigest()[:8]}-{n}"
    spark = triples.sparkSession
    try:
        return spark.read.schema("s string").parquet(path) if spark.read.parquet(path).columns == ["s"] else _seeds(triples, path, n, seed, random_top)
    except Exception as e:  # noqa: BLE001
        if not any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ", "FAILED_READ")):
            raise
        return _seeds(triples, path, n, seed, random_top)


def _seeds(triples: DataFrame, path: str, n: int, seed, random_top) -> DataFrame:
    random_top(triples.select("s").distinct(), n, seed, "s").write.mode("overwrite").parquet(path)
    return triples.sparkSession.read.parquet(path)
