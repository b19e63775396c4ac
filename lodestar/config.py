"""Configurations of sampling runs, and the runs: one, a batch of sizes, all named shapes."""

from __future__ import annotations

import argparse
import hashlib
import importlib.util
import json
import math
import os
import time
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from lodestar.operators import passes, records, sampling
from lodestar.operators.graph import suitable_stars
from lodestar.operators.progress import Progress
from lodestar.plans.shapes import SHAPES, parse_shape, plan
from lodestar.sources.ntriples import cached_graph, parse_edges, parse_star, read_lines
from lodestar.sources.store import source_key


@dataclass(frozen=True)
class Config:
    """One run. kind: star, path or complex; star_combinations draws templates from all combinations of predicates that
    subjects have, seeded_path extends seed paths of seed_hops, and flower and snowflake are paths of `size` edges with
    `leaves` more at one end or both; these four keep what has solutions. cache: a folder for parsed graphs; empty parses each time.
    count_seconds: what a count may take on average, 10 s for a star and 3 s for others if it isn't set; a batch that takes
    longer is halved until only the queries that are late themselves keep y = -1. progress: a folder for the passes made, from
    which a run that was killed goes on. save_every: the output is also written without counts each time so many more
    queries are there. output_file: the name of the output in place of one with the time."""

    graph: str
    dataset: str = "dataset"
    kind: str = "star"
    size: int = 3
    n_queries: int = 1000
    query_shape: str | None = None
    min_objects: int = 0
    max_objects: int = 0
    p_predicate: float = 1.0
    p_edge: float = 1.0
    p_node: float = 0.3
    p_start_end: float = 0.3
    sampling_method: str = "dfs"
    dedup_method: str = "hash"
    graph_name: str | None = None
    cardinality: bool = False
    seed: int = 0
    starts: int | None = None
    cap: int | None = 50
    attempts: int = 100
    leaves: int = 2
    seed_hops: int = 1
    seeds: int = 1000
    count_seconds: float | None = None
    cache: str = ""
    output: str = ""
    output_file: str = ""
    progress: str = ""
    save_every: int = 100

    @classmethod
    def from_dict(cls, values: dict) -> Config:
        """Unknown names are an error; missing ones take the defaults."""
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        return cls(**values)

    @classmethod
    def load(cls, path: str) -> list[Config]:
        """A JSON object or list of objects, or a Python module with CONFIGURATIONS, a list of dicts."""
        if path.endswith(".py"):
            spec = importlib.util.spec_from_file_location("sampling_config", path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            values = module.CONFIGURATIONS
        else:
            with open(path) as f:
                values = json.load(f)
        return [cls.from_dict(v) for v in (values if isinstance(values, list) else [values])]


#: The kinds of runs, and which keep only what has solutions. Seconds that a count may take, by kind.
_FOUND = ("star_combinations", "seeded_path", "flower", "snowflake")
KINDS = ("star", "path", "complex", *_FOUND)
_SECONDS = {"star": 10.0, "star_combinations": 10.0}
#: Seconds that any batch of counts may take, for Spark's own share of the time.
_LEAST = 60.0


def _graph(spark: SparkSession, c: Config) -> DataFrame:
    dialect = "star" if c.kind in ("star", "star_combinations") else "edges"
    if c.cache:
        return cached_graph(spark, c.graph, c.cache, dialect)
    return {"star": parse_star, "edges": parse_edges}[dialect](read_lines(spark, c.graph))


def _shape_run(g: DataFrame, c: Config, text: str) -> tuple:
    from pyspark.sql import functions as F

    from lodestar.functions.hashing import order_key

    shape = parse_shape(text)
    root, _ = plan(shape)
    subjects = g.select("s").distinct()

    def make(k):
        roots = subjects if c.starts is None else subjects.orderBy(order_key(c.seed, k, "root", F.col("s")), "s").limit(c.starts)
        found = sampling.first_matches(g.select("s", "p", "o"), shape, c.seed, k, tuple(w for w in (4, c.cap) if w), roots)
        return sampling.shape_queries(found, shape, c.seed, k, c.p_edge, c.p_node, c.graph_name)

    return make, passes.Rules(c.n_queries, max_streak=max(500, subjects.count() // 10))


#: Settings that don't change which queries a run samples.
_ASIDE = ("dataset", "cache", "output", "output_file", "progress", "save_every", "cardinality", "count_seconds")


def progress_of(spark: SparkSession, c: Config) -> Progress | None:
    """The log of the run's passes, in a folder of its own for each state of the source and the settings."""
    if not c.progress:
        return None
    own = {k: v for k, v in asdict(c).items() if k not in _ASIDE}
    key = hashlib.md5(json.dumps([source_key(spark, [c.graph]), own], sort_keys=True).encode()).hexdigest()
    return Progress(spark, f"{c.progress}/run-{key}")


def run(spark: SparkSession, c: Config, save=None) -> passes.Result:
    """Samples different queries, counts them if asked, and writes the final file, and others before it, if `output` names
    a folder."""
    began = time.time()
    if c.kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}, not {c.kind!r}")
    g, text = _graph(spark, c), ""
    edges = g.select("s", "p", "o")
    if c.kind in ("star", "star_combinations"):
        edges = g.selectExpr("s", "p", "CASE WHEN o_kind = 'iri' THEN substring(o, 2, length(o) - 2) ELSE o END AS o", "o_kind = 'iri' AS o_is_iri")
    if c.kind == "star":
        rules = passes.Rules(c.n_queries, max_passes=300, max_streak=max(500, suitable_stars(edges, c.size).count() // 10), slow_seconds=60.0)
        make = lambda k: sampling.star_queries(edges, c.size, c.seed, k, c.min_objects, c.max_objects, c.p_predicate, c.graph_name).withColumnRenamed("source_subject", "start")
    elif c.kind == "star_combinations":
        rules = passes.Rules(c.n_queries, max_passes=1)
        make = lambda k: sampling.combination_stars(edges.distinct(), c.size, c.n_queries, f"{c.seed}|{k}", c.max_objects)
    elif c.kind == "seeded_path":
        rules = passes.Rules(c.n_queries, max_passes=1)
        make = lambda k: sampling.seeded_path_queries(edges, min(c.seed_hops, c.size), max(0, c.size - c.seed_hops), c.seeds, c.n_queries, c.seed, c.p_start_end)
    elif c.kind == "path":
        walk = c.sampling_method.startswith("random_walk")
        rules = passes.Rules(c.n_queries, max_passes=1 if walk else 30, max_streak=200)
        make = lambda k: sampling.path_queries(sampling.sampled_paths(edges, c.size, c.seed, k, c.starts, c.sampling_method, c.attempts), c.seed, k, c.p_edge, c.p_start_end)
    else:
        shape = {"flower": sampling.flower_shape, "snowflake": sampling.snowflake_shape}.get(c.kind)
        text = shape(c.size, c.leaves) if shape else c.query_shape or ""
        make, rules = _shape_run(g, c, text)
    size, method = len(parse_shape(text)) if text else c.size, c.sampling_method if c.kind == "path" else None

    def path(final: bool) -> str:
        return os.path.join(c.output, c.output_file or records.output_name(c.dataset, {"star": "stars"}.get(c.kind, c.kind), size, method, final and c.kind != "star", began))

    saved = 0

    def after(r: passes.Result) -> None:
        nonlocal saved
        if c.output and not r.reason and r.passes[-1]["total"] - saved >= c.save_every:
            saved = records.write_json(r.records.drop("key", "pass"), path(False))

    result = passes.collect(make, rules, c.dedup_method, save, progress_of(spark, c), after)
    if c.cardinality or c.kind in _FOUND:
        each = _SECONDS.get(c.kind, 3.0) if c.count_seconds is None else c.count_seconds
        least = _LEAST if c.count_seconds is None else 0.0
        result.records = passes.counted(edges.select("s", "p", "o").distinct(), result.records, each, passes.kept, least=least)
    if c.kind in _FOUND:
        result.records = records.nonempty(result.records)
    if c.output:
        records.write_json(result.records.drop("key", "pass"), path(True))
    return result


def run_batch(spark: SparkSession, c: Config, sizes: list[tuple[int, int]]) -> dict[str, passes.Result | Exception]:
    """A run for each (size, number); a star has up to half of its objects bound. A run that fails is reported and
    does not stop the others."""
    out: dict[str, passes.Result | Exception] = {}
    for size, n in sizes:
        name = f"{c.dataset}_SIZE_{size}"
        own = replace(c, dataset=name, size=size, n_queries=n, max_objects=math.ceil(0.5 * size) if c.kind == "star" else c.max_objects)
        try:
            out[name] = run(spark, own)
        except Exception as e:  # noqa: BLE001
            out[name] = e
    return out


def run_all_shapes(spark: SparkSession, c: Config, n: int = 5000) -> dict[str, passes.Result | Exception]:
    """A run for each named shape, each in a folder of its own if `output` is given."""
    out: dict[str, passes.Result | Exception] = {}
    for name, shape in SHAPES.items():
        folder = os.path.join(c.output, f"{c.dataset}_{name}_queries", "raw") if c.output else ""
        try:
            out[name] = run(spark, replace(c, kind="complex", query_shape=shape, n_queries=n, output=folder))
        except Exception as e:  # noqa: BLE001
            out[name] = e
    return out


def check_keys(verbose: bool = False, rounds: int = 500) -> int:
    """Tests the canonical key on the labelled pairs, against the brute-force form, and on shuffled and renamed queries.
    The number of failures."""
    import random

    from lodestar.catalog import PAIRS
    from lodestar.operators.dedup import brute_canonical, canonical, wl_key_of

    rng, failed = random.Random(0), 0

    def tell(what: str, ok: bool) -> None:
        nonlocal failed
        failed += not ok
        if verbose or not ok:
            print(f"{'ok' if ok else 'FAILED'}: {what}")

    read = lambda text: [tuple(t.split(" ")) for t in text.split("|")]
    for a, b, same in PAIRS:
        x, y = read(a), read(b)
        tell(f"{a} and {b} are {'the same' if same else 'different'}", (canonical(x) == canonical(y)) == (brute_canonical(x) == brute_canonical(y)) == same)
    for _ in range(rounds):
        x = read(rng.choice(PAIRS)[0])
        names = sorted({t for p in x for t in p if t.startswith("?")})
        to = dict(zip(names, rng.sample([f"?v{i}" for i in range(len(names))], len(names)), strict=True))
        y = [tuple(to.get(t, t) for t in p) for p in rng.sample(x, len(x))]
        tell(f"{x} as {y}", wl_key_of(x) == wl_key_of(y))
    return failed


def _sampler(sub, name: str) -> argparse.ArgumentParser:
    p = sub.add_parser(name)
    p.add_argument("rdf_file")
    p.add_argument("dataset_name")
    p.add_argument("--num", type=int, default=1000)
    p.add_argument("--card", action="store_true", help="count the solutions of each query")
    p.add_argument("--endpoint", help="taken for the sake of old command lines: counts are made in this engine")
    p.add_argument("--no-cache", action="store_true", help="parse the file again")
    p.add_argument("--output", default=".")
    return p


def main(args: list[str] | None = None) -> int:
    """python -m lodestar.config sample CONFIG | path FILE DATASET | complex FILE DATASET --shape SHAPE | clean ROOT | combine PATTERN [OUTPUT] | check-keys"""
    p = argparse.ArgumentParser(description=main.__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("sample").add_argument("config")
    path = _sampler(sub, "path")
    path.add_argument("--length", type=int, default=3)
    path.add_argument("--method", choices=["random_walk", "dfs", "bfs", "random_walk_optimized"], default="random_walk")
    path.add_argument("--timing", action="store_true", help="print how long sampling took")
    shape = _sampler(sub, "complex")
    shape.add_argument("--shape", required=True)
    shape.add_argument("--p-edge", type=float, default=Config.p_edge)
    shape.add_argument("--p-node", type=float, default=Config.p_node)
    sub.add_parser("clean").add_argument("root")
    c = sub.add_parser("combine")
    c.add_argument("pattern")
    c.add_argument("output", nargs="?", default="")
    sub.add_parser("check-keys").add_argument("--verbose", "-v", action="store_true")
    a = p.parse_args(args)
    if a.what == "check-keys":
        failed = check_keys(a.verbose)
        print(f"{failed} failed" if failed else "all passed")
        return int(failed > 0)
    spark = SparkSession.builder.appName("lodestar").getOrCreate()
    if a.what == "clean":
        print(json.dumps(records.clean_folders(spark, a.root)))
        return 0
    if a.what == "combine":
        df, path = records.combine(spark, a.pattern, a.output)
        print(json.dumps({"output": path, **records.statistics(df).first().asDict()}))
        return 0
    if a.what == "sample":
        configs = Config.load(a.config)
    else:
        own = {"graph": a.rdf_file, "dataset": a.dataset_name, "kind": a.what, "n_queries": a.num, "cardinality": a.card, "output": a.output, "cache": "" if a.no_cache else os.path.join(a.output, "cache")}
        configs = [Config(**own, size=a.length, sampling_method=a.method) if a.what == "path" else Config(**own, query_shape=a.shape, p_edge=a.p_edge, p_node=a.p_node)]
    failed = 0
    for config in configs:
        began = time.monotonic()
        try:
            r = run(spark, config)
            told = {"dataset": config.dataset, "passes": r.passes, "reason": r.reason}
        except Exception as e:  # noqa: BLE001
            failed += 1
            told = {"dataset": config.dataset, "error": str(e)[:500]}
        if getattr(a, "timing", False):
            told["seconds"] = round(time.monotonic() - began, 3)
        print(json.dumps(told))
    return int(failed > 0)


if __name__ == "__main__":
    raise SystemExit(main())
