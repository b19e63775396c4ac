"""Passes over all starts until enough different queries are found, with the rules that stop them."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.operators.dedup import dedup_key, unseen
from lodestar.operators.progress import Progress
from lodestar.operators.ranges import carried, kept, lazily_kept, ordered, places
from lodestar.plans.bgp import count_batch


__all__ = ["Result", "Rules", "collect", "counted", "duplicate_streak", "kept", "places", "run_metrics", "with_counts", "within"]


@dataclass(frozen=True)
class Rules:
    """When to stop: at `target` queries, after a pass with fewer than `least_new` new ones, after `max_passes`, in a
    pass at `max_streak` duplicates in a row, and when `slow_queries` new ones in a row took over slow_seconds each
    (None: not). The queries of a pass are made together and took its time divided by their number."""

    target: int = 1000
    least_new: int = 5
    max_passes: int = 30
    max_streak: int | None = None
    slow_seconds: float | None = None
    slow_queries: int = 5


@dataclass
class Result:
    records: DataFrame
    passes: list[dict] = field(default_factory=list)
    reason: str = ""


def duplicate_streak(df: DataFrame, duplicate: Column, *order: Column) -> DataFrame:
    """With `streak`: the duplicates in a row up to each row in the order. Ranges of the order are worked out side by
    side; a streak that reaches a range's start goes on from the ranges before."""
    d = ordered(df.withColumn("_dup", F.coalesce(duplicate, F.lit(False))), *order)
    before, carry = [], 0
    for r in d.groupBy("_part").agg(F.count("*").alias("n"), F.max(F.when(~F.col("_dup"), F.col("_at"))).alias("last")).orderBy("_part").collect():
        before.append((r["_part"], carry))
        carry = carry + r.n if r["last"] is None else r.n - r["last"]
    last = F.max(F.when(~F.col("_dup"), F.col("_at"))).over(W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    return carried(d, before).withColumn("streak", F.col("_at") - F.coalesce(last, -F.col("_before"))).drop("_part", "_at", "_before", "_dup")


def collect(candidates: Callable[[int], DataFrame], rules: Rules, method: str = "hash", save: Callable[[DataFrame, int], DataFrame] | None = None, log: Progress | None = None, after: Callable[[Result], None] | None = None) -> Result:
    """candidates(pass) gives records with `start`. New ones, by their key, are appended pass by pass; save(rows, pass)
    should write them as a table and read it again, so that each pass is worked out once; without it passes go to the
    checkpoint folder, or are cached where none is set. With a log passes go there instead, and those that it has already
    are taken from it, so a run whose driver was killed goes on behind its last pass and ends with the rows that it would
    have had. after(result) is called behind each pass that was made."""
    out: DataFrame | None = None
    result, have, slow = Result(None), 0, 0  # type: ignore[arg-type]
    for told in log.done() if log else ():
        out = log.rows(told["pass"]) if out is None else out.unionByName(log.rows(told["pass"]))
        have, slow, result.reason = told["total"], told["slow"], told["reason"]
        result.passes.append({k: told[k] for k in ("pass", "new", "total")})
    result.records = out
    if result.reason:
        return result
    for n in range(len(result.passes), rules.max_passes):
        began = time.monotonic()
        rows = candidates(n).withColumn("key", dedup_key("triples", method))
        rows = lazily_kept(rows.withColumn("at", F.md5(F.concat_ws("|", F.lit(n), "start"))))  # read several times below
        first = rows.groupBy("key").agg(F.min(F.struct("at", "start")).alias("f"))
        rows = rows.join(first.select("key", F.col("f.at").alias("fa"), F.col("f.start").alias("fs")), "key")
        rows = rows.withColumn("again", ~((F.col("at") == F.col("fa")) & (F.col("start") == F.col("fs")))).drop("fa", "fs")
        if out is not None:
            rows = rows.join(out.select("key", F.lit(True).alias("old")), "key", "left").withColumn("again", F.col("again") | F.coalesce("old", F.lit(False))).drop("old")
        if rules.max_streak:
            marked = duplicate_streak(rows.select("at", "start", "again"), F.col("again"), F.col("at"), F.col("start"))
            stop = marked.where(F.col("streak") >= rules.max_streak).agg(F.min("at")).first()[0]
            rows = rows.where(F.col("at") <= stop) if stop is not None else rows
        new = rows.where(~F.col("again")).orderBy("at", "start").limit(rules.target - have).drop("again", "at").withColumn("pass", F.lit(n))
        new = log.write(new, n) if log else save(new, n) if save else lazily_kept(new)
        got = new.count()
        out, have = new if out is None else out.unionByName(new), have + got
        slow = slow + got if rules.slow_seconds and got and (time.monotonic() - began) / got > rules.slow_seconds else 0
        if have >= rules.target or got < rules.least_new:
            result.reason = "target" if have >= rules.target else "few new"
        elif slow >= rules.slow_queries:
            result.reason = "slow"
        elif n + 1 == rules.max_passes:
            result.reason = "passes"
        result.records = out
        result.passes.append({"pass": n, "new": got, "total": have})
        if log:
            log.commit(n, {**result.passes[-1], "slow": slow, "reason": result.reason})
        if after:
            after(result)
        if result.reason:
            break
    return result


def with_counts(triples: DataFrame, records: DataFrame, key: str = "key") -> DataFrame:
    """Records with y worked out for all of them together; -1 where it is beyond 64 bits."""
    counts = count_batch(triples, records.select(F.col(key).alias("qid"), "triples"))
    counts = counts.select(F.col("qid").alias(key), F.coalesce(F.col("y").try_cast("bigint"), F.lit(-1)).alias("y"))
    return records.drop("y").join(counts, key)


def within(df: DataFrame, seconds: float, save: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """save(df), or None if it takes longer; its jobs are cancelled then."""
    sc = df.sparkSession.sparkContext
    tag = f"lodestar-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        out = save(df)
        return None if late.is_set() else out
    except Exception:
        if late.is_set():
            return None
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


def estimated(triples: DataFrame, records: DataFrame, key: str = "key") -> DataFrame:
    """key and cost: the product, as a logarithm, of how many edges the predicate of each pattern has; a variable's are all
    edges. Bound ends count as one edge for each different node at that end."""
    sizes = triples.groupBy("p").agg(F.count("*").alias("n"), F.approx_count_distinct("s").alias("ns"), F.approx_count_distinct("o").alias("no"))
    whole = triples.agg(F.count("*").alias("all"))
    parts = records.select(F.col(key).alias("_key"), F.explode_outer("triples").alias("t"))
    parts = parts.select("_key", F.regexp_extract(F.col("t")[1], "^<(.*)>$", 1).alias("p"), (~F.col("t")[0].startswith("?")).alias("sb"), (~F.col("t")[2].startswith("?")).alias("ob"))
    rows = parts.join(sizes, "p", "left").crossJoin(F.broadcast(whole))  # one row
    n = F.coalesce("n", F.when(F.col("p") == "", F.col("all")).otherwise(F.lit(0)))
    each = n / F.when(F.col("sb"), F.greatest(F.coalesce("ns", F.lit(1)), F.lit(1))).otherwise(1) / F.when(F.col("ob"), F.greatest(F.coalesce("no", F.lit(1)), F.lit(1))).otherwise(1)
    return rows.groupBy(F.col("_key").alias(key)).agg(F.sum(F.log1p(F.coalesce(each, F.lit(0.0)))).alias("cost"))


def counted(triples: DataFrame, records: DataFrame, seconds: float, save: Callable[[DataFrame], DataFrame], on_timeout: str = "mark", key: str = "key", least: float = 0.0) -> DataFrame:
    """with_counts() within a time limit: `seconds` for each record on average, `least` for any batch. A batch that is late is
    halved in the order of estimated costs and each half has its own limit, down to one record: only records that are late on
    their own keep y = -1 (mark) or are dropped (drop). Cheap halves go first, and all batches together end at three times the
    records' limit and `least` for each halving that one record takes; the costly ones that are open then are late too."""
    if on_timeout not in ("mark", "drop"):
        raise ValueError(f"on_timeout is mark or drop, not {on_timeout!r}")
    n, late = records.count(), records.withColumn("y", F.lit(-1).cast("bigint"))
    if n == 0:
        return late
    count = lambda rows: save(with_counts(triples, rows, key))  # noqa: E731 (jobs run in with_counts() too)
    end = time.monotonic() + 3 * seconds * n + least * 2 * (1 + n.bit_length())
    done = within(records, max(least, seconds * n), count)
    if done is not None:
        return done
    if n > 1:
        costs = kept(places(estimated(triples, records, key), "_rank", -F.col("cost"), F.col(key)).select(key, "_rank"))
        ranked = records.join(costs, key)
    found: list[DataFrame] = []
    open_: list[tuple[int, int]] = [(1 + n // 2, n), (1, n // 2)] if n > 1 else []
    missed: list[tuple[int, int]] = [] if n > 1 else [(1, 1)]
    while open_:
        lo, hi = open_.pop(open_.index(max(open_)))
        size, left = hi - lo + 1, end - time.monotonic()
        part = ranked.where(F.col("_rank").between(lo, hi)).drop("_rank")
        done = within(part, min(left, max(least, seconds * size)), count) if left > 0 else None
        if done is not None:
            found.append(done)
        elif size == 1 or left <= 0:
            missed.append((lo, hi))
        else:
            open_ += [(lo + size // 2, hi), (lo, lo + size // 2 - 1)]
    if on_timeout == "mark" and missed:
        away = records if n == 1 else ranked.where(" or ".join(f"_rank between {lo} and {hi}" for lo, hi in missed)).drop("_rank")
        found.append(away.withColumn("y", F.lit(-1).cast("bigint")))
    if not found:
        return late.limit(0)
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def run_metrics(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates, kept ones, duplicates, failed counts and the share kept, in one row."""
    made = candidates.agg(F.count("*").alias("n_candidates"), F.countDistinct("key").alias("n_keys"))
    kept = records.agg(F.count("*").alias("n_kept"), F.count_if(F.col("y") == -1).alias("n_failed"))
    return made.crossJoin(kept).select("n_candidates", "n_kept", (F.col("n_candidates") - F.col("n_keys")).alias("n_duplicates"), "n_failed", (F.col("n_kept") / F.col("n_candidates")).alias("kept_share"))
