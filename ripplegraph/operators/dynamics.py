"""Discrete-time leaky integrate-and-fire dynamics on a signed weighted network.

A step: leak, arriving pulses, outside input, hold while refractory, then threshold (a potential equal to it fires),
reset and delivery after the delay. Input during the hold is lost. Two forms with the same result: `dense_steps`
updates every node in every step, `event_steps` only nodes that something reaches, with the leak since the last update
as a power. Both are loops of DataFrame steps over written tables; `kernel` runs whole simulations side by side, dealt
to tasks, for sweeps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.draws import uniform32
from ..session import written
from .everywhere import everywhere

NEVER = -(2**30)


@dataclass(frozen=True)
class Params:
    """Times in ms; refractory and delay in steps of dt."""

    dt: float = 1.0
    tau: float = 20.0
    theta: float = 1.0
    reset: float = 0.0
    refractory: int = 3
    delay: int = 1
    input_weight: float = 2.0

    def __post_init__(self):
        if self.dt <= 0 or self.tau <= 0 or self.refractory < 0 or self.delay < 1 or self.reset >= self.theta:
            raise ValueError("dt and tau must be positive, the delay at least 1, the reset below the threshold")

    @property
    def alpha(self) -> float:
        return exp(-self.dt / self.tau)

    def with_(self, **changes) -> Params:
        return replace(self, **changes)


# The sign of each class of edge.
SIGNS = {0: 1, 1: 1, 2: -1, 3: 1, 4: -1, 5: 1}


def transform(weight, how: str, clip: float = 50.0):
    return {"linear": weight.cast("double"), "sqrt": F.sqrt(weight), "log1p": F.log1p(weight), "clipped": F.least(weight.cast("double"), F.lit(clip))}[how]


def build_network(edge: DataFrame, how: str = "log1p", gain: float = 1.0, least: int = 1, signs: dict | None = None) -> DataFrame:
    """(src, dst, w): sign x gain x f(weight) / mean f over all edges of at least this weight, self-loops included in the mean
    and left out of the network; edges without a sign are dropped. edge: src, dst, weight, class (null: none)."""
    signs = SIGNS if signs is None else signs
    sign = F.create_map(*(F.lit(x) for k, v in signs.items() for x in (k, v)))[F.col("class")]
    some = edge.filter(F.col("weight") >= least)
    norm = some.agg(F.avg(transform(F.col("weight"), how)).alias("norm"))
    w = F.col("sign") * gain * transform(F.col("weight"), how) / F.col("norm")
    return some.withColumn("sign", F.coalesce(sign, F.lit(0))).filter("src <> dst AND sign <> 0").crossJoin(F.broadcast(norm)).select("src", "dst", w.alias("w"))


def network_meta(edge: DataFrame, network: DataFrame) -> DataFrame:
    """One row of counters on what a network kept."""
    all_ = edge.filter("src <> dst").agg(F.count(F.lit(1)).alias("edges"))
    return network.agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("w") > 0).alias("excitatory"), F.count_if(F.col("w") < 0).alias("inhibitory"), F.avg(F.abs("w")).alias("mean_abs"), F.max(F.abs("w")).alias("max_abs")).crossJoin(all_).withColumn("removed", F.col("edges") - F.col("kept"))


def lowest(rows: DataFrame, keys: list[str], many: int, draw: str = "h", id_col: str = "id", bins: int = 4096) -> DataFrame:
    """Of each key, exactly the `many` rows with the smallest (draw, id); draw is uniform on [0, 2^32).

    A histogram of the draws gives the bin in which the last of them falls; only that bin's rows are ranked.
    """
    binned = rows.withColumn("bin", F.floor(F.col(draw) / (2**32 // bins)).cast("int"))
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    met = binned.join(counts.select(*keys, "bin", "n", before.alias("before")).filter(F.col("before") < many), [*keys, "bin"])
    whole = met.filter(F.col("before") + F.col("n") <= many)
    part = met.filter(F.col("before") + F.col("n") > many).withColumn("place", F.row_number().over(W.partitionBy(*keys, "bin").orderBy(draw, id_col)))
    return whole.select(rows.columns).unionByName(part.filter(F.col("before") + F.col("place") <= many).select(rows.columns))


def stimulus(nodes: DataFrame, steps: int, rate: float, seed: int, pattern: str = "poisson", period: int = 50, on: int = 10, on_steps: int | None = None, fraction: float = 1.0, members: int = 50) -> DataFrame:
    """(t, id) of outside input. Patterns: none, poisson, burst (poisson while t % period < on), pulse (at each period exactly
    round(rate x eligible) newly drawn nodes), sparse_pattern (`members` nodes, each at its own offset below `on` in every
    period). Exactly max(1, round(fraction x nodes)) nodes are eligible; on_steps ends all input."""
    spark = nodes.sparkSession
    times = spark.range(0 if pattern == "none" else min(steps, on_steps if on_steps is not None else steps)).select(F.col("id").cast("int").alias("t"))
    n, some = None, nodes.select("id")
    if fraction < 1 or pattern == "pulse":
        n = max(1, round(fraction * nodes.count()))
    if fraction < 1:
        some = lowest(some.select(F.lit(0).alias("key"), "id", uniform32(seed, F.lit("e"), F.col("id")).alias("h")), ["key"], n).select("id")
    draw = uniform32(seed, F.col("t"), F.col("id"))
    if pattern in ("none", "poisson"):
        return times.crossJoin(some).filter(draw < F.lit(int(rate * 2**32))).select("t", "id")
    if pattern == "burst":
        return times.filter(F.col("t") % period < on).crossJoin(some).filter(draw < F.lit(int(rate * 2**32))).select("t", "id")
    if pattern == "pulse":
        return lowest(times.filter(F.col("t") % period == 0).crossJoin(some).select("t", "id", draw.alias("h")), ["t"], round(rate * n)).select("t", "id")
    if pattern == "sparse_pattern":
        drawn = lowest(some.select(F.lit(0).alias("key"), "id", uniform32(seed, F.lit("m"), F.col("id")).alias("h")), ["key"], members)
        at = drawn.select("id", (uniform32(seed, F.lit("o"), F.col("id")) % on).cast("int").alias("offset"))
        return times.withColumn("offset", F.col("t") % period).filter(F.col("offset") < on).join(F.broadcast(at), "offset").select("t", "id")
    raise ValueError(pattern)


def fixed_point(network: DataFrame, scale: int = 10**9) -> DataFrame:
    """Weights as whole numbers of 1 / scale: sums of such weights do not depend on their order."""
    return network.select("src", "dst", F.round(F.col("w") * scale).cast("long").alias("w"))


def dense_steps(network: DataFrame, nodes: DataFrame, given: DataFrame, p: Params, steps: int, scale: int = 10**9) -> tuple[DataFrame, DataFrame]:
    """(raster, final): pulses (t, id) and potentials (id, v, last). network: fixed-point weights."""
    net, given = written(network, "network"), written(given, "stimulus")
    state = written(nodes.select("id", F.lit(0.0).alias("v"), F.lit(NEVER).alias("last")), "state")
    pulses: list[DataFrame] = []
    for t in range(steps):
        joined = state
        if t - p.delay >= 0:
            arriving = pulses[t - p.delay].withColumnRenamed("id", "src").join(net, "src").groupBy(F.col("dst").alias("id")).agg((F.sum("w") / scale).alias("syn"))
            joined = joined.join(arriving, "id", "left")
        else:
            joined = joined.withColumn("syn", F.lit(0.0))
        outside = given.filter(F.col("t") == t).select("id", F.lit(p.input_weight).alias("ext"))
        v = F.col("v") * p.alpha + F.coalesce("syn", F.lit(0.0)) + F.coalesce("ext", F.lit(0.0))
        held = F.lit(t) - F.col("last") <= p.refractory
        now = joined.join(outside, "id", "left").select("id", F.when(held, p.reset).otherwise(v).alias("v"), "last", held.alias("held"))
        fires = ~F.col("held") & (F.col("v") >= p.theta)
        state = written(now.select("id", F.when(fires, p.reset).otherwise(F.col("v")).alias("v"), F.when(fires, t).otherwise(F.col("last")).alias("last")), "state")
        pulses.append(state.filter(F.col("last") == t).select("id"))
    raster = None
    for t, x in enumerate(pulses):
        row = x.select(F.lit(t).alias("t"), "id")
        raster = row if raster is None else raster.union(row)
    return raster, state


def event_steps(network: DataFrame, nodes: DataFrame, given: DataFrame, p: Params, steps: int, scale: int = 10**9) -> tuple[DataFrame, DataFrame]:
    """The same, where a step touches only nodes that pulses or input reach; others keep their potential of the step `at`."""
    net, given = written(network, "network"), written(given, "stimulus")
    state = written(nodes.select("id", F.lit(0.0).alias("v"), F.lit(NEVER).alias("last"), F.lit(0).alias("at")), "state")
    pulses: list[DataFrame] = []

    def leaked(t: int):
        """The potential at step t before input: the leak runs from the last update or the end of the hold."""
        end = F.col("last") + p.refractory
        base = F.when(end >= F.col("at"), p.reset).otherwise(F.col("v"))
        return base * F.pow(F.lit(p.alpha), F.greatest(F.lit(0), F.lit(t) - F.greatest("at", end)))

    for t in range(steps):
        parts = [given.filter(F.col("t") == t).select("id", F.lit(0).cast("long").alias("w"), F.lit(p.input_weight).alias("x"))]
        if t - p.delay >= 0:
            parts.append(pulses[t - p.delay].withColumnRenamed("id", "src").join(net, "src").select(F.col("dst").alias("id"), "w", F.lit(0.0).alias("x")))
        both = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
        reached = both.groupBy("id").agg((F.sum("w") / scale).alias("syn"), F.max("x").alias("ext"))
        held = F.lit(t) - F.col("last") <= p.refractory
        v = F.when(F.col("syn").isNull() | held, F.col("v")).otherwise(leaked(t) + F.col("syn") + F.col("ext"))
        now = state.join(reached, "id", "left").select("id", v.alias("v"), "last", F.when(F.col("syn").isNull() | held, F.col("at")).otherwise(t).alias("at"), (F.col("syn").isNotNull() & ~held).alias("open"))
        fires = F.col("open") & (F.col("v") >= p.theta)
        state = written(now.select("id", F.when(fires, p.reset).otherwise(F.col("v")).alias("v"), F.when(fires, t).otherwise(F.col("last")).alias("last"), "at"), "state")
        pulses.append(state.filter(F.col("last") == t).select("id"))
    raster = None
    for t, x in enumerate(pulses):
        row = x.select(F.lit(t).alias("t"), "id")
        raster = row if raster is None else raster.union(row)
    end = F.when(F.col("at") == steps - 1, F.col("v")).otherwise(F.when(F.lit(steps - 1) - F.col("last") <= p.refractory, F.lit(p.reset)).otherwise(leaked(steps - 1)))
    return raster, state.select("id", end.alias("v"), "last")


def _pieces(first: np.ndarray, nodes: np.ndarray, most: int = 1 << 21) -> Iterator[np.ndarray]:
    """Places of the edges of these nodes, in order, in pieces of at most so many (a node's edges stay together)."""
    begin, many = first[nodes], first[nodes + 1] - first[nodes]
    total = np.cumsum(many)
    i = 0
    while i < len(nodes):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, side="right")))
        before = np.cumsum(many[i:j]) - many[i:j]
        yield np.repeat(begin[i:j] - before, many[i:j]) + np.arange(many[i:j].sum())
        i = j


def _steps(first: np.ndarray, dst: np.ndarray, w: np.ndarray, gain: float, n: int, given: Callable, p: Params, steps: int) -> Iterator[tuple]:
    """(pulses, distinct nodes that pulses reach, potentials, last pulses) of each step; given(t): nodes with outside input.

    A node's edges are first[i] to first[i + 1]. Sums are made in the order of the edges, however they are cut into pieces.
    """
    v, last = np.zeros(n), np.full(n, NEVER, np.int64)
    due, reached = [np.zeros(n) for _ in range(p.delay)], [0] * p.delay
    for t in range(steps):
        slot = t % p.delay
        v *= p.alpha
        v += due[slot]
        arrived, due[slot] = reached[slot], np.zeros(n)
        v[given(t)] += p.input_weight
        held = t - last <= p.refractory
        v[held] = p.reset
        fires = np.flatnonzero(~held & (v >= p.theta))
        v[fires], last[fires] = p.reset, t
        met = np.zeros(n, bool)
        for k, take in enumerate(_pieces(first, fires)):
            to, x = dst[take], w[take] * gain
            if k:
                np.add.at(due[slot], to, x)
            else:
                due[slot] = np.bincount(to, x, n)
            met[to] = True
        reached[slot] = int(met.sum())
        yield fires, arrived, v, last


def simulate(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int, times: np.ndarray, targets: np.ndarray, p: Params, steps: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """One run in numpy: pulses of each step, final potentials, last pulses. src must be sorted."""
    first = np.searchsorted(src, np.arange(n + 1))
    order = np.argsort(times, kind="stable")
    times, targets = times[order], targets[order]
    begin = np.searchsorted(times, np.arange(steps + 1))
    v, last = np.zeros(n), np.full(n, NEVER, np.int64)
    pulses = []
    for fires, _, v, last in _steps(first, dst, w, 1.0, n, lambda t: targets[begin[t] : begin[t + 1]], p, steps):
        pulses.append(fires)
    return pulses, v, last


def kernel(spark: SparkSession, network: DataFrame, configs: DataFrame, n: int, steps: int, p: Params, off: int = 0, held: int | None = None) -> DataFrame:
    """(run, t, pulses, arrivals, external, targets) for every row of configs (run, gain, rate, seed), gain scales the weights.

    Nodes are 0..n-1. Runs are few and are dealt to tasks; each task takes the network once (see `everywhere`), whatever its size, and
    goes through its runs one after the other. targets: distinct nodes that pulses reach in a step.
    """
    runs = [r.asDict() for r in configs.select("run", "gain", "rate", "seed").orderBy("run").collect()]
    tasks = max(1, min(len(runs), spark.sparkContext.defaultParallelism))
    names = pa.schema([("run", pa.int64()), ("t", pa.int32()), *((c, pa.int64()) for c in ("pulses", "arrivals", "external", "targets"))])

    def use(task: int, edges: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        degree = np.zeros(n, np.int64)
        for k in range(0, len(edges["src"]), 1 << 22):
            degree += np.bincount(edges["src"][k : k + (1 << 22)], minlength=n)
        first = np.concatenate([[0], np.cumsum(degree)])
        for r in runs[task::tasks]:
            rng, out, external = np.random.default_rng([int(r["seed"]), 17]), [], []

            def given(t: int) -> np.ndarray:  # the draws of all steps in their order, a step at a time
                some = np.flatnonzero(rng.random(n) < r["rate"]) if t < steps - off else np.empty(0, np.int64)  # noqa: B023
                external.append(len(some))  # noqa: B023
                return some

            for t, (fires, reached, _, _) in enumerate(_steps(first, edges["dst"], edges["w"], r["gain"], n, given, p, steps)):
                out.append((r["run"], t, len(fires), int(degree[fires].sum()), external[t], reached))
            yield pa.RecordBatch.from_pylist([dict(zip(names.names, x)) for x in out], names)

    return everywhere(network, {"src": np.int32, "dst": np.int32, "w": np.float64}, ["src", "dst"], tasks, use, "run long, t int, pulses long, arrivals long, external long, targets long", held)


def run_summary(series: DataFrame, n: int, p: Params) -> DataFrame:
    """Of each run (run, t, pulses, arrivals): totals, mean rate in Hz, events per pulse (0 without pulses), refractory
    occupancy, share of slots with a pulse, and the largest share of nodes in a step."""
    steps, n = F.max("t") + 1, F.lit(n).cast("double")  # slots are more than an int holds
    by = series.groupBy("run").agg(F.sum("pulses").alias("pulses"), F.sum("arrivals").alias("arrivals"), F.max("pulses").alias("most"), steps.alias("steps"))
    occupied = series.join(by.select("run", "steps"), "run").groupBy("run").agg(F.sum(F.col("pulses") * F.least(F.lit(p.refractory), F.col("steps") - 1 - F.col("t"))).alias("held"))
    got = by.join(occupied, "run")
    return got.select("run", "steps", "pulses", "arrivals", (F.col("pulses") * 1000.0 / (n * F.col("steps") * p.dt)).alias("hz"), (F.col("arrivals") / F.greatest("pulses", F.lit(1))).alias("per_pulse"), (F.col("held") / (n * F.col("steps"))).alias("occupancy"), (F.col("pulses") / (n * F.col("steps"))).alias("per_slot"), (F.col("most") / n).alias("largest_step"))


# Bounds of the regime rules.
RULES = {"dead_amplification": 1.05, "saturated_share": 0.5, "runaway_share": 0.1}


def tail_steps(steps, off_from: int):
    """Length of the last third of the steps after the input ended: at least one, none without such steps."""
    return F.when(steps > off_from, F.greatest(F.floor((steps - off_from) / 3), F.lit(1))).otherwise(0)


def regimes(series: DataFrame, n: int, off_from: int, p: Params) -> DataFrame:
    """Of each run (run, t, pulses, external): rates a node and step while input is on and in the last third after it ended,
    amplification (pulses while on for each outside event), regime and whether activity sustains itself.

    SATURATED: while on at least half of the highest rate that the hold allows, or late at least a tenth of it. DEAD: less
    than 1.05 pulses for each outside event while on, and none late. STABLE: all others.
    """
    s = series.join(series.groupBy("run").agg((F.max("t") + 1).alias("steps")), "run")
    late = F.col("t") >= F.col("steps") - tail_steps(F.col("steps"), off_from)
    of = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    on = F.col("t") < off_from
    m = s.groupBy("run", "steps").agg(of("pulses", on).alias("on"), of("external", on).alias("external"), of("pulses", late & (F.col("t") >= off_from)).alias("late"))
    size = float(max(n, 1))
    rate_on = F.col("on") / (size * max(off_from, 1))
    rate_late = F.col("late") / (size * F.greatest(tail_steps(F.col("steps"), off_from), F.lit(1)))
    m = m.select("run", rate_on.alias("rate_on"), rate_late.alias("rate_late"), (F.col("on") / F.greatest("external", F.lit(1))).alias("amplification"))
    highest = 1.0 / (p.refractory + 1)
    saturated = (F.col("rate_on") >= RULES["saturated_share"] * highest) | (F.col("rate_late") >= RULES["runaway_share"] * highest)
    dead = (F.col("amplification") < RULES["dead_amplification"]) & (F.col("rate_late") == 0)
    return m.withColumn("regime", F.when(saturated, "SATURATED").when(dead, "DEAD").otherwise("STABLE")).withColumn("self_sustained", F.col("rate_late") > 0)


def raster_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row on two rasters (t, id): pulses of each, pulses in one only, the first step that differs (null: none)."""
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), ["t", "id"], "full")
    odd = F.col("a").isNull() | F.col("b").isNull()
    return both.agg(F.count("a").alias("pulses_a"), F.count("b").alias("pulses_b"), F.count_if(odd).alias("different"), F.min(F.when(odd, F.col("t"))).alias("first_step"))


def state_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the largest difference of potentials of two final states."""
    return a.select("id", F.col("v").alias("x")).join(b.select("id", F.col("v").alias("y")), "id", "full").agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("largest"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("unmatched"))
