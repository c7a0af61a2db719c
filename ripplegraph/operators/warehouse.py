"""Run records: names, resumption, pairing, calibration, crossovers, cost models and outcome rules.

A run record has subgraph, rate, seed, mode and measures. All of these are queries over tables of records; only the cost
model solves its small normal equations on the driver.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship
from .dynamics import tail_steps


def experiment_id(*parts: str):
    """The name of a run: its fields joined by underscores, rates in plain digits."""
    return F.concat_ws("_", *(F.col(p).cast("string") for p in parts))


def config_digest(*columns: str):
    """Identity of a configuration: SHA-256 of its fields as JSON in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def pending(configs: DataFrame, done: DataFrame, key: str = "experiment_id") -> DataFrame:
    return configs.join(done.select(key), key, "left_anti")


def table_difference(frozen: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state): changed, missing or new rows of a table against a frozen one; null values are equal."""
    a, b = frozen.select(key, F.col(value).alias("a"), F.lit(1).alias("in_a")), now.select(key, F.col(value).alias("b"), F.lit(1).alias("in_b"))
    state = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "new").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, key, "full").select(key, state.alias("state")).filter("state IS NOT NULL")


def at_baseline(runs: DataFrame, gains: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Runs at their subgraph's baseline gain (subgraph, baseline), by relative tolerance."""
    near = F.abs(F.col("gain") - F.col("baseline")) <= tolerance * F.greatest(F.abs("gain"), F.abs("baseline"))
    return runs.join(gains, "subgraph").filter(near).drop("baseline")


def paired(runs: DataFrame, measure: str, a: str, b: str) -> DataFrame:
    """Of each subgraph and rate, over seeds with runs of both modes: median, least and largest a / b, pairs, and the ratio of medians."""
    wide = runs.groupBy("subgraph", "rate", "seed").pivot("mode", [a, b]).agg(F.median(measure))
    both = wide.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("r", F.try_divide(a, b))
    return both.groupBy("subgraph", "rate").agg(F.count(F.lit(1)).alias("pairs"), F.median("r").alias("median"), F.min("r").alias("least"), F.max("r").alias("largest"), F.try_divide(F.median(a), F.median(b)).alias("of_medians"))


def significant(ratios: DataFrame, by: float = 0.05) -> DataFrame:
    """Adds significant: the median is at least `by` from 1, and 1 is not within the range of the pairs."""
    return ratios.withColumn("significant", (F.abs(F.col("median") - 1) >= by) & ~F.lit(1.0).between(F.col("least"), F.col("largest")))


# Bounds of the median and of the least (A) or largest (C) pair.
CASES = {"A": (1.25, 1.05), "C": (0.8, 0.95)}


def outcome(ratios: DataFrame) -> DataFrame:
    """Adds class: A, faster by the median with all pairs above a bound; C, slower likewise; B otherwise."""
    a, c = CASES["A"], CASES["C"]
    found = F.when((F.col("median") >= a[0]) & (F.col("least") > a[1]), "A").when((F.col("median") <= c[0]) & (F.col("largest") < c[1]), "C").otherwise("B")
    return ratios.withColumn("class", found)


def majority(outcomes: DataFrame) -> DataFrame:
    """One row: cells of each class, and the class that more than half of all cells have (null: none)."""
    n = outcomes.agg(*(F.count_if(F.col("class") == k).alias(k.lower()) for k in "ABC"))
    half = (F.col("a") + F.col("b") + F.col("c")) / 2
    return n.withColumn("class", F.when(F.col("a") > half, "A").when(F.col("b") > half, "B").when(F.col("c") > half, "C"))


def crossover(ratios: DataFrame, value: str = "median", geometric: tuple[str, ...] = (), linear: tuple[str, ...] = ()) -> DataFrame:
    """One row per subgraph with any ratio: status (crossover, multiple crossings, faster everywhere, slower everywhere), rate at
    the first place where the ratio passes from above 1 to 1 or below or back between adjacent rates (log-linear in both),
    between which rates, whether it is faster below, and the ratio nearest to the other side where nothing crosses. Further
    columns are interpolated there as their logarithm (geometric) or as they are (linear)."""
    w = W.partitionBy("subgraph").orderBy("rate")
    names = ["rate", value, *geometric, *linear]
    step = ratios.filter(F.col(value).isNotNull()).select("subgraph", *names)
    step = step.withColumns({f"{c}_2": F.lead(c).over(w) for c in names}).withColumn("over", F.col(value) > 1)
    turn = F.col("rate_2").isNotNull() & (F.col("over") != (F.col(f"{value}_2") > 1))
    f = F.ln(value) / (F.ln(value) - F.ln(f"{value}_2"))
    log = lambda c: F.ln(F.greatest(F.col(c), F.lit(1e-12)))
    between = {c: F.exp(log(c) + f * (log(f"{c}_2") - log(c))) for c in ("rate", *geometric)} | {c: F.col(c) + f * (F.col(f"{c}_2") - F.col(c)) for c in linear}
    hit = F.struct("rate", F.col("rate_2").alias("upto"), F.col("over").alias("faster_below"), *(x.alias(f"at_{c}") for c, x in between.items()))
    got = step.groupBy("subgraph").agg(F.count(F.lit(1)).alias("n"), F.count_if("over").alias("above"), F.count_if(turn).alias("turns"), F.min(F.when(turn, hit)).alias("hit"), F.max(value).alias("best"), F.min(value).alias("worst"))
    status = F.when(F.col("above") == 0, "slower everywhere").when(F.col("above") == F.col("n"), "faster everywhere").when(F.col("turns") == 1, "crossover").otherwise("multiple crossings")
    return got.select("subgraph", status.alias("status"), F.col("hit.at_rate").alias("rate"), F.col("hit.rate").alias("low"), F.col("hit.upto").alias("high"), F.col("hit.faster_below").alias("faster_below"), F.when(F.col("above") == 0, F.col("best")).when(F.col("above") == F.col("n"), F.col("worst")).alias("nearest"), *(F.col(f"hit.at_{c}").alias(c) for c in (*geometric, *linear)))


def stable_range(points: DataFrame) -> DataFrame:
    """(subgraph, low, high, n, baseline): the widest run of adjacent gains that are STABLE for all seeds; of equally long ones
    the first; baseline is the geometric mean of its ends. points: subgraph, gain, seed, regime."""
    grid = points.groupBy("subgraph", "gain").agg((F.count_if(F.col("regime") != "STABLE") == 0).alias("ok"))
    w = W.partitionBy("subgraph").orderBy("gain")
    islands = grid.withColumn("place", F.row_number().over(w)).filter("ok").withColumn("island", F.col("place") - F.row_number().over(w))
    runs = islands.groupBy("subgraph", "island").agg(F.min("gain").alias("low"), F.max("gain").alias("high"), F.count(F.lit(1)).alias("n"))
    best = runs.groupBy("subgraph").agg(F.max_by(F.struct("low", "high", "n"), F.struct("n", (-F.col("low")).alias("first"))).alias("b")).select("subgraph", "b.*")
    return best.withColumn("baseline", F.sqrt(F.col("low") * F.col("high")))


def cost_model(runs: DataFrame, terms: list[str], measure: str) -> list[float]:
    """Non-negative weights of up to four terms that give the least relative squared error of their sum.

    One aggregate makes the normal equations of rows divided by the measure; with so few terms every set of active ones
    is tried, and the feasible set with the least error is the solution.
    """
    if not 1 <= len(terms) <= 4:
        raise ValueError("one to four terms")
    x = [F.col(t).cast("double") / F.col(measure) for t in terms]
    sums = {f"g{i}{j}": F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))} | {f"b{i}": F.sum(x[i]) for i in range(len(x))}
    row = runs.filter(F.col(measure) > 0).agg(*(v.alias(k) for k, v in sums.items()), F.count(F.lit(1)).alias("n")).first()
    if not row["n"]:
        raise ValueError("no runs")
    gram = np.array([[row[f"g{min(i, j)}{max(i, j)}"] for j in range(len(x))] for i in range(len(x))])
    right = np.array([row[f"b{i}"] for i in range(len(x))])
    best, error = np.zeros(len(x)), float(row["n"])
    for size in range(1, len(x) + 1):
        for active in combinations(range(len(x)), size):
            a = list(active)
            try:
                w = np.linalg.solve(gram[np.ix_(a, a)], right[a])
            except np.linalg.LinAlgError:
                continue
            if (w >= 0).all() and (e := row["n"] - 2 * w @ right[a] + w @ gram[np.ix_(a, a)] @ w) < error - 1e-12:
                best, error = np.zeros(len(x)), e
                best[a] = w
    return best.tolist()


def model_errors(runs: DataFrame, terms: list[str], measure: str, weights: list[float]) -> DataFrame:
    """One row: median, 90th percentile and largest relative error of a cost model."""
    made = sum((F.col(t) * w for t, w in zip(terms, weights)), F.lit(0.0))
    e = F.abs(made / F.col(measure) - 1)
    return runs.filter(F.col(measure) > 0).agg(F.percentile(e, F.lit(0.5)).alias("median"), F.percentile(e, F.lit(0.9)).alias("p90"), F.max(e).alias("largest"))


def cell_statistics(runs: DataFrame, keys: list[str], measure: str) -> DataFrame:
    return runs.groupBy(*keys).agg(F.median(measure).alias("median"), F.min(measure).alias("least"), F.max(measure).alias("largest"), F.count(F.lit(1)).alias("n"))


def geometric_mean(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    return cells.groupBy(*keys).agg(F.exp(F.avg(F.ln(value))).alias("geometric_mean"))


def selected_variant(cells: DataFrame, default: str) -> DataFrame:
    """One row: the variant with the least geometric mean over cells; the default keeps its place in a tie."""
    means = geometric_mean(cells, ["variant"], "median")
    return means.agg(F.min_by("variant", F.struct("geometric_mean", (F.col("variant") != default).alias("other"), "variant")).alias("variant"))


def shares(phases: DataFrame, keys: list[str]) -> DataFrame:
    """Adds share: of the phase's seconds in the run's sum."""
    return phases.withColumn("share", F.try_divide("seconds", F.sum("seconds").over(W.partitionBy(*keys))))


def regimes_by_gain(points: DataFrame) -> DataFrame:
    """(subgraph, gain, regime): the regime all seeds agree on, else `seeds disagree`, and the sorted set of regimes."""
    got = points.groupBy("subgraph", "gain").agg(F.sort_array(F.collect_set("regime")).alias("r"))
    return got.select("subgraph", "gain", F.when(F.size("r") == 1, F.col("r")[0]).otherwise("seeds disagree").alias("regime"), F.array_join("r", ",").alias("regimes"))


def off_window(series: DataFrame, off_from: int) -> DataFrame:
    """Of each run: pulses a step while input is on and in the last third after it ended, first silent step after it ended, all pulses."""
    # A run ends with its own last step; runs of a sweep may be of different length.
    end = series.groupBy("run").agg((F.max("t") + 1).alias("steps"))
    tail = F.col("steps") - tail_steps(F.col("steps"), off_from)
    return series.join(end, "run").groupBy("run").agg(F.avg(F.when(F.col("t") < off_from, F.col("pulses"))).alias("on"), F.coalesce(F.avg(F.when(F.col("t") >= tail, F.col("pulses"))), F.lit(0.0)).alias("late"), F.min(F.when((F.col("t") >= off_from) & (F.col("pulses") == 0), F.col("t"))).alias("first_silent"), F.sum("pulses").alias("pulses"))


def off_probe(series: DataFrame, off_from: int, n: int, dt: float) -> DataFrame:
    """off_window, and of each run: both rates in Hz a node, steps from the end of input to the first silent one, distinct nodes that pulses
    reach in a step (mean and largest), and the largest gap at a step's end between pulses so far and their share of time."""
    hz = lambda c: F.try_divide(F.col(c) * 1000.0, F.lit(n * dt))
    got = off_window(series, off_from)
    got = got.select("*", hz("on").alias("hz_on"), hz("late").alias("hz_late"), (F.col("first_silent") - off_from).alias("silent_after"))
    whole = series.groupBy("run").agg((F.max("t") + 1).alias("steps"), F.sum("pulses").alias("all"), F.avg("targets").alias("targets"), F.max("targets").alias("most_targets"))
    upto = F.sum("pulses").over(W.partitionBy("run").orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow))
    far = series.select("run", "t", upto.alias("upto")).join(whole, "run")
    gap = far.groupBy("run").agg(F.max(F.abs(F.col("upto") - F.col("all") * (F.col("t") + 1) / F.col("steps"))).alias("gap"))
    return got.join(whole.select("run", "targets", "most_targets"), "run").join(gap, "run")


def varint_size(value):
    """Bytes of a non-negative number in groups of seven bits."""
    size = F.lit(1)
    for i in range(1, 9):
        size = F.when(value >= F.lit(1 << (7 * i)), F.lit(i + 1)).otherwise(size)
    return size


def delta_size(edge: DataFrame) -> DataFrame:
    """One row: bytes of all targets as varints of their gaps within each source's ascending row, and of plain 32-bit targets."""
    gap = F.col("dst") - F.coalesce(F.lag("dst").over(W.partitionBy("src").orderBy("dst")), F.lit(0))
    return edge.select(varint_size(gap).alias("b")).agg(F.sum("b").cast("long").alias("delta_bytes"), (4 * F.count(F.lit(1))).alias("plain_bytes"))


def weight_codes(edge: DataFrame) -> DataFrame:
    """One row: largest relative errors of weights as saturated bytes and as eighths of octaves, and how many saturate."""
    w = F.col("weight").cast("double")
    octave = F.pow(F.lit(2.0), F.rint(F.log2(w) * 8) / 8)
    return edge.filter("weight > 0").agg(F.count_if(w > 255).alias("saturated"), F.max(F.abs(F.least(w, F.lit(255.0)) / w - 1)).alias("byte_error"), F.max(F.abs(octave / w - 1)).alias("octave_error"))


def representation_sizes(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """(case, bytes, per_edge): sizes of ways to hold the graph, by formula."""
    n, m = F.col("n"), F.col("m")
    counts = nodes.agg(F.count(F.lit(1)).alias("n")).crossJoin(edge.agg(F.count(F.lit(1)).alias("m"), F.max("weight").alias("top")))
    wide = F.when(F.col("top") < 256, 1).when(F.col("top") < 65536, 2).otherwise(4)
    cases = {"pairs of 64 bits": m * 24, "pairs of 32 bits": m * (8 + wide), "rows": (n + 1) * 8 + m * (4 + wide), "rows and columns": 2 * (n + 1) * 8 + m * (8 + 4 + wide)}
    return counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("case"), v.cast("long").alias("bytes"), (v / m).alias("per_edge")) for k, v in cases.items()))).alias("x")).select("x.*")


def best_ratio(ratios: DataFrame) -> DataFrame:
    """(subgraph, rate, median): the rate with the largest median ratio of each subgraph, of equal ones the smallest rate."""
    return ratios.groupBy("subgraph").agg(F.max_by(F.struct("rate", "median"), F.struct("median", (-F.col("rate")).alias("low"))).alias("b")).select("subgraph", "b.*")


def step_spread(series: DataFrame, key: str) -> DataFrame:
    """(key, t, median, least, largest): pulses of a step over the runs of a key."""
    return series.groupBy(key, "t").agg(F.median("pulses").alias("median"), F.min("pulses").alias("least"), F.max("pulses").alias("largest"))


def equivalence_summary(comparisons: DataFrame, by: str) -> DataFrame:
    """(by, comparisons, identical, largest): of comparisons with different (pulses in one run only) and gap (of potentials)."""
    return comparisons.groupBy(by).agg(F.count(F.lit(1)).alias("comparisons"), F.count_if(F.col("different") == 0).alias("identical"), F.max("gap").alias("largest"))


def set_digest(values: DataFrame, column: str) -> DataFrame:
    """One row: order-independent digest of a column: number, and exclusive or of hashes (for tables of any size)."""
    return values.agg(F.count(column).alias("n"), F.bit_xor(F.xxhash64(column)).alias("digest"))


def _hashed(batches):
    """The SHA-256 of the texts of one partition, joined by commas, without holding them."""
    state, first = hashlib.sha256(), True
    for batch in batches:
        text = ",".join(batch.column(0).to_pylist())
        if batch.num_rows:
            state.update((text if first else "," + text).encode())
            first = False
    yield pa.RecordBatch.from_pydict({"digest": [state.hexdigest()]})


def list_digest(values: DataFrame, column: str) -> DataFrame:
    """One row: SHA-256 of the sorted values joined by commas, nulls left out.

    This hash takes its input in order, so one task reads the values as Spark sorts (and spills) them, and holds a batch.
    """
    ship(values.sparkSession)
    some = values.select(column).filter(F.col(column).isNotNull()).repartition(1).sortWithinPartitions(column)
    got = some.select(F.col(column).cast("string").alias("text")).mapInArrow(_hashed, "digest string")
    return got.agg(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("digest"))


#: Variants of a configuration for sensitivity runs: what each changes.
SENSITIVITY = {
    "baseline": {}, "tau_short": {"tau": 10.0}, "tau_long": {"tau": 40.0}, "no_hold": {"refractory": 0}, "long_hold": {"refractory": 8}, "delay_2": {"delay": 2}, "delay_5": {"delay": 5}, "low_threshold": {"theta": 0.8},
    "high_threshold": {"theta": 1.2}, "weak_input": {"input_weight": 1.0}, "strong_input": {"input_weight": 4.0}, "low_reset": {"reset": -0.5}, "fine_step": {"dt": 0.5}, "linear": {"how": "linear"}, "sqrt": {"how": "sqrt"}, "clipped": {"how": "clipped"},
}
