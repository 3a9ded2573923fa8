"""Paired tests, intervals, corrections and percentiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mcnemar(fixed: Column, broken: Column) -> Column:
    """Exact two-sided p value; the binomial terms are summed from their logarithms, so large counts do not underflow."""
    m, low = fixed + broken, F.least(fixed, broken)
    first = -m * F.log(F.lit(2.0))
    step = lambda s, i: F.struct((s["t"] + F.when(i > 0, F.log((m - i + 1) / F.greatest(i, F.lit(1)))).otherwise(0.0)).alias("t"), s["sum"].alias("sum"))
    add = lambda s, i: F.struct(step(s, i)["t"].alias("t"), (s["sum"] + F.exp(step(s, i)["t"])).alias("sum"))
    start = F.struct(first.cast("double").alias("t"), F.lit(0.0).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(0), low.cast("int")), start, add, lambda s: s["sum"])
    return F.when(m == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total))


def paired_summary(compared: DataFrame, by: list[str] = ()) -> DataFrame:
    """n, base, other, delta, fixed, broken, mcnemar_p of compared hits, overall or by group."""
    fixed, broken = (F.sum((F.col("outcome") == x).cast("long")) for x in ("fixed", "broken"))
    rows = compared.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("base_hit").alias("base"), F.avg("other_hit").alias("other"), fixed.alias("fixed"), broken.alias("broken"))
    return rows.select(*by, "n", F.round("base", 6).alias("base"), F.round("other", 6).alias("other"), F.round(F.col("other") - F.col("base"), 6).alias("delta"), "fixed", "broken", F.round(mcnemar(F.col("fixed"), F.col("broken")), 6).alias("mcnemar_p"))


def poisson(mean: Column, u: Column, v: Column) -> Column:
    """A Poisson number from two uniform ones: by inversion, or as a rounded normal number where the mean is above 500."""
    z = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
    normal = F.greatest(F.round(mean + F.sqrt(mean) * z), F.lit(0.0))
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("upto"), F.lit(0.0).alias("k"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * mean / i
        return F.struct(p.alias("p"), (s["upto"] + p).alias("upto"), F.when(s["upto"] < u, i.cast("double")).otherwise(s["k"]).alias("k"))

    most = (F.least(mean, F.lit(500.0)) + 9 * F.sqrt(F.least(mean, F.lit(500.0))) + 9).cast("int")
    return F.when(mean > 500, normal).otherwise(F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["k"]))


def bootstrap_interval(compared: DataFrame, rounds: int = 1000, seed: int = 0, by: list[str] = ()) -> DataFrame:
    """by, low, high: 95 % interval of the mean difference by Poisson bootstrap, overall or by group.

    Questions of one difference (it is -1, 0 or 1) are drawn together: as often, in each round, as a Poisson number whose mean is their
    count, from a hash of the difference and the round. So three rows a round and group are drawn, however many questions there are.
    """
    counts = compared.groupBy(*by, (F.col("other_hit") - F.col("base_hit")).alias("d")).agg(F.count(F.lit(1)).cast("double").alias("m"))
    rows = counts.select(*by, "d", "m", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    u, v = ((F.pmod(F.xxhash64("d", "round", F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 0.5) / float(1 << 40) for k in (1, 2))
    means = rows.withColumn("w", poisson(F.col("m"), u, v)).groupBy(*by, "round").agg((F.sum(F.col("w") * F.col("d")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    return means.groupBy(*by).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def paired_with_interval(compared: DataFrame, by: list[str] = (), rounds: int = 1000, seed: int = 0) -> DataFrame:
    """``paired_summary`` with low and high of the difference."""
    summary, interval = paired_summary(compared, by), bootstrap_interval(compared, rounds, seed, by)
    return summary.join(interval, list(by)) if by else summary.crossJoin(interval)  # one row each


def holm(tests: DataFrame) -> DataFrame:
    """name, p, adjusted: Holm's correction over a table of tests."""
    order = Window.orderBy("p", "name")
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rows = tests.withColumn("raw", F.col("p") * (n - F.row_number().over(order) + 1))
    return rows.select("name", "p", F.least(F.lit(1.0), F.max("raw").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("adjusted"))


def standard_error(p: Column, n: Column) -> Column:
    return F.sqrt(p * (1 - p) / n)


def nearest_rank(rows: DataFrame, value: str, percents: list[int], by: list[str]) -> DataFrame:
    """Values at place min(n - 1, n * p // 100) of each group in order, and its largest; equal values are counted first."""
    counted = rows.groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("m")).filter("v is not null")
    upto = F.sum("m").over(Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.select(*by, "v", "m", upto.alias("upto"), F.sum("m").over(Window.partitionBy(*by)).alias("n"))
    place = lambda p: F.least(F.col("n") - 1, F.floor(F.col("n") * p / 100))
    picks = [F.max(F.when((place(p) >= F.col("upto") - F.col("m")) & (place(p) < F.col("upto")), F.col("v"))).alias(f"p{p}") for p in percents]
    return placed.groupBy(*by).agg(*picks, F.max("v").alias("top"))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n, agreement, kappa of two judgements of the same rows, from the counts of pairs of judgements."""
    pairs = rows.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("m"))
    sides = pairs.select("m", F.explode(F.array(F.struct(F.lit("x").alias("side"), F.col("x").alias("v")), F.struct(F.lit("y").alias("side"), F.col("y").alias("v")))).alias("s"))
    margin = sides.groupBy("s.v").agg(F.sum(F.when(F.col("s.side") == "x", F.col("m")).otherwise(0)).alias("x"), F.sum(F.when(F.col("s.side") == "y", F.col("m")).otherwise(0)).alias("y"))
    chance = margin.agg((F.sum(F.col("x") * F.col("y")) / F.sum("x") / F.sum("x")).alias("chance"), F.lit(0).alias("_k"))
    found = pairs.agg(F.sum("m").alias("n"), (F.sum(F.when(F.col("x") == F.col("y"), F.col("m")).otherwise(0)) / F.sum("m")).alias("agreement"), F.lit(0).alias("_k"))
    return found.join(chance, "_k").select("n", "agreement", ((F.col("agreement") - F.col("chance")) / (1 - F.col("chance"))).alias("kappa"))


def by_quartile(rows: DataFrame, value: str):
    """The rows grouped by ``bin``, the quartile of a value: 1 to 4, edges to the lower one."""
    edges = rows.agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_e"), F.lit(0).alias("_k"))
    v, e = F.col(value), F.col("_e")
    placed = rows.withColumn("_k", F.lit(0)).join(F.broadcast(edges), "_k")
    return placed.groupBy(F.when(v <= e[0], 1).when(v <= e[1], 2).when(v <= e[2], 3).otherwise(4).alias("bin"))


def gate(compared: DataFrame, group: str, least: float = 0.02) -> DataFrame:
    """delta, large (at least ``least``), better (more fixed than broken), no_worse_label (no group loses)."""
    per = compared.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("base_hit").alias("b"), F.sum("other_hit").alias("o"), F.sum((F.col("outcome") == "fixed").cast("long")).alias("f"), F.sum((F.col("outcome") == "broken").cast("long")).alias("k"))
    whole = per.agg(F.round((F.sum("o") - F.sum("b")) / F.sum("n"), 6).alias("delta"), F.sum("f").alias("f"), F.sum("k").alias("k"), F.min(F.col("o") - F.col("b")).alias("worst"))
    return whole.select("delta", (F.col("delta") >= least).alias("large"), (F.col("f") > F.col("k")).alias("better"), F.coalesce(F.col("worst") >= 0, F.lit(False)).alias("no_worse_label"))


def decide(runs: DataFrame, controls: DataFrame, heldout: DataFrame, group: str = "law", least: float = 0.02, level: float = 0.05, rounds: int = 1000) -> DataFrame:
    """One row per variant with the tests that a change must pass, and whether it passes them all (accepted).

    ``runs`` has compared hits (base_hit, other_hit, outcome) of questions with their variant, seed and ``group``; ``controls`` (seed, base_hit, other_hit)
    those of repeated runs without a change; ``heldout`` (variant, base_hit, other_hit) those over questions that nothing was chosen on.

    large: the mean difference of the seeds is at least ``least``. beyond_seeds: it is larger than the range of the controls' differences.
    above_zero: the lower end of every seed's interval is. significant: the exact p of the seed that is worst for it, corrected for the number of variants
    (Holm), is below ``level``. stable: the mean of the groups' means rises, and no group is significantly worse (worse_groups). general:
    the difference over the held-out questions is above 0. What cannot be told for want of rows is not passed.
    """
    per_seed = paired_with_interval(runs, ["variant", "seed"], rounds)
    variants = per_seed.groupBy("variant").agg(F.round(F.avg("delta"), 6).alias("delta"), F.min("low").alias("low"), F.max("mcnemar_p").alias("p"))
    corrected = holm(variants.select(F.col("variant").alias("name"), "p")).select(F.col("name").alias("variant"), F.col("adjusted").alias("p_adjusted"))
    control = controls.groupBy("seed").agg(F.avg(F.col("other_hit") - F.col("base_hit")).alias("_d")).agg(F.round(F.max("_d") - F.min("_d"), 6).alias("seed_range"))
    groups = paired_summary(runs, ["variant", group])
    worse = ((F.col("broken") > F.col("fixed")) & (F.col("mcnemar_p") < level)).cast("long")
    macro = groups.groupBy("variant").agg(F.round(F.avg("base"), 6).alias("macro_base"), F.round(F.avg("other"), 6).alias("macro_other"), F.sum(worse).alias("worse_groups"))
    other = heldout.groupBy("variant").agg(F.round(F.avg(F.col("other_hit") - F.col("base_hit")), 6).alias("heldout_delta"))
    rows = variants.join(corrected, "variant").join(macro, "variant").join(other, "variant", "left").crossJoin(control)  # one row of controls
    tests = {
        "large": F.col("delta") >= least,
        "beyond_seeds": F.col("delta") > F.col("seed_range"),
        "above_zero": F.col("low") > 0,
        "significant": F.col("p_adjusted") < level,
        "stable": (F.col("macro_other") > F.col("macro_base")) & (F.col("worse_groups") == 0),
        "general": F.col("heldout_delta") > 0,
    }
    rows = rows.withColumns({name: F.coalesce(test, F.lit(False)) for name, test in tests.items()})
    accepted = F.col("large")
    for name in list(tests)[1:]:
        accepted &= F.col(name)
    return rows.withColumn("accepted", accepted)
