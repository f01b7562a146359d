"""Statistics of samples and scores: intervals, bootstrap, placebo tails, ranking metrics, distribution distances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Z95 = 1.959963984540054


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper end of the score interval."""
    n = n.cast("double")
    miss = n - successes
    # all terms times n: the centre is k + z^2 / 2, the width z sqrt(k (n - k) / n + z^2 / 4)
    centre, half = successes + z * z / 2, F.lit(z) * F.sqrt(successes * miss / n + z * z / 4)
    return (centre - half) / (n + z * z), (centre + half) / (n + z * z)


def _cut(scored: DataFrame) -> DataFrame:
    """score, pos, n with running sums from the top: equal scores are one row, so the window is over distinct scores."""
    rows = scored.groupBy("score").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("score", "pos", "n", F.sum("pos").over(upto).alias("tp"), F.sum("n").over(upto).alias("kept"))


def average_precision(scored: DataFrame) -> DataFrame:
    """average_precision of (score, label 0/1): precision at each distinct score, weighted by the recall it adds."""
    total = scored.agg(F.sum("label").alias("total"))
    rows = _cut(scored).crossJoin(F.broadcast(total))  # one row
    return rows.agg(F.sum(F.col("pos") / F.col("total") * F.col("tp") / F.col("kept")).alias("average_precision"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """roc_auc by mean ranks of distinct scores."""
    rows = scored.groupBy("score").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
    below = F.coalesce(F.sum(F.col("n") - F.col("pos")).over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    neg = F.col("n") - F.col("pos")
    won = rows.select("pos", neg.alias("neg"), (F.col("pos") * (below + neg / 2)).alias("won"))
    return won.agg((F.sum("won") / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"))


def precision_at_retention(scored: DataFrame, retention: float) -> DataFrame:
    """precision, kept at the highest score that keeps ``retention`` of the positives, rounded up."""
    total = scored.agg(F.sum("label").alias("total"))
    rows = _cut(scored).crossJoin(F.broadcast(total)).where(F.col("tp") >= F.greatest(F.ceil(F.col("total") * F.lit(retention)), F.lit(1)))
    best = rows.agg(F.max_by(F.struct("tp", "kept"), "score").alias("b"))
    return best.select((F.col("b.tp") / F.col("b.kept")).alias("precision"), F.col("b.kept").alias("kept"))


def retention_curve(scored: DataFrame, retentions: list[float]) -> DataFrame:
    parts = [precision_at_retention(scored, r).select(F.lit(r).alias("retention"), "precision", "kept") for r in retentions]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def agreement(rows: DataFrame, a: str, b: str, positive: str) -> DataFrame:
    """n, exact, binary (both positive or neither) and kappa of two label columns."""
    pair = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    same = F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0))
    binary = F.sum(F.when((F.col(a) == positive) == (F.col(b) == positive), F.col("n")).otherwise(0))
    base = pair.agg(total.alias("n"), (same / total).alias("exact"), (binary / total).alias("binary"))
    left = pair.groupBy(F.col(a).alias("l")).agg(F.sum("n").alias("x"))
    right = pair.groupBy(F.col(b).alias("l")).agg(F.sum("n").alias("y"))
    chance = left.join(right, "l").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("c"))
    by_chance = F.col("c") / (F.col("n") * F.col("n"))
    return base.crossJoin(chance).select("n", "exact", "binary", ((F.col("exact") - by_chance) / F.nullif(1 - by_chance, F.lit(0.0))).alias("kappa"))


def brier(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg((F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))).alias("brier"))


def calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    """ece: gaps between mean score and positive share of equal-width bins, weighted by their rows."""
    place = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    rows = scored.groupBy(place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("s"), F.avg(F.col("label").cast("double")).alias("y")
    )
    return rows.agg((F.sum(F.col("n") * F.abs(F.col("s") - F.col("y"))) / F.sum("n")).alias("ece"))


def distribution(rows: DataFrame, value: str) -> DataFrame:
    """value, n, share."""
    counted = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return counted.crossJoin(F.broadcast(total)).select(value, "n", (F.col("n") / F.col("total")).alias("share"))


def total_variation(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """tv: half the summed differences of two distributions' shares, over all values of either."""
    p = distribution(a, value).select(value, F.col("share").alias("p"))
    q = distribution(b, value).select(value, F.col("share").alias("q"))
    gap = F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))
    return p.join(q, value, "full").agg((F.sum(gap) * 0.5).alias("tv"))


def set_overlap(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """n_a, n_b, both, share of a's distinct rows (keys) that b has too."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    sides = x.select(*keys, F.lit(1).alias("ina"), F.lit(0).alias("inb")).unionAll(
        y.select(*keys, F.lit(0).alias("ina"), F.lit(1).alias("inb"))
    )
    rows = sides.groupBy(*keys).agg(F.max("ina").alias("ina"), F.max("inb").alias("inb"))
    out = rows.agg(
        F.sum("ina").alias("n_a"),
        F.sum("inb").alias("n_b"),
        F.count_if((F.col("ina") == 1) & (F.col("inb") == 1)).alias("both"),
    )
    return out.withColumn("share", F.col("both") / F.greatest("n_a", F.lit(1)))


# -- resampling
def bootstrap(rows: DataFrame, value: str, key: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """mean, lo, hi: percentile interval of the mean of ``value``, resampled by Poisson weights.

    Each row draws a weight for every round from a generator seeded by its key, inside one Arrow batch; a task sends on
    sums a round, so what is shuffled is rounds by tasks. Paired gaps are intervals of a difference column.
    """

    def run(batches):
        weights, sums = np.zeros(rounds), np.zeros(rounds)
        for pdf in batches:
            for v, h in zip(pdf["v"].to_numpy(), pdf["h"].to_numpy()):
                draw = np.random.Generator(np.random.PCG64([seed, int(h) & (2**63 - 1)])).poisson(1.0, rounds)
                weights += draw
                sums += draw * v
        yield pd.DataFrame({"round": np.arange(rounds), "w": weights, "s": sums})

    source = rows.select(F.col(value).cast("double").alias("v"), F.xxhash64(key).alias("h")).where("v is not null")
    per_round = source.mapInPandas(run, "round long, w double, s double").groupBy("round").agg(
        F.sum("w").alias("w"), F.sum("s").alias("s")
    )
    means = per_round.where("w > 0").agg(
        F.percentile(F.col("s") / F.col("w"), 0.025).alias("lo"), F.percentile(F.col("s") / F.col("w"), 0.975).alias("hi")
    )
    return rows.agg(F.avg(value).alias("mean")).crossJoin(means)


def detection_tail(chances: list[float], observed: int) -> float:
    """P(at least ``observed`` detections) when each has its own chance: the exact Poisson-binomial tail."""
    p = np.ones(1)
    for c in chances:
        p = np.convolve(p, [1 - c, c])
    return float(p[observed:].sum())


def permutation_p(series: np.ndarray, weeks: list[int], rounds: int = 10_000, seed: int = 42) -> tuple[float, float]:
    """(mean of the series at the weeks, share of random week sets with at least that mean). A series is a calendar."""
    rng = np.random.default_rng(seed)
    observed = float(np.mean(series[weeks]))
    drawn = series[rng.integers(0, len(series), (rounds, len(weeks)))].mean(1)
    return observed, float((drawn >= observed).mean())


def seed_spread(rows: DataFrame) -> DataFrame:
    """arm, mean (over queries, of the seeds' mean) and spread (largest less smallest seed mean) of (arm, seed, query, rr)."""
    query = rows.groupBy("arm", "query").agg(F.avg("rr").alias("rr")).groupBy("arm").agg(F.avg("rr").alias("mean"))
    seeds = rows.groupBy("arm", "seed").agg(F.avg("rr").alias("m")).groupBy("arm").agg((F.max("m") - F.min("m")).alias("spread"))
    return query.join(seeds, "arm")


def paired_gap(rows: DataFrame, a: str, b: str) -> DataFrame:
    """query, gap: seed-averaged reciprocal rank of arm a less that of arm b, of queries that both have."""
    mean = rows.groupBy("query").agg(
        F.avg(F.when(F.col("arm") == a, F.col("rr"))).alias("x"), F.avg(F.when(F.col("arm") == b, F.col("rr"))).alias("y")
    )
    return mean.where("x is not null and y is not null").select("query", (F.col("x") - F.col("y")).alias("gap"))
