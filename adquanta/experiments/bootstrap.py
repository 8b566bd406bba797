"""Poisson bootstrap: resampling weights drawn per row and replicate."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from adquanta.session import discard, stage

from .spec import ExperimentSpec, all_metrics

# Prime modulus and two multipliers of well-studied
# multiplicative congruential generators.
PRIME = 2**31 - 1
MULTIPLIERS = (48271, 69621)


def poisson_limits() -> list[int]:
    """Uniform integers below limit k mean a Poisson(1) weight of at most k."""
    limits, cdf = [], 0.0
    for k in range(10):
        cdf += math.exp(-1) / math.factorial(k)
        limits.append(int(cdf * PRIME))
    return limits


def row_numbers(row_id: Column | str) -> list[Column]:
    """Two numbers of 28 bits from the digest of a row's id."""
    digest = F.md5(F.col(row_id) if isinstance(row_id, str) else row_id)
    return [F.conv(F.substring(digest, start, 7), 16, 10).cast("bigint") + 1 for start in (1, 8)]


def _steps(replicates: int, seed: int) -> list[list[int]]:
    """Powers of the multipliers, one pair of factors per replicate."""
    return [[pow(m, s, PRIME) for s in range(seed + 1, seed + replicates + 1)]
            for m in MULTIPLIERS]


def _drawer(replicates: int, seed: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that gives the weights (rows x replicates) of rows by their two numbers."""
    p, q = (np.array(s, dtype=np.uint64) for s in _steps(replicates, seed))
    limits = np.array([k for k in poisson_limits() if k < PRIME], dtype=np.uint32)
    common = 5  # higher weights are one draw in seventeen hundred
    block = max(1, 65_536 // replicates)  # rows whose draws fit a core's cache

    def draw(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), replicates))
        x, y = (np.mod(v, PRIME).astype(np.uint64)[:, None] for v in (x, y))
        u, other = np.empty((2, block, replicates), dtype=np.uint64)
        v, less = np.empty((2, block, replicates), dtype=np.uint32)
        for i in range(0, len(x), block):
            n = min(block, len(x) - i)
            u, other, v, less = u[:n], other[:n], v[:n], less[:n]
            np.multiply(x[i:i + n], p, out=u)
            np.multiply(y[i:i + n], q, out=other)
            u += other
            # Modulo 2^31 - 1 the bits above the 31st count once more from the first.
            # Sums of numbers of 28 and 31 bits need this once, and a subtraction.
            for _ in range(1 if n and max(x[i:i + n].max(), y[i:i + n].max()) <= 2**28 else 2):
                np.right_shift(u, np.uint64(31), out=other)
                u &= np.uint64(PRIME)
                u += other
            np.copyto(v, u, casting="unsafe")
            np.subtract(v, np.uint32(PRIME), out=less)  # wraps round where v is smaller
            np.minimum(v, less, out=v)
            weight = (v >= limits[0]).view(np.uint8)
            for limit in limits[1:common]:
                weight += (v >= limit).view(np.uint8)
            high = np.flatnonzero(v >= limits[common])
            weight.ravel()[high] += np.searchsorted(
                limits[common:], v.ravel()[high], "right").astype(np.uint8)
            out[i:i + n] = weight
        return out

    return draw


def replicated(rows: DataFrame, replicates: int, row_id: str = "row_id",
               seed: int = 0) -> DataFrame:
    """One row per (input row, replicate) with a positive ``weight``.

    Replicate ``r`` of a row takes step ``seed + r + 1`` of two generators
    started from the row's digest, so weights depend on the id alone: they
    are the same however rows are partitioned, retried or joined.
    """
    p, q = _steps(replicates, seed)
    first, second = (F.array(*[F.lit(v).cast("bigint") for v in steps]) for steps in (p, q))
    x, y = row_numbers(row_id)
    drawn = rows.withColumns({"_x": x, "_y": y}).select(
        *rows.columns, "_x", "_y", F.posexplode(first).alias("replicate", "_p"))
    step = F.element_at(second, F.col("replicate") + 1)
    u = (F.col("_x") * F.col("_p") + F.col("_y") * step) % F.lit(PRIME)
    # At or above the first limit the weight is at least 1; filtering on that
    # alone keeps the filter to one comparison.
    first_limit, *limits = poisson_limits()
    weight = sum(((F.col("_u") >= F.lit(k)).cast("int") for k in limits), F.lit(1))
    return (
        drawn.withColumn("_u", u)
        .where(F.col("_u") >= F.lit(first_limit))
        .withColumn("weight", weight)
        .drop("_x", "_y", "_p", "_u")
    )


def weighted_sums(rows: DataFrame, keys: list[str], columns: list[str], replicates: int,
                  row_id: str = "row_id", seed: int = 0) -> DataFrame:
    """Sums of weight * column per (keys, replicate), with the weights above.

    Exploding each row costs an aggregate update per row and replicate. Here a
    task draws the weights of a few hundred rows at a time, once for a row
    however many keys it belongs to, and adds the products with the columns to
    one small array per key. Rows that belong to the same keys stand together,
    so that one product serves all their keys. It needs memory for keys *
    replicates * columns only and sends as many rows to the final sum. The number
    of distinct keys must be bounded, as that of arms is.
    """
    draw = _drawer(replicates, seed)
    chunk = max(1, 500_000 // replicates)
    n_keys, width = len(keys), len(columns)

    def partial(batches):
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            frame = batch.to_pandas()
            if frame.empty:
                continue
            group = frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            firsts = np.unique(group, return_index=True)[1]
            names = list(frame[keys].iloc[firsts].itertuples(index=False, name=None))
            found = frame.groupby(["_x", "_y"], sort=False, dropna=False)
            row = found.ngroup().to_numpy()
            x, y = frame[["_x", "_y"]].to_numpy(np.int64)[np.unique(row, return_index=True)[1]].T
            # Row by key: whether it belongs, and the sums of its columns there.
            cell, cells = row * len(names) + group, (len(x), len(names))
            belongs = np.bincount(cell, minlength=math.prod(cells)).reshape(cells) > 0
            sums = np.stack([np.bincount(cell, frame[c].to_numpy(np.float64), math.prod(cells)).reshape(cells)
                             for c in columns], axis=2)
            alike = np.unique(np.packbits(belongs, axis=1), axis=0, return_inverse=True)[1].ravel()
            order = np.argsort(alike, kind="stable")
            for i in range(0, len(order), chunk):
                here = order[i:i + chunk]
                weights = draw(x[here], y[here])
                cuts = np.flatnonzero(np.diff(alike[here])) + 1
                for low, high in zip([0, *cuts], [*cuts, len(here)]):
                    own = np.flatnonzero(belongs[here[low]])
                    added = sums[here[low:high]][:, own].reshape(high - low, -1).T @ weights[low:high]
                    for k, part in zip(own, added.reshape(len(own), width, replicates)):
                        totals.setdefault(names[k], np.zeros((width, replicates)))
                        totals[names[k]] += part
        some = max(1, 100_000 // replicates)
        names = list(totals)
        for i in range(0, len(names), some):
            part = names[i:i + some]
            out = pd.DataFrame(np.concatenate([totals[n].T for n in part]), columns=columns)
            for k, column in enumerate(keys):
                out[column] = [n[k] for n in part for _ in range(replicates)]
            out["replicate"] = np.tile(np.arange(replicates, dtype=np.int32), len(part))
            yield pa.RecordBatch.from_pandas(
                out[[*keys, "replicate", *columns]], schema=result, preserve_index=False)

    x, y = row_numbers(row_id)
    given = rows.select(*keys, x.alias("_x"), y.alias("_y"),
                        *[F.col(c).cast("double").alias(c) for c in columns])
    schema = StructType([
        *given.schema.fields[:n_keys], StructField("replicate", IntegerType()),
        *[StructField(c, DoubleType()) for c in columns]])
    result = to_arrow_schema(schema)
    return given.mapInArrow(partial, schema).groupBy(*keys, "replicate").agg(
        *[F.sum(c).alias(c) for c in columns])


def _units(member_rows: DataFrame, metrics: Sequence[str], cells: int | None) -> DataFrame:
    """Resampling units with the sum and count of each metric.

    A unit is a row, or with ``cells`` one of that many random groups of rows
    per arm. All rows count either way; groups make the work after one
    aggregate independent of the number of rows.
    """
    parts = {m: (F.coalesce(F.col(m), F.lit(0.0)), F.col(m).isNotNull().cast("bigint"))
             for m in metrics}
    if cells is None:
        return member_rows.select(
            "experiment", "arm", "row_id",
            *[c.alias(f"{m}_{end}") for m, both in parts.items()
              for c, end in zip(both, ("sum", "count"))])
    cell = F.pmod(F.xxhash64("row_id"), F.lit(cells)).cast("string")
    return member_rows.groupBy("experiment", "arm", cell.alias("row_id")).agg(
        *[F.sum(c).alias(f"{m}_{end}") for m, both in parts.items()
          for c, end in zip(both, ("sum", "count"))])


def replicate_means(member_rows: DataFrame, specs: Sequence[ExperimentSpec],
                    replicates: int = 2000, cells: int | None = None,
                    seed: int = 0) -> DataFrame:
    """Mean of each metric per (experiment, metric, arm, replicate).

    A task sends at most replicates * arms rows to the final sum however many
    rows it read.
    """
    metrics = all_metrics(specs)
    units = _units(member_rows, metrics, cells)
    columns = [f"{m}_{end}" for m in metrics for end in ("sum", "count")]
    sums = weighted_sums(units, ["experiment", "arm"], columns, replicates, seed=seed)
    means = F.array(*[
        F.struct(F.lit(m).alias("metric"),
                 F.try_divide(F.col(f"{m}_sum"), F.col(f"{m}_count")).alias("stat"))
        for m in metrics
    ])
    wanted = F.lit(False)
    for s in specs:
        wanted = wanted | ((F.col("experiment") == s.name) & F.col("metric").isin(list(s.metrics)))
    return sums.select("experiment", "arm", "replicate", F.inline(means)).where(wanted)


def replicate_medians(long: DataFrame, replicates: int = 2000, seed: int = 0,
                      width: float = 7.0) -> DataFrame:
    """Weighted median per (experiment, metric, arm, replicate).

    A replicate's median is a value of the sample whose rank is a few square
    roots of n from the middle. A sketch proposes an interval of ``width``
    such steps on both sides for each arm. One pass adds up each replicate's
    weight below it, in all, and at the few values inside that more rows share
    than half the interval should hold. Then these sums and the other rows
    inside, whose number grows with the square root of n however many are tied,
    meet per arm, and their running weights give the medians. An interval that
    misses a median of any replicate is noticed and doubled.
    """
    keys = ["experiment", "metric", "arm"]
    arms = long.groupBy(*keys).count().collect()  # as many as the specs declare
    if not arms:
        return long.select(*keys, F.lit(0).alias("replicate"), F.col("value").alias("stat"))
    # One sketch per arm, as fine as the largest arm needs it; each arm takes its own two shares.
    away = {n: min(0.5, width / math.sqrt(n)) for n in {a["count"] for a in arms}}
    shares = sorted({0.5 + side * d for d in away.values() for side in (-1, 1)})
    finest = math.ceil(10 * math.sqrt(max(away)))
    ends = {tuple(e[k] for k in keys): dict(zip(shares, e["ends"])) for e in long.groupBy(*keys).agg(
        F.percentile_approx("value", F.array(*[F.lit(p) for p in shares]), F.lit(finest)).alias("ends")).collect()}
    spark = long.sparkSession
    bounds = spark.createDataFrame(
        [(*arm, *[ends[arm][0.5 + side * away[n]] for side in (-1, 1)], math.ceil(width * math.sqrt(n)))
         for arm, n in ((tuple(a[k] for k in keys), a["count"]) for a in arms)],
        "experiment string, metric string, arm string, lower double, upper double, many bigint")
    # One row per arm of a declared hypothesis.
    placed = long.select(*keys, "row_id", "value").join(F.broadcast(bounds), keys)
    within = F.col("value").between(F.col("lower"), F.col("upper"))
    # About 2 * many rows lie between the ends, so an arm has a few such values at most.
    ties: dict[tuple, list[float]] = {tuple(a[k] for k in keys): [] for a in arms}
    for r in placed.where(within).groupBy(*keys, "value", "many").count().where("count > many").collect():
        ties[tuple(r[k] for k in keys)].append(r["value"])
    listed = spark.createDataFrame(
        [(*arm, values) for arm, values in ties.items()],
        "experiment string, metric string, arm string, ties array<double>")
    # The place of a row's value among the tied ones of its arm, from 1; 0 for other values.
    placed = placed.join(F.broadcast(listed), keys).withColumn(
        "tie", F.array_position("ties", F.col("value")))
    total = weighted_sums(
        placed.select(*keys, "tie", "row_id", F.lit(1.0).alias("total"),
                      (F.col("value") < F.col("lower")).cast("double").alias("skip")),
        [*keys, "tie"], ["total", "skip"], replicates, seed=seed)
    x, y = row_numbers("row_id")
    inside = placed.where(within & (F.col("tie") == 0)).select(
        *keys, "value", x.alias("_x"), y.alias("_y"))
    draw = _drawer(replicates, seed)

    def medians(arm: tuple, rows: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("value")
        value = rows["value"].to_numpy()
        px, py = rows["_x"].to_numpy(np.int64), rows["_y"].to_numpy(np.int64)
        weights = sums.pivot(index="replicate", columns="tie", values="total").fillna(0.0).sort_index()
        weights = weights[weights.sum(axis=1) > 0]
        which = weights.index.to_numpy()
        rank = (weights.sum(axis=1).to_numpy() - 1) / 2
        skip = sums.groupby("replicate")["skip"].sum().loc[which].to_numpy()
        step = max(1, 4_000_000 // replicates)

        def blocks():
            """Values in ascending order with their weights in each replicate."""
            low = 0
            for tied, place in sorted((v, i + 1) for i, v in enumerate(ties[arm])) + [(math.inf, 0)]:
                high = np.searchsorted(value, tied) if place else len(value)
                for i in range(low, high, step):
                    to = min(i + step, high)
                    yield value[i:to], draw(px[i:to], py[i:to])[:, which]
                if place:
                    yield np.array([tied]), weights[place].to_numpy()[None, :]
                low = high

        upto, found = skip.copy(), np.full((2, len(which)), np.nan)
        for here, weight in blocks():
            running = upto + np.cumsum(weight, axis=0)
            for end, wanted in enumerate((np.floor(rank), np.ceil(rank))):
                at = (running <= wanted).sum(0)  # rows before the wanted rank
                hit = np.isnan(found[end]) & (at < len(running)) & (wanted >= skip)
                found[end][hit] = here[at[hit]]
            upto = running[-1]
        return pd.DataFrame({"experiment": arm[0], "metric": arm[1], "arm": arm[2],
                             "replicate": which, "stat": found.mean(0)})

    stats = stage(inside.groupBy(*keys).cogroup(total.groupBy(*keys)).applyInPandas(
        medians, "experiment string, metric string, arm string, replicate int, stat double"), "medians")
    if stats.where(F.col("stat").isNull() | F.isnan("stat")).limit(1).count():
        discard(stats)
        return replicate_medians(long, replicates, seed, 2 * width)
    return stats


def replicate_statistic(long: DataFrame, stat: Callable[[str, str], Column],
                        replicates: int = 2000, seed: int = 0) -> DataFrame:
    """Any statistic per (experiment, metric, arm, replicate).

    ``stat`` gets the names of the value and weight columns and returns an
    aggregate column. Rows are drawn one by one, and combined before the
    shuffle if the aggregate allows it.
    """
    rows = long.select("experiment", "metric", "arm", "row_id", "value")
    return replicated(rows, replicates, seed=seed).groupBy(
        "experiment", "metric", "arm", "replicate").agg(stat("value", "weight").alias("stat"))


def arm_intervals(stats: DataFrame, level: float = 0.95) -> DataFrame:
    """Percentile interval of the statistic per (experiment, metric, arm)."""
    return stats.groupBy("experiment", "metric", "arm").agg(
        _interval("stat", level).alias("ci"))


def difference_intervals(stats: DataFrame, level: float = 0.95) -> DataFrame:
    """Percentile interval of b - a and of both arms per (experiment, metric)."""
    per_replicate = stats.groupBy("experiment", "metric", "replicate").agg(
        F.max(F.when(F.col("arm") == "a", F.col("stat"))).alias("a"),
        F.max(F.when(F.col("arm") == "b", F.col("stat"))).alias("b"),
    ).withColumn("diff", F.col("b") - F.col("a"))
    return per_replicate.groupBy("experiment", "metric").agg(
        _interval("diff", level).alias("_diff"),
        _interval("a", level).alias("ci_a"), _interval("b", level).alias("ci_b"),
    ).select(
        "experiment", "metric",
        F.col("_diff")[0].alias("ci_lower"), F.col("_diff")[1].alias("ci_upper"),
        ((F.col("_diff")[0] > 0) | (F.col("_diff")[1] < 0)).alias("ci_excludes_zero"),
        "ci_a", "ci_b",
    )


def _interval(stat: str, level: float) -> Column:
    """Both ends over the replicates of a group, whose number is a parameter."""
    tail = (1 - level) / 2
    return F.percentile(stat, F.array(F.lit(tail), F.lit(1 - tail)))
