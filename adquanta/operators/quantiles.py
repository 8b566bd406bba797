"""Exact and approximate quantiles without gathering a column in one task."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adquanta.functions.safe import present

# Half width, as a share of the rows, of the first interval around a quantile.
BRACKET = 1e-4
# Rows between two proposed values that one exact aggregate may hold.
HELD_ROWS = 500_000
# Rows that share a value range.
RANGE_ROWS = 1_000_000


def approximate_quantile(value: str | Column, p: float, relative_error: float = 0.05) -> Column:
    """Quantile sketch as an aggregate column; rank error at most n * error."""
    return F.percentile_approx(value, F.lit(p), F.lit(math.ceil(1 / relative_error)))


def _proposals(value: str, shares: list[float]) -> Column:
    """Aggregate column: a sketch's values a little below and above each share of the rows."""
    points = sorted({min(max(s + d, 0.0), 1.0) for s in shares for d in (-BRACKET, BRACKET)})
    return F.percentile_approx(value, F.array(*[F.lit(p) for p in points]), F.lit(math.ceil(2 / BRACKET)))


def _order_statistics(df: DataFrame, value: str, ranks: list[int], rows: int,
                      cuts: list[float]) -> dict[int, float]:
    """The values with the given 0-based ranks in ascending order.

    ``cuts`` are values proposed around every rank. One aggregate counts
    exactly what lies below and at each of them; one more finds the ranks in
    the narrow intervals between them: two passes for any number of ranks.
    Intervals that still hold many rows are narrowed by a sketch of their own first.
    """
    v, found = F.col(value), {}
    asked = sorted(set(ranks))
    cuts = sorted(set(cuts))
    counts = df.agg(*[c for x in cuts for c in (F.count_if(v < x), F.count_if(v == x))]).first()
    below, at = counts[0::2], counts[1::2]
    # Open intervals between neighbouring cuts: (lower, upper, rows below, rows inside).
    edges = [(None, cuts[0], 0, below[0])]
    for i, x in enumerate(cuts):
        after = below[i] + at[i]
        upper, end = (cuts[i + 1], below[i + 1]) if i + 1 < len(cuts) else (None, rows)
        edges.append((x, upper, after, end - after))
    left: dict[int, tuple] = {}
    for rank in asked:
        hit = [x for x, b, n in zip(cuts, below, at) if b <= rank < b + n]
        if hit:
            found[rank] = hit[0]
        else:
            left[rank] = next(e for e in edges if e[2] <= rank < e[2] + e[3])

    def inside(edge: tuple) -> Column:
        lower, upper = edge[:2]
        held = F.lit(True) if lower is None else v > lower
        return held if upper is None else held & (v < upper)

    for edge in {e for e in left.values() if e[3] > HELD_ROWS}:
        here = {r: e for r, e in left.items() if e == edge}
        part, wanted = df.where(inside(edge)), [r - edge[2] for r in here]
        nearer = part.agg(_proposals(value, [(r + 0.5) / edge[3] for r in wanted])).first()[0]
        part = _order_statistics(part, value, wanted, edge[3], nearer)
        for r in here:
            found[r] = part[r - edge[2]]
            del left[r]
    if left:
        # The middle of the rank's step, so that no rounding picks a neighbour.
        picked = [F.expr(f"percentile_disc({(r - e[2] + 0.5) / e[3]!r}D) WITHIN GROUP (ORDER BY `_in{i}`)")
                  for i, (r, e) in enumerate(left.items())]
        held = F.lit(False)
        for e in left.values():
            held = held | inside(e)
        near = df.where(held).select(*[F.when(inside(e), v).alias(f"_in{i}") for i, e in enumerate(left.values())])
        found.update(zip(left, near.agg(*picked).first()))
    return found


def exact_quantiles(df: DataFrame, value: str, probabilities: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation, like ``df.approxQuantile``.

    Only counts and single values reach the driver, in three passes however many
    quantiles are asked for: the first counts the rows and proposes values. Null and NaN are ignored; an empty column gives
    ``None``. Runs when called; results are plain numbers, so that they reach
    scans as filters.
    """
    clean = df.select(F.col(value).cast("double").alias(value)).where(present(value))
    rows, cuts = clean.agg(F.count("*"), _proposals(value, probabilities)).first() if probabilities else (0, None)
    if rows == 0:
        return [None for _ in probabilities]
    places = [(rows - 1) * p for p in probabilities]
    found = _order_statistics(
        clean, value, [r for x in places for r in (math.floor(x), math.ceil(x))], rows, cuts)
    out = []
    for x in places:
        low, high = found[math.floor(x)], found[math.ceil(x)]
        out.append(low if low == high else low + (x - math.floor(x)) * (high - low))
    return out


def range_count(rows: int, per_range: int = RANGE_ROWS) -> int:
    """Number of value ranges; it grows with the rows, so that a range does not."""
    return max(8, -(-rows // per_range))


def with_value_ranges(df: DataFrame, values: list[str], suffix: str = "_range",
                      ranges: int | None = None) -> DataFrame:
    """Add, for each column, the number of the value range a row falls in.

    The limits are approximate quantiles over all rows, kept in the plan as
    constants, so that a row gets the same range in each evaluation and no range
    holds many more distinct values than another. The pass that counts the rows
    takes those of the fewest ranges; a second one follows if there must be more.
    """
    wide = df.withColumns({f"_d_{v}": F.col(v).cast("double") for v in values})

    def limits(k: int) -> list[Column]:
        shares = F.array(*[F.lit(i / k) for i in range(1, k)])
        return [F.percentile_approx(F.when(present(f"_d_{v}"), F.col(f"_d_{v}")), shares, F.lit(4 * k)) for v in values]

    k = ranges or range_count(0)
    rows, *found = wide.agg(F.count("*"), *(limits(k) if k > 1 else [F.lit(None) for _ in values])).first()
    if ranges is None and range_count(rows) > k:
        found = wide.agg(*limits(range_count(rows))).first()
    splits = [[-math.inf, *sorted(set(x or ())), math.inf] for x in found]
    splits = [s if len(s) > 2 else [-math.inf, 0.0, math.inf] for s in splits]
    cut = Bucketizer(splitsArray=splits, inputCols=[f"_d_{v}" for v in values],
                     outputCols=[v + suffix for v in values], handleInvalid="keep")
    out = cut.transform(wide).drop(*[f"_d_{v}" for v in values])
    return out.withColumns({v + suffix: F.col(v + suffix).cast("int") for v in values})


def with_running_counts(hist: DataFrame, keys: list[str], value: str, range_col: str,
                        counts: list[str]) -> DataFrame:
    """Running totals over a value histogram, group by group.

    ``hist`` has one row per (keys, range, value). Windows are partitioned by
    keys and range, so a group with a large share of the rows is spread over
    its ranges; the second window sees one row per range. Adds for each count
    column ``<c>_before`` (items with a smaller value) and ``<c>_total``.
    """
    group = Window.partitionBy(*keys)
    inside = Window.partitionBy(*keys, range_col).orderBy(value)
    local = hist.withColumns({
        f"{c}_before": F.sum(c).over(inside) - F.col(c) for c in counts
    })
    across = group.orderBy(range_col)
    totals = hist.groupBy(*keys, range_col).agg(*[F.sum(c).alias(f"_{c}") for c in counts])
    for c in counts:
        totals = totals.withColumns({
            f"{c}_offset": F.sum(f"_{c}").over(across) - F.col(f"_{c}"),
            f"{c}_total": F.sum(f"_{c}").over(group),
        })
    totals = totals.drop(*[f"_{c}" for c in counts])
    on = [local[k].eqNullSafe(totals[k]) for k in [*keys, range_col]]
    joined = local.join(totals, on).select(
        *[local[c] for c in local.columns],
        *[totals[f"{c}_{end}"] for c in counts for end in ("offset", "total")],
    )
    return joined.withColumns({
        f"{c}_before": F.col(f"{c}_before") + F.col(f"{c}_offset") for c in counts
    }).drop(*[f"{c}_offset" for c in counts])


def quantile_from_counts(value: str, count: str, p: float) -> Column:
    """Aggregate column: interpolated quantile of one count column of a
    histogram prepared by :func:`with_running_counts`."""
    before, n = F.col(f"{count}_before"), F.col(count)
    position = (F.col(f"{count}_total") - 1) * F.lit(p)
    low, high = F.floor(position), F.ceil(position)

    def at(rank: Column) -> Column:
        return F.max(F.when((n > 0) & (before <= rank) & (rank < before + n), F.col(value)))

    weight = F.max(position - low)
    return at(low) + weight * (at(high) - at(low))


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, named: dict[str, float],
                      ranges: int | None = None) -> DataFrame:
    """Exact interpolated quantiles per group; also ``n``, the group's rows.

    Rows are counted by value and spread over value ranges, so a group that
    holds most rows is spread too.
    """
    clean = df.select(*keys, F.col(value).cast("double").alias(value)).where(present(value))
    hist = (
        with_value_ranges(clean, [value], "_range", ranges)
        .groupBy(*keys, f"{value}_range", value)
        .agg(F.count("*").alias("n_rows"))
    )
    running = with_running_counts(hist, keys, value, f"{value}_range", ["n_rows"])
    return running.groupBy(*keys).agg(
        F.sum("n_rows").alias("n"),
        *[quantile_from_counts(value, "n_rows", p).alias(name) for name, p in named.items()],
    )
