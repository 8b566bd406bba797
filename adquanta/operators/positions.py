"""Positions of rows in a total order, spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adquanta.session import stage

from .joins import join_dimension

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low bits


def with_position(df: DataFrame, order: list[str], keys: list[str] | None = None,
                  out: str = "position", partitions: int | None = None) -> DataFrame:
    """Number the rows from 1 in the order of ``order``, per ``keys`` if given.

    An ordered window would put each key (or, without keys, the whole table)
    in a single task. Here the rows are range-partitioned and sorted by keys
    and order columns, which splits a hot key over several tasks; the slice
    sizes give each slice its offset. The ranged rows are written to the shared
    folder, so that slices stay the same however often they are read and
    whatever executors are lost in between.
    """
    keys = keys or []
    sort = [*keys, *order]
    by_range = [partitions, *sort] if partitions else sort
    sliced = (
        df.repartitionByRange(*by_range)
        .sortWithinPartitions(*sort)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumns({
            "_slice": F.shiftrightunsigned("_row", _ROW_BITS),
            "_row": F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
        })
    )
    ranged = stage(sliced, "slices")
    # Null keys form a group of their own.
    filled = {f"_k{i}": F.struct(F.col(k)) for i, k in enumerate(keys)}
    ranged = ranged.withColumns(filled) if filled else ranged
    group = list(filled)
    sizes = ranged.groupBy("_slice", *group).agg(
        F.count("*").alias("_size"), F.min("_row").alias("_first"))
    # One row per slice and key: per key at most as many rows as slices.
    earlier = Window.partitionBy(*group).orderBy("_slice")
    offsets = sizes.select(
        "_slice", *group, "_first",
        (F.sum("_size").over(earlier) - F.col("_size")).alias("_offset"))
    numbered = join_dimension(ranged, offsets, ["_slice", *group])
    position = F.col("_offset") + F.col("_row") - F.col("_first") + 1
    return numbered.withColumn(out, position).select(*df.columns, out)


def window_number(position: Column | str, size: int) -> Column:
    """1-based number of the fixed-size window a position falls in."""
    pos = F.col(position) if isinstance(position, str) else position
    return (F.floor((pos - 1) / F.lit(size)) + 1).cast("bigint")
