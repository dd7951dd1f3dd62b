"""Series helpers that never put a whole series into one task.

A long series is cut into blocks of its position axis. Work that looks along
the series (fills, sliding frames, row numbers) runs per (key, block); what has
to cross a block edge travels either in a small per-block summary table
(``carry``, ``row_index``) or as a copied margin of rows (``with_halo``). One
hot key therefore spreads over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def _block(pos: str, width: int) -> Column:
    return F.floor(F.col(pos) / F.lit(width)).cast("long")


def carry(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    values: Mapping[str, Column],
    width: int = BLOCK,
    forward: bool = True,
    backward: bool = True,
) -> DataFrame:
    """For each named value add the nearest non-null one at or before the row
    (``{n}_prev``, ``{n}_prev_pos``) and at or after it (``{n}_next``, ``{n}_next_pos``).

    ``pos`` must order the rows of a key without ties. All values share one
    pass: two sorts inside the blocks and one join with the block edges.
    """
    base = df.withColumn("_blk", _block(pos, width))
    for n, v in values.items():
        base = base.withColumn(f"_v_{n}", v).withColumn(f"_p_{n}", F.when(v.isNotNull(), F.col(pos)))
    own = [*keys, "_blk"]
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    # A frame that ends at the last row is re-read for every row; the backward
    # look therefore runs forward over the reversed order.
    along = Window.partitionBy(*own).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    against = Window.partitionBy(*own).orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, 0)
    sides = [("prev", before, along, F.max, F.max_by)] if forward else []
    sides += [("next", after, against, F.min, F.min_by)] if backward else []

    ends, crossing, inside, final, scratch = [], [], [], [], []
    for n in values:
        scratch += [f"_v_{n}", f"_p_{n}"]
        for side, over_blocks, in_block, extreme, extreme_by in sides:
            tag = f"{n}_{side}"
            ends += [extreme(f"_p_{n}").alias(f"_ep_{tag}"), extreme_by(f"_v_{n}", f"_p_{n}").alias(f"_ev_{tag}")]
            for x in ("p", "v"):
                crossing.append(F.last(f"_e{x}_{tag}", True).over(over_blocks).alias(f"_c{x}_{tag}"))
                inside.append(F.last(f"_{x}_{n}", True).over(in_block).alias(f"_i{x}_{tag}"))
            final.append(F.coalesce(f"_iv_{tag}", f"_cv_{tag}").alias(tag))
            final.append(F.coalesce(f"_ip_{tag}", f"_cp_{tag}").alias(f"{tag}_pos"))
    edges = base.groupBy(*own).agg(*ends).select(*own, *crossing)
    return base.select("*", *inside).join(edges, on=own, how="left").select(*df.columns, *final)


def with_halo(
    df: DataFrame, pos: str, before: int, after: int, width: int = BLOCK
) -> DataFrame:
    """Copy the rows near a block edge into the neighbouring block.

    Adds ``_blk`` (the block to work in) and ``_own`` (false for copies). A
    frame of ``before`` positions back and ``after`` ahead is then complete for
    every owned row of (key, ``_blk``).
    """
    width = max(width, 4 * (before + after + 1))
    home = _block(pos, width)
    left = F.floor((F.col(pos) - after) / F.lit(width)).cast("long")
    right = F.floor((F.col(pos) + before) / F.lit(width)).cast("long")
    return (
        df.withColumn("_home", home)
        .withColumn("_blk", F.explode(F.sequence(left, right)))
        .withColumn("_own", F.col("_blk") == F.col("_home"))
        .drop("_home")
    )


def framed(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    before: int,
    after: int,
    columns: dict,
    width: int = BLOCK,
) -> DataFrame:
    """Evaluate window expressions over position frames, block by block.

    ``columns`` maps a new column to ``f(window) -> Column``; the window passed
    in is partitioned by key and block and ordered by position. Offsets used by
    the expressions must stay within ``before`` / ``after``.
    """
    near = with_halo(df, pos, before, after, width)
    w = Window.partitionBy(*keys, "_blk").orderBy(pos)
    out = near.select("*", *[f(w).alias(name) for name, f in columns.items()])
    return out.where("_own").drop("_own", "_blk")


def row_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str = "t_idx"
) -> DataFrame:
    """Zero-based row number per key without one task per key.

    ``bucket`` is a coarse, order-preserving function of the sort key. Rows are
    numbered inside a bucket and shifted by the counts of the earlier buckets.
    """
    base = df.withColumn("_bucket", bucket)
    own = [*keys, "_bucket"]
    sizes = base.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_bucket") if keys else Window.orderBy("_bucket")
    sizes = sizes.select(
        *own,
        F.coalesce(F.sum("_n").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"),
    )
    inside = Window.partitionBy(*own).orderBy(*order)
    return (
        base.withColumn("_rn", F.row_number().over(inside) - 1)
        .join(sizes, on=own)
        .withColumn(out, (F.col("_rn") + F.col("_ahead")).cast("long"))
        .drop("_bucket", "_rn", "_ahead")
    )


def prev_row(
    df: DataFrame, keys: Sequence[str], order: str, bucket: Column, columns: Sequence[str], suffix: str = "_before"
) -> DataFrame:
    """Add the previous row's ``columns`` in ``order``, one task per (key, bucket).

    ``order`` must have no ties inside a key; ``bucket`` is as in ``row_index``.
    """
    row = F.struct(*[F.col(c).alias(c) for c in columns])
    base = df.withColumn("_bucket", bucket).withColumn("_row", row)
    own = [*keys, "_bucket"]
    w = Window.partitionBy(*own).orderBy(order)
    ends = base.groupBy(*own).agg(F.max_by("_row", F.col(order)).alias("_end"))
    over_buckets = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_bucket")
    ends = ends.select(*own, F.lag("_end").over(over_buckets).alias("_in"))
    out = base.withColumn("_p", F.lag("_row").over(w)).join(ends, on=own, how="left")
    out = out.withColumn("_p", F.coalesce("_p", "_in"))
    return out.select(*df.columns, *[F.col("_p")[c].alias(f"{c}{suffix}") for c in columns])
