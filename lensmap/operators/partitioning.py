"""Partitioning helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, min_partitions: int | None = None,
           barrier: bool = False) -> DataFrame:
    """Round-robin a DataFrame whose scan yields too few partitions.

    CPU-heavy row work (regexes over long texts, n-gram hashing) should use
    every core.  A large input already arrives in many splits and is left
    alone; a single-row-group file arrives as one split and is spread.
    """
    sc = df.sparkSession.sparkContext
    want = min_partitions or sc.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    # Twice the cores: row sizes vary a lot (texts of 1 to 20,000 words), so
    # more, smaller slices balance better.  Catalyst pushes deterministic
    # filters through a repartition; when a caller will filter on an
    # expensive deterministic expression, ``barrier`` adds an identity Arrow
    # map that filters do not cross (the expensive UDFs of this package are
    # declared non-deterministic, so their filters never move anyway).
    out = df.repartition(2 * want)
    return out.mapInArrow(_identity_batches, df.schema) if barrier else out


def _identity_batches(batches):
    yield from batches


def group_offsets(df: DataFrame, group_cols: list[str], count, out_col: str = "offset") -> DataFrame:
    """Exclusive running sum over groups of rows: one row per group, in group order.

    ``count`` is the column summed in each group.  Rows are not moved: a
    partial aggregate gives one small row per group (a file, or a split of
    one), and only those rows are put in order and summed.  The table is
    written once, so every reader sees the same offsets.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from ..session import materialize
    per = df.groupBy(*group_cols).agg(F.sum(count).alias("_n"))
    before = Window.orderBy(*group_cols).rowsBetween(Window.unboundedPreceding, -1)
    return materialize(per.select(
        *group_cols, F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias(out_col)), "offsets")


def running_offsets(df: DataFrame, order_cols: list[str], count_col: str,
                    out_col: str = "offset") -> DataFrame:
    """Exclusive running sum of ``count_col`` in ``order_cols`` order (a key of the rows)."""
    off = group_offsets(df, order_cols, count_col, out_col)
    return df.join(broadcast_if_small(off, 256), order_cols)


def number_rows(df: DataFrame, split_cols: list[str], counters: dict, within: dict | None = None) -> DataFrame:
    """``df`` written once, with a running number from 0 for each of ``counters``.

    ``counters`` maps a new column to the condition of the rows it counts (null
    on the others); the order is (``split_cols``, row order inside the split),
    where ``split_cols`` name the file and the start of the split a row was read
    from.  ``within`` maps a counter to the columns in which it starts anew.

    Rows and numbers come out of one pass: ids that increase along a task's rows
    are written beside the rows they number, and the offsets of the splits are
    sums over that table.  Nothing is scanned a second time, so it does not
    matter whether the session would cut the input into other splits by then.
    The rows are neither shuffled nor sorted; one row a split is.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from ..session import materialize
    rows = materialize(df.select("*", *(F.when(cond, F.monotonically_increasing_id()).alias(f"_seq_{name}")
                                        for name, cond in counters.items())), "numbered")
    per = rows.groupBy(*split_cols).agg(*(x for name in counters for x in (
        F.count(f"_seq_{name}").alias(f"_n_{name}"), F.min(f"_seq_{name}").alias(f"_first_{name}"))))
    shifts = []
    for name in counters:
        w = Window.partitionBy(*(within or {}).get(name, [])).orderBy(*split_cols).rowsBetween(Window.unboundedPreceding, -1)
        shifts.append((F.coalesce(F.sum(f"_n_{name}").over(w), F.lit(0)) - F.col(f"_first_{name}")).alias(f"_shift_{name}"))
    off = materialize(per.select(*(F.col(c).alias(f"_k_{c}") for c in split_cols), *shifts), "offsets")
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in split_cols]
    out = rows.join(broadcast_if_small(off, 256), same, "left")
    return out.select(*df.columns, *((F.col(f"_seq_{name}") + F.col(f"_shift_{name}")).cast("long").alias(name) for name in counters))


def row_positions(df: DataFrame, split_cols: list[str], out_col: str) -> DataFrame:
    """Position of every row in the order of (``split_cols``, row order inside the split)."""
    from pyspark.sql import functions as F
    return number_rows(df, split_cols, {out_col: F.lit(True)})


def broadcast_if_small(df: DataFrame, row_bytes: int, budget: int = 64 * 1024 * 1024) -> DataFrame:
    """Broadcast ``df`` only after proving its size: count its rows (one small
    job) and compare rows x row_bytes with the budget; otherwise leave the
    join to a shuffle (and AQE)."""
    from pyspark.sql import functions as F
    n = df.count()
    return F.broadcast(df) if n * max(1, row_bytes) <= budget else df
