"""Window summaries, breakdowns, count windows and roll-ups.

All money sums are exact integer-cent sums, so results do not depend on the
order in which partial aggregates are merged.  Rates are rounded from the
exact quotient the same way everywhere: ``round(x * 10^d) / 10^d``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.rolling import avg_from_cents, cents


def round_to(x: Column, decimals: int) -> Column:
    scale = float(10 ** decimals)
    return F.round(x * F.lit(scale)) / F.lit(scale)


def fraud_flag(df: DataFrame, flag_col: str = "is_fraud") -> Column:
    """0/1 fraud indicator; 0 for every row when the frame has no flag."""
    if flag_col in df.columns:
        return F.coalesce(F.col(flag_col).cast("int"), F.lit(0))
    return F.lit(0)


def summary_aggs(df: DataFrame, amount_col: str = "transaction_amount", user_col: str = "user_id",
                 flag_col: str = "is_fraud") -> list[Column]:
    """Aggregate expressions of one window summary (A1–A3).

    All are algebraic except the distinct-user count, which Spark plans as a
    dedupe on (group, user) shuffled on both keys before the final count, so
    a hot group is spread over many tasks.
    """
    amt = F.coalesce(F.col(amount_col).cast("double"), F.lit(0.0))
    n = F.count(F.lit(1))
    sc = F.sum(cents(F.col(amount_col)))
    fc = F.sum(fraud_flag(df, flag_col)).cast("long")
    return [
        n.alias("total_transactions"),
        (sc / F.lit(100.0)).alias("total_amount"),
        avg_from_cents(sc, n).alias("avg_amount"),
        F.max(amt).alias("max_amount"),
        F.min(amt).alias("min_amount"),
        F.count_distinct(F.col(user_col)).alias("unique_users"),
        fc.alias("fraud_count"),
        round_to(fc / F.greatest(n, F.lit(1)), 4).alias("fraud_rate"),
    ]


def window_summary(df: DataFrame, every: str = "1 minute", ts_col: str = "event_time",
                   **kw) -> DataFrame:
    """A1–A3 per tumbling event-time window (partial aggregation; the exact
    distinct-user count adds one (window, user) shuffle before the window one)."""
    agg = df.groupBy(F.window(ts_col, every).alias("w")).agg(*summary_aggs(df, **kw))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      *[c for c in agg.columns if c != "w"])


DIMENSIONS = ["event_type", "device_type", "location"]


def breakdown_counts(df: DataFrame, every: str = "1 minute", ts_col: str = "event_time",
                     dims: list[str] = DIMENSIONS, top: dict[str, int] | None = None,
                     group_cols: list[str] | None = None) -> DataFrame:
    """A4–A6 in long form: (group…, dimension, value, cnt, rnk).

    Groups are tumbling windows of ``every`` (column ``window_start``) unless
    ``group_cols`` names existing key columns.  One scan feeds all
    dimensions: each row is fanned out to one (dimension, value) pair per
    dimension and counted with map-side partial aggregation, so the fan-out
    never reaches the shuffle.  Ranks order by count desc, then value asc;
    null values are dropped like ``value_counts`` does.  ``top`` keeps only
    the first k values of the named dimensions.
    """
    top = {"location": 10} if top is None else top
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
                      for d in dims])
    if group_cols:
        keys = [F.col(c) for c in group_cols]
    else:
        keys, group_cols = [F.window(ts_col, every).start.alias("window_start")], ["window_start"]
    long = (df.select(*keys, F.inline(pairs))
              .filter(F.col("value").isNotNull())
              .groupBy(*group_cols, "dimension", "value")
              .agg(F.count(F.lit(1)).alias("cnt")))
    rank_w = Window.partitionBy(*group_cols, "dimension").orderBy(F.desc("cnt"), F.asc("value"))
    top = {d: k for d, k in top.items() if d in dims}
    free = [d for d in dims if d not in top]
    out = None
    # A plain rank bound on its own branch becomes a per-task group limit
    # before the exchange.
    for these, k in [(free, None), *(([d], k) for d, k in top.items())]:
        if these:
            part = long.filter(F.col("dimension").isin(these)).withColumn("rnk", F.row_number().over(rank_w))
            part = (part.filter(F.col("rnk") <= k) if k else part).withColumn("rnk", F.col("rnk").cast("long"))
            out = part if out is None else out.unionByName(part)
    return out


def breakdown_maps(long: DataFrame, dims: list[str] = DIMENSIONS,
                   group_cols: list[str] | None = None) -> DataFrame:
    """Fold the long form into one ordered ``map<string,bigint>`` per dimension
    (at most the number of distinct values per group and dimension)."""
    group_cols = group_cols or ["window_start"]
    aggs = []
    for d in dims:
        entries = F.sort_array(F.collect_list(
            F.when(F.col("dimension") == F.lit(d), F.struct(F.col("rnk"), F.col("value"), F.col("cnt")))))
        aggs.append(F.map_from_entries(
            F.transform(entries, lambda e: F.struct(e["value"], e["cnt"]))).alias(_map_name(d)))
    return long.groupBy(*group_cols).agg(*aggs)


def _map_name(dim: str) -> str:
    return {"event_type": "event_type_breakdown", "device_type": "device_breakdown",
            "location": "location_breakdown"}.get(dim, f"{dim}_breakdown")


def window_metrics(df: DataFrame, every: str = "1 minute", ts_col: str = "event_time") -> DataFrame:
    """Full WindowMetrics rows: A1–A3 summary plus the three breakdown maps.

    Both inputs are already aggregated to one row per window (or per window
    and value), so the join is between small tables; AQE picks the strategy.
    """
    summ = window_summary(df, every, ts_col)
    maps = breakdown_maps(breakdown_counts(df, every, ts_col))
    return summ.join(maps, "window_start", "left")


# ---------------------------------------------------------------------------
# Count-based windows in global event order
# ---------------------------------------------------------------------------

def global_index(df: DataFrame, order_cols: list[str], index_col: str = "idx",
                 total_col: str | None = None) -> DataFrame:
    """0-based position of each row in the total order ``order_cols``.

    Distributed, no single-task window: the frame is range-partitioned and
    sorted, checkpointed to the shared checkpoint folder (so partition ids
    and in-partition order stay fixed if an executor is lost), then each row's
    index is its partition's offset plus its position inside the partition.
    As in ``RDD.zipWithIndex``, only the per-partition row counts (one number
    per partition) reach the driver; the offsets go back as a literal array
    indexed by partition id, so the indexing pass is a narrow projection.
    """
    from vigil.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    ordered = df.orderBy(*order_cols).checkpoint(eager=True)
    pid = F.spark_partition_id()
    counts = dict(ordered.groupBy(pid.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    n_parts = max(counts) + 1 if counts else 1
    offsets, run = [], 0
    for p in range(n_parts):
        offsets.append(run)
        run += counts.get(p, 0)
    # Position inside a partition: the id counts up from pid << 33.
    local = F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)
    offset = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), pid + 1)
    out = ordered.withColumn(index_col, offset + local)
    if total_col:
        out = out.withColumn(total_col, F.lit(run).cast("long"))
    return out


COUNT_WINDOW_COLUMNS = ["transaction_amount", "user_id", "is_fraud"] + DIMENSIONS


def assign_count_windows(df: DataFrame, every: int = 100,
                         order_cols: list[str] | None = None,
                         columns: list[str] | None = None) -> DataFrame:
    """Rows tagged with (window_index, is_tail) for A8; tail rows appear once
    more under the tail window.  Only ``order_cols`` + ``columns`` (default:
    what the summary and breakdowns read) are sorted and checkpointed."""
    order_cols = order_cols or ["event_time", "event_id"]
    keep = order_cols + [c for c in (columns or COUNT_WINDOW_COLUMNS) if c in df.columns and c not in order_cols]
    ix = global_index(df.select(*keep), order_cols, total_col="n_all")
    return tag_count_windows(ix, every)


def tag_count_windows(ix: DataFrame, every: int, first_window: int = 0,
                      idx_col: str = "idx", total_col: str = "n_all") -> DataFrame:
    """Tag indexed rows with their count window: full windows from
    ``first_window`` on, plus the tail window (the last ``every`` rows) when
    the total is not a multiple of ``every``."""
    idx, total = F.col(idx_col), F.col(total_col)
    full_windows = F.floor(total / every)
    win = F.floor(idx / every)
    regular = (ix.filter((win < full_windows) & (win >= first_window))
                 .withColumn("window_index", win.cast("long"))
                 .withColumn("is_tail", F.lit(False)))
    tail = (ix.filter((total % every != 0) & (idx >= total - every))
              .withColumn("window_index", full_windows.cast("long"))
              .withColumn("is_tail", F.lit(True)))
    return regular.unionByName(tail)


def continue_count_windows(new_rows: DataFrame, tail: DataFrame | None, prev_total: int,
                           every: int) -> tuple[DataFrame, DataFrame, int]:
    """A8 across runs or micro-batches without re-sorting history.

    New rows are numbered after the ``prev_total`` rows before them, in
    (event_time, event_id) order (a sort of the new rows only); window ``k``
    is ``seq // every``.  ``tail`` holds the last ``every`` rows before
    (bounded) and supplies the still-open window.  Returns the rows tagged
    with the windows that the new rows touch, the next tail, the new total.
    For in-order arrival this equals numbering all rows at once.
    """
    cols = ["event_time", "event_id"] + [c for c in COUNT_WINDOW_COLUMNS if c in new_rows.columns]
    ix = global_index(new_rows.select(*cols), ["event_time", "event_id"], total_col="_n")
    first = ix.select("_n").first()
    total = prev_total + (int(first[0]) if first else 0)
    rows = ix.withColumn("seq", F.col("idx") + F.lit(prev_total)).drop("idx", "_n")
    if tail is not None:
        rows = rows.unionByName(tail.select(*rows.columns))
    tagged = tag_count_windows(rows.withColumn("n_all", F.lit(total).cast("long")), every,
                               first_window=prev_total // every, idx_col="seq")
    return tagged, rows.filter(F.col("seq") >= total - every), total


def count_windows(df: DataFrame, every: int = 100, order_cols: list[str] | None = None,
                  tagged: DataFrame | None = None, **kw) -> DataFrame:
    """A summary for every ``every`` consecutive events, plus a trailing
    window over the last ``every`` events when the total is not a multiple
    (flagged ``is_tail``; it may overlap the previous window).

    Window ids come from the global index, so the per-window aggregation is an
    ordinary (partial + final) hash aggregate.  Only tail rows are duplicated.
    """
    order_cols = order_cols or ["event_time", "event_id"]
    both = tagged if tagged is not None else assign_count_windows(df, every, order_cols)
    # Summaries read the pruned frame, so a missing flag column counts 0.
    ts = order_cols[0]
    return (both.groupBy("window_index", "is_tail")
                .agg(F.min(ts).alias("first_event_time"), F.max(ts).alias("last_event_time"),
                     *summary_aggs(both, **kw)))


def count_window_metrics(df: DataFrame, every: int = 100,
                         order_cols: list[str] | None = None, tagged: DataFrame | None = None) -> DataFrame:
    """A8 windows with the three breakdown maps (the insight cadence)."""
    tagged = tagged if tagged is not None else assign_count_windows(df, every, order_cols)
    keys = ["window_index", "is_tail"]
    summ = count_windows(df, every, order_cols, tagged=tagged)
    maps = breakdown_maps(breakdown_counts(tagged, group_cols=keys), group_cols=keys)
    return summ.join(maps, keys, "left")


# ---------------------------------------------------------------------------
# Reads over the window-metrics table
# ---------------------------------------------------------------------------

def in_latest_windows(events: DataFrame, every: str, n: int, ts_col: str = "event_time") -> DataFrame:
    """The events of the newest ``n`` non-empty windows.

    The bound is found by an aggregate over the time column alone and reaches
    the scan as a filter, so older row groups are not read.
    """
    start = F.window(ts_col, every).start.alias("w")
    newest = events.select(start).filter(F.col("w").isNotNull()).distinct().orderBy(F.desc("w")).limit(n)
    bound = newest.agg(F.min("w")).first()[0]
    if bound is None:
        return events
    return events.filter(F.col(ts_col) >= F.lit(bound).cast(events.schema[ts_col].dataType))


def last_n(df: DataFrame, n: int, order_col: str = "window_start") -> DataFrame:
    """Last ``n`` rows by ``order_col`` (TakeOrderedAndProject: per-partition
    top-n, then a merge of n rows per partition)."""
    return df.orderBy(F.desc(order_col)).limit(n)


def status_row(metrics: DataFrame) -> DataFrame:
    """The newest window's count and rate; 0, 0 and no window when there is none."""
    newest = metrics.agg(F.max_by(F.struct("window_start", "total_transactions", "fraud_rate"), "window_start").alias("m"))
    return newest.select(F.col("m.window_start").alias("last_metrics_window"),
                         F.coalesce("m.total_transactions", F.lit(0)).cast("long").alias("total_transactions"),
                         F.coalesce("m.fraud_rate", F.lit(0.0)).alias("fraud_rate"))


def metrics_rollup(metrics: DataFrame, n: int = 60, order_col: str = "window_start") -> DataFrame:
    """Roll-up of the last ``n`` windows.

    ``avg_transaction_value`` is the unweighted mean of the non-zero window
    averages (2 dp); ``avg_fraud_rate`` the mean window rate (4 dp).  Window
    averages are 2-dp and rates 4-dp values, so both means are taken over
    exact integers.
    """
    recent = last_n(metrics, n, order_col)
    avg_c = F.round(F.col("avg_amount") * F.lit(100.0)).cast("long")
    rate_u = F.round(F.col("fraud_rate") * F.lit(10000.0)).cast("long")
    nz = F.when(F.col("avg_amount") != 0, avg_c)
    return recent.agg(
        F.count(F.lit(1)).alias("windows_analysed"),
        F.coalesce(F.round(F.sum(nz) / F.count(nz)) / F.lit(100.0), F.lit(0.0)).alias("avg_transaction_value"),
        F.coalesce(F.round(F.sum(rate_u) / F.count(rate_u)) / F.lit(10000.0), F.lit(0.0)).alias("avg_fraud_rate"),
        F.coalesce(F.max("total_transactions"), F.lit(0)).cast("long").alias("peak_transactions"),
        F.coalesce(F.sum("total_transactions"), F.lit(0)).cast("long").alias("total_transactions"),
    )
