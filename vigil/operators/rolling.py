"""Trailing per-user window features.

For every event the frame is all events of the same user with
``event_time`` in ``[t - window, t]`` (lower bound inclusive, current row
and same-time peers included).  Features: count, average amount (2 dp),
max amount, failed-login count and distinct locations.  They depend on the
user and the time alone.

Scale design
------------
Rows are range-partitioned by (user, time), about ``RANGE_ROWS`` to a range
whatever the table's size, and written to the shared checkpoint folder, so
ranges are of even size however the rows are spread over users and time: a user
that holds everything inside one window still spreads over many ranges.  Only
the first user of a range can have a frame that begins before it.  Let its rows
there run from ``t0`` to ``t1``.  Its earlier rows reach the range as a halo:

* Rows in ``[t0 - window, t1 - window]`` leave the frame inside the range; they
  come one by one.  A time plus the window lies in one range, so a row is
  copied about once.
* Rows after ``t1 - window`` are in every frame of the range; they come summed
  up, one row per location.  Ranges that lie there whole are summed up once.

One more exchange brings each range and its halo together, and everything else
happens inside it, sorted:

* An event adds to its user's running sums at ``t`` and takes the same off
  just past ``t + window``.  A location counts from an event until it expires
  or the location's next event takes over, so the distinct count is a running
  sum too.  A frame's value is the sum of all changes up to ``t``.
* The maximum over ``[t - window, t]`` is the larger of a running maximum
  inside the aligned window-wide block of ``t`` and a reverse running maximum
  from ``t - window`` to the end of the block before.

Work is O(1) a row besides sorting, and the halo has at most about two rows for
each row of the table; pairs of ranges inside one window of one user add a row
per location each, before they are summed up.

Amounts are summed as integer cents, so the sums (and therefore averages) are
exact and independent of summation order across partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.time import epoch_micros
from vigil.schemas import FAILED_LOGIN
from vigil.session import ensure_checkpoint_dir

MICROS_PER_MINUTE = 60 * 1_000_000
RANGE_ROWS, LEAST_ROWS = 50_000, 10_000
NARROW = ("_u", "_loc", "_t", "_n", "_c", "_amt", "_fail")  # what a row adds to frames


def cents(amount: Column) -> Column:
    """Amount in integer cents (amounts are validated to 2 dp upstream)."""
    return F.round(F.coalesce(amount.cast("double"), F.lit(0.0)) * F.lit(100.0)).cast("long")


def avg_from_cents(sum_cents: Column, n: Column) -> Column:
    """Mean in currency units rounded to 2 dp, computed from exact cents."""
    return F.round(sum_cents / n) / F.lit(100.0)


def _range_count(base: DataFrame) -> int | None:
    """Ranges of about ``RANGE_ROWS`` rows, smaller ones up to the session's shuffle partitions; None: too few to say."""
    rows = base.count()
    if rows <= RANGE_ROWS:
        return None
    usual = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(-(-rows // RANGE_ROWS), min(usual, -(-rows // LEAST_ROWS)))


def _pairs(ordered: DataFrame, window_us: int) -> DataFrame:
    """Ranges (_to) whose first user has rows of the window before in an earlier range (_from): _u0, _t0, _t1 as above.

    ``_whole``: every row of that user in ``_from`` is in all its frames in ``_to``.
    """
    spans = ordered.groupBy("_range", "_u").agg(F.min("_t").alias("_t0"), F.max("_t").alias("_t1"))
    span = F.struct("_u", "_t0", "_t1")
    ends = spans.groupBy("_range").agg(F.min(span).alias("_head"), F.max(span).alias("_tail")).checkpoint()
    to = ends.select(F.col("_range").alias("_to"), F.col("_head._u").alias("_u0"), F.col("_head._t0").alias("_t0"), F.col("_head._t1").alias("_t1"))
    source = ends.select(F.col("_range").alias("_from"), F.col("_tail._u").alias("_u"), F.col("_tail._t0").alias("_low"), F.col("_tail._t1").alias("_high"))
    return (to.join(source, F.col("_u0").eqNullSafe(F.col("_u")) & (F.col("_high") < F.col("_t0"))
                    & (F.col("_high") >= F.col("_t0") - F.lit(window_us)))
            .select("_to", "_from", "_u0", "_t0", "_t1", (F.col("_low") > F.col("_t1") - F.lit(window_us)).alias("_whole")).checkpoint())


def _summed(rows: DataFrame, key: str) -> DataFrame:
    """One row for each (key, user, location)."""
    how = {"_t": F.max, "_n": F.sum, "_c": F.sum, "_amt": F.max, "_fail": F.sum}
    return (rows.groupBy(*[c for c in (key, "_u", "_loc") if c in rows.columns])
                .agg(*[f(c).alias(c) for c, f in how.items() if c in rows.columns]))


def _halo(ordered: DataFrame, window_us: int) -> DataFrame | None:
    """Halo rows: _range (the one that they come to) and the narrow columns of ``ordered``."""
    pairs = _pairs(ordered, window_us)
    if pairs.isEmpty():
        return None
    narrow = ordered.select("_range", *[c for c in NARROW if c in ordered.columns])
    columns = ["_to", *narrow.columns[1:]]
    from_range = (F.col("_range") == F.col("_from")) & F.col("_u").eqNullSafe(F.col("_u0"))
    near = (narrow.join(F.broadcast(pairs.filter("not _whole")), from_range)
                  .filter(F.col("_t") >= F.col("_t0") - F.lit(window_us)))
    leaves = F.col("_t") <= F.col("_t1") - F.lit(window_us)
    always = near.filter(~leaves).select(*columns)
    whole = pairs.filter("_whole")
    if not whole.isEmpty():
        sources = whole.select("_from", "_u0").distinct()
        parts = _summed(narrow.join(F.broadcast(sources), from_range).filter("_t is not null").select(*narrow.columns), "_range")
        always = always.unionByName(parts.join(whole.select("_to", "_from"), F.col("_range") == F.col("_from")).select(*columns))
    always = _summed(always, "_to").checkpoint()
    return near.filter(leaves).select(*columns).unionByName(always).withColumnRenamed("_to", "_range")


def _ranges_with_halo(base: DataFrame, window_us: int) -> DataFrame:
    """``base`` by ranges of (_u, _t): columns _range, _own (not a halo row), _n (rows summed up) and those of ``base``."""
    ensure_checkpoint_dir(base.sparkSession)
    ranges = _range_count(base)
    number = () if ranges is None else (ranges,)
    ordered = (base.withColumn("_n", F.lit(1).cast("long")).repartitionByRange(*number, "_u", "_t")
                   .withColumn("_range", F.spark_partition_id())
                   .checkpoint(eager=True))  # ranges stay as they are if an executor is lost
    halo = _halo(ordered, window_us)
    rows = ordered.withColumn("_own", F.lit(True))
    if halo is not None:
        rows = rows.unionByName(halo.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    return rows.repartition(*number, "_range")


def _changes(rows: DataFrame, window_us: int) -> DataFrame:
    """Four changes of its user's running state for each row of a range.

    ``_kind`` is 0 for the row itself (only it carries the row), 1 for an expiry and 2 for a probe of the maximum at the
    frame's start; ``_frame`` is the time whose frame it belongs to.
    """
    following = Window.partitionBy("_range", "_u", "_loc").orderBy("_t")
    rows = rows.withColumn("_next", F.lead("_t").over(following))
    row = F.struct(*[c for c in rows.columns if c not in ("_range", "_u", "_n", "_c", "_amt", "_fail", "_loc", "_t", "_next")])
    end = F.col("_t") + F.lit(window_us + 1)
    zero, none, nothing = F.lit(0).cast("long"), F.lit(None).cast("double"), F.lit(None)
    timed = F.col("_t").isNotNull()

    def change(at, n, c, f, loc, mx, kind, held=None):
        return F.struct(at.alias("_at"), n.alias("n"), c.alias("c"), f.alias("f"), loc.alias("loc"), mx.alias("mx"),
                        F.lit(kind).alias("_kind"), F.col("_t").alias("_frame"),
                        (row if held else F.when(F.lit(False), row).otherwise(nothing)).alias("_row"))
    one, n, c, f = F.lit(1).cast("long"), F.col("_n"), F.col("_c"), F.col("_fail").cast("long")
    itself = change(F.col("_t"), F.when(timed, n).otherwise(zero), F.when(timed, c).otherwise(zero), F.when(timed, f).otherwise(zero),
                    F.when(timed, one).otherwise(zero), F.when(timed, F.col("_amt")), 0, held=True)
    later = [change(end, -n, -c, -f, zero, none, 1), change(F.least(end, "_next"), zero, zero, zero, -one, none, 1),
             change(F.col("_t") - F.lit(window_us), zero, zero, zero, zero, none, 2)]
    return rows.select("_range", "_u", F.inline(F.when(timed, F.array(itself, *later)).otherwise(F.array(itself))))


def _frames(changes: DataFrame, window_us: int) -> DataFrame:
    """The rows of their own ranges with the values of their frames: r_n, r_c, r_f, r_loc, r_mx."""
    block = F.floor(F.col("_at") / F.lit(window_us)).cast("long")
    up = Window.partitionBy("_range", "_u").orderBy("_block", "_at").rangeBetween(Window.unboundedPreceding, 0)
    rising = Window.partitionBy("_range", "_u", "_block").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    falling = Window.partitionBy("_range", "_u", "_block").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, 0)
    frame = Window.partitionBy("_range", "_u", "_frame")
    return (changes.withColumn("_block", block)
                   .withColumns({f"r_{x}": F.sum(x).over(up) for x in ("n", "c", "f", "loc")})
                   .withColumns({"_up": F.max("mx").over(rising)}).withColumns({"_down": F.max("mx").over(falling)})
                   .filter("_kind <> 1")
                   .withColumn("_before", F.max(F.when(F.col("_kind") == 2, F.col("_down"))).over(frame))
                   .filter("_kind = 0 and _row._own")
                   .withColumn("r_mx", F.greatest("_up", "_before")))


def rolling_user_features(df: DataFrame, window_minutes: int = 60, key: str = "user_id",
                          ts_col: str = "event_time", amount_col: str = "transaction_amount",
                          type_col: str = "event_type", location_col: str = "location",
                          failed_type: str = FAILED_LOGIN) -> DataFrame:
    """Append txn_count_1h, avg_amount_1h, max_amount_1h, failed_attempts_1h,
    unique_locations_1h to every row of ``df``.

    A null amount counts as 0, a null location as one more location, a null
    user is a user of its own, a null event type is no failed login.  A row
    without a time has an empty frame (W7): all features 0.
    """
    window_us = int(window_minutes) * MICROS_PER_MINUTE
    base = df.withColumns({
        "_t": epoch_micros(F.col(ts_col)),
        "_u": F.col(key),
        "_c": cents(F.col(amount_col)),
        "_amt": F.coalesce(F.col(amount_col).cast("double"), F.lit(0.0)),
        "_fail": F.coalesce((F.col(type_col) == F.lit(failed_type)).cast("int"), F.lit(0)),
        "_loc": F.coalesce(F.col(location_col), F.lit("")),
    })
    rows = _ranges_with_halo(base, window_us)
    out = _frames(_changes(rows, window_us), window_us)
    timed = F.col("_at").isNotNull()
    zero = F.lit(0).cast("long")
    return out.select(
        *[F.col("_row").getField(c).alias(c) for c in df.columns],
        F.when(timed, F.col("r_n")).otherwise(zero).alias("txn_count_1h"),
        F.when(timed, F.col("r_mx")).otherwise(0.0).alias("max_amount_1h"),
        F.when(timed, F.col("r_f")).otherwise(zero).alias("failed_attempts_1h"),
        F.when(timed, F.col("r_loc")).otherwise(zero).alias("unique_locations_1h"),
        F.when(timed, avg_from_cents(F.col("r_c"), F.col("r_n"))).otherwise(0.0).alias("avg_amount_1h"))
