"""Structured Streaming forms of the batch operators.

The column functions are shared with the batch jobs; only the parts that
streams cannot express change:

* distinct users per window use an exact set size (``count_distinct`` is not
  allowed on streams) or HyperLogLog;
* rolling per-user features (analytic windows are not allowed on streams)
  run in ``transformWithStateInPandas`` with state per group of users holding only the
  last ``window`` of events in time slices, cleared by an event-time timer
  once the group goes idle;
* sinks are ``foreachBatch`` writes keyed by batch id, so a retried batch
  overwrites its own output and readers take the latest version per key.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigil.functions.time import epoch_micros, interval_us
from vigil.operators.rolling import MICROS_PER_MINUTE, avg_from_cents, cents
from vigil.operators.store import latest_by_key
from vigil.operators.summary import fraud_flag, round_to
from vigil.schemas import FAILED_LOGIN

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# The stateful processor below is the only code that runs in Python workers.
# Pickling this module by value ships it with the query, so executors need
# no copy of the package (no --py-files) and see exactly the driver's code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ---------------------------------------------------------------------------
# Staging and sinks
# ---------------------------------------------------------------------------

def stage_time_slices(df: DataFrame, path: str, slices: int, ts_col: str = "ts",
                      to_text: Callable[[DataFrame], DataFrame] | None = None, files: int = 4) -> None:
    """Write ``df`` as ``slices`` consecutive event-time slices, one write per
    slice in time order, so a file stream with ``maxFilesPerTrigger`` replays
    them as in-order micro-batches.  Slice bounds are approximate quantiles
    of the event time (one aggregate).  A slice is written by ``files`` tasks,
    one file each, which is the ``maxFilesPerTrigger`` to read with.  With ``to_text`` (frame -> one string
    column) the slices are written as text lines instead of parquet."""
    t = epoch_micros(F.col(ts_col))
    qs = df.select(t.alias("_t")).approxQuantile("_t", [i / slices for i in range(1, slices)], 0.001)
    bounds = [None] + sorted(set(qs)) + [None]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (t >= F.lit(lo))
        if hi is not None:
            cond = cond & (t < F.lit(hi))
        part = df.filter(cond).repartition(files)
        if to_text is None:
            part.write.mode("append").parquet(path)
        else:
            to_text(part).write.mode("append").text(path)


def write_batches(path: str):
    """``foreachBatch`` function: each micro-batch goes to ``batch_id=N``
    (overwritten on retry, so the sink is idempotent)."""
    def _write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return _write


def read_latest(spark: SparkSession, path: str, key_cols: list[str]) -> DataFrame:
    """Final table of an update-mode sink: the newest version of each key."""
    return latest_by_key(spark.read.parquet(path), key_cols, ["batch_id"]).drop("batch_id")


def with_run_counters(stream: DataFrame, name: str = "run_counters",
                      flag_col: str = "is_fraud") -> DataFrame:
    """A12 on a stream: per-batch counters via ``observe`` (no extra job)."""
    exprs = [F.count(F.lit(1)).alias("processed")]
    if flag_col in stream.columns:
        exprs.append(F.sum(F.col(flag_col).cast("long")).alias("fraud_detected"))
    return stream.observe(name, *exprs)


def finished_progress(query, every_s: float = 0.5) -> list[dict]:
    """Wait for a query to end and return the progress of all its batches.

    Spark keeps the last 100 updates only, so they are gathered while the
    query runs; a batch takes far longer than a hundredth of ``every_s``.
    """
    seen: dict[int, dict] = {}
    while True:
        ended = query.awaitTermination(every_s)
        for p in query.recentProgress:
            if p and (p["batchId"] not in seen or p.get("numInputRows", 0) > 0):
                seen[p["batchId"]] = p
        if ended:
            break
    if query.exception():
        raise query.exception()
    return [seen[k] for k in sorted(seen)]


def run_totals(progress: list[dict]) -> dict:
    """Batches, latency, input rows, rows dropped as later than the watermark
    and summed ``observe`` counters over all batches of a run."""
    observed: dict[str, int] = {}
    for p in progress:
        for metrics in (p.get("observedMetrics") or {}).values():
            row = metrics.asDict() if hasattr(metrics, "asDict") else dict(metrics)
            for k, v in row.items():
                observed[k] = observed.get(k, 0) + (v or 0)
    busy = [p for p in progress if p.get("numInputRows", 0) > 0]
    return {
        "batches": len(busy),
        "avg_batch_ms": round(sum(p["durationMs"].get("triggerExecution", 0) for p in busy) / max(len(busy), 1), 1),
        "max_batch_ms": max((p["durationMs"].get("triggerExecution", 0) for p in busy), default=0),
        "input_rows": sum(p.get("numInputRows", 0) for p in progress),
        "dropped_by_watermark": sum(op.get("numRowsDroppedByWatermark", 0)
                                    for p in progress for op in p.get("stateOperators", [])),
        "observed": observed,
    }


def state_partitions(spark: SparkSession) -> int:
    """Partitions of a stream's state and of what its batches derive: a task slot each, never more than the session's.

    Every batch opens and commits a state store a partition and operator, whatever the rows, so several waves of small
    tasks cost more than they spread."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def start_stream(spark: SparkSession, writer):
    """Start a query with ``state_partitions``.  A query keeps the settings it starts with (and a checkpoint the number
    of partitions it began with), so the session's own are put back at once."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(state_partitions(spark)))
    try:
        return writer.start()
    finally:
        spark.conf.set(name, before)


def run_available(stream: DataFrame, sink_path: str, checkpoint: str, output_mode: str = "update",
                  name: str | None = None) -> dict:
    """Process everything available now, then stop (batch-style runs/tests).
    A production deployment uses ``trigger(processingTime="30 seconds")``.
    Returns the run's totals (``run_totals``)."""
    w = (stream.writeStream.outputMode(output_mode)
         .option("checkpointLocation", checkpoint)
         .foreachBatch(write_batches(sink_path))
         .trigger(availableNow=True))
    if name:
        w = w.queryName(name)
    return run_totals(finished_progress(start_stream(stream.sparkSession, w)))


def kafka_sink(wire: DataFrame, servers: str, topic: str, checkpoint: str, trigger: str = "30 seconds"):
    """(key, value) rows of ``to_wire`` to a Kafka topic."""
    return (wire.select("key", "value").writeStream.format("kafka")
            .option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start())


def console_sink(stream: DataFrame, trigger: str = "30 seconds"):
    """The reference's console sink in update mode."""
    return (stream.writeStream.outputMode("update").format("console")
            .option("truncate", "false").trigger(processingTime=trigger).start())


# ---------------------------------------------------------------------------
# Tumbling summary and dedupe on streams
# ---------------------------------------------------------------------------

def with_event_timestamp(stream: DataFrame, ts_col: str = "event_time") -> DataFrame:
    """Watermarks need TIMESTAMP (not NTZ); the session zone is UTC."""
    return stream.withColumn(ts_col, F.col(ts_col).cast("timestamp"))


def dedupe_stream(stream: DataFrame, key: str = "event_id", ts_col: str = "event_time",
                  watermark: str = "10 minutes") -> DataFrame:
    """S7 on a stream: first copy of each key within the watermark."""
    return stream.withWatermark(ts_col, watermark).dropDuplicatesWithinWatermark([key])


def counters_stream(stream: DataFrame, key: str, amount_col: str | None = None) -> DataFrame:
    """S19 on a stream: a running counter per key (update mode emits the keys
    a batch changed; the state holds one number per key)."""
    value = F.sum(amount_col) if amount_col else F.count(F.lit(1))
    return stream.groupBy(key).agg(value.cast("long").alias("value"))


def tumbling_summary_stream(stream: DataFrame, every: str = "1 minute", watermark: str = "10 minutes",
                            ts_col: str = "event_time", distinct_users: str = "exact") -> DataFrame:
    """Tumbling event-time windows with a watermark (A1–A3 columns).

    ``distinct_users="exact"`` keeps the window's user set in state (exact,
    grows with distinct users per open window); ``"approx"`` keeps a
    HyperLogLog sketch of fixed size.
    """
    ev = stream.withWatermark(ts_col, watermark)
    amt = F.coalesce(F.col("transaction_amount").cast("double"), F.lit(0.0))
    n = F.count(F.lit(1))
    sc = F.sum(cents(F.col("transaction_amount")))
    fc = F.sum(fraud_flag(ev)).cast("long")
    users = (F.size(F.collect_set("user_id")).cast("long") if distinct_users == "exact"
             else F.approx_count_distinct("user_id"))
    agg = ev.groupBy(F.window(ts_col, every).alias("w")).agg(
        n.alias("total_transactions"), (sc / F.lit(100.0)).alias("total_amount"),
        avg_from_cents(sc, n).alias("avg_amount"), F.max(amt).alias("max_amount"),
        F.min(amt).alias("min_amount"), users.alias("unique_users"), fc.alias("fraud_count"),
        round_to(fc / F.greatest(n, F.lit(1)), 4).alias("fraud_rate"))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      *[c for c in agg.columns if c != "w"])


def tumbling_summary_append(stream: DataFrame, every: str = "1 minute", watermark: str = "10 minutes",
                            ts_col: str = "event_time") -> DataFrame:
    """A7 in append mode: each window once, when the watermark has passed it, with exact distinct users and no set.

    Two chained stateful aggregations: one row of state for each (window, user), spread over all partitions and
    evicted with the window, then the window's users are counted and their sums added.  A window of any number of
    users is never held in one row.  A null user counts in the sums, not among the users.
    """
    amt = F.coalesce(F.col("transaction_amount").cast("double"), F.lit(0.0))
    by_user = (stream.withWatermark(ts_col, watermark).groupBy(F.window(ts_col, every).alias("w"), "user_id")
               .agg(F.count(F.lit(1)).alias("n"), F.sum(cents(F.col("transaction_amount"))).alias("sc"),
                    F.max(amt).alias("mx"), F.min(amt).alias("mn"), F.sum(fraud_flag(stream)).cast("long").alias("fc")))
    agg = by_user.groupBy(F.window(F.window_time("w"), every).alias("w")).agg(
        F.sum("n").alias("total_transactions"), F.sum("sc").alias("sc"), F.max("mx").alias("max_amount"),
        F.min("mn").alias("min_amount"), F.count("user_id").alias("unique_users"), F.sum("fc").alias("fraud_count"))
    n = F.col("total_transactions")
    return agg.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total_transactions",
        (F.col("sc") / F.lit(100.0)).alias("total_amount"), avg_from_cents(F.col("sc"), n).alias("avg_amount"), "max_amount",
        "min_amount", "unique_users", "fraud_count", round_to(F.col("fraud_count") / F.greatest(n, F.lit(1)), 4).alias("fraud_rate"))


# ---------------------------------------------------------------------------
# Rolling per-user features with keyed state
# ---------------------------------------------------------------------------

ROLLING_OUT = ("event_id string, user_id string, t_us long, txn_count_1h long, avg_amount_1h double, "
               "max_amount_1h double, failed_attempts_1h long, unique_locations_1h long")
SLICES_PER_WINDOW = 6
USER_GROUPS, ROWS_PER_GROUP = 64, 10_000

# Numbers are stored as the bytes of int64/float64 arrays.  HEAD has an element for each (user, slice): the slice's
# number, rows, cents, failures, largest amount and user, and for each (user, slice, location); SLICE one for each row.
HEAD = ("m binary, n binary, c binary, f binary, a binary, u array<string>, "
        "pair_m binary, pair_u array<string>, pair_l array<string>")
SLICE = "t binary, c binary, f binary, a binary, u array<string>, l array<string>"


def user_groups_for(rows: int) -> int:
    """State keys for a stream whose largest batch has ``rows`` rows: a worker holds a key's rows of a batch together."""
    return max(USER_GROUPS, -(-rows // ROWS_PER_GROUP))


def _half_up(x: np.ndarray) -> np.ndarray:
    r = np.floor(x)
    return r + ((x - r) >= 0.5)


def range_max(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Largest of ``values[lo:hi]`` for each (non-empty) range: maxima of 2**k
    neighbours, one k at a time, so only two rows of the table are held."""
    size = hi - lo
    level = np.frexp(size.astype(np.float64))[1] - 1            # floor(log2(size))
    out = np.empty(len(lo), np.float64)
    table = values
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            table = np.maximum(table[:-(1 << (k - 1))], table[1 << (k - 1):])
        at = level == k
        out[at] = np.maximum(table[lo[at]], table[hi[at] - (1 << k)])
    return out


def range_distinct(pos: np.ndarray, code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Distinct codes at positions in ``[lo, hi)`` for ranges whose two ends never fall back.

    A place counts for a range if it is the code's first one there: ``pos < hi`` and the code's place before it is
    below ``lo``.  Both, once true, stay true for the ranges after, so each place is counted once, at the first range
    where both hold; places below ``lo`` are then taken off.
    """
    order = np.lexsort((pos, code))
    p, c = pos[order], code[order]
    before = np.full(len(p), np.iinfo(np.int64).min)         # a first place has none before it
    same = c[1:] == c[:-1]
    before[1:][same] = p[:-1][same]
    since = np.maximum(np.searchsorted(hi, p, "right"), np.searchsorted(lo, before, "right"))
    counted = np.cumsum(np.bincount(since, minlength=len(lo) + 1))[:len(lo)]
    return counted - np.searchsorted(np.sort(p), lo, "left")


def _codes(*names: np.ndarray) -> list[np.ndarray]:
    """The arrays with equal texts as equal numbers."""
    flat = np.unique(np.concatenate(names).astype(str), return_inverse=True)[1]
    return np.split(flat, np.cumsum([len(x) for x in names])[:-1])


class RollingProcessor(StatefulProcessor):
    """For each group of users, the last window in slices of time.

    State is one value of aggregates per (user, slice) (count, cents, failures, largest amount, locations) and a map of
    the rows of each slice.  The frame ``[t - window, t]`` of a new event is made of whole slices between its two ends,
    which the aggregates stand for, and rows of the two slices it ends in.  A batch reads the aggregates and those
    slices and rewrites the slices its events fall into: a few state calls a group, whatever its users and their rates.

    Aggregates and rows make one sequence by (user, time), a whole slice being one entry at its start.  All frames of
    the batch are then ranges of that sequence, answered together: differences of prefix sums, ``range_max`` and
    ``range_distinct``, no loop over events or users.

    Slices older than ``retain_us`` before the group's newest event go; an event-time timer clears an idle group.
    Exact for in-order events and for late ones within the watermark.
    """

    def __init__(self, window_us: int, slice_us: int, retain_us: int, passthrough: list[str] | None = None):
        self.window_us, self.slice_us, self.retain_us = window_us, slice_us, retain_us
        self.passthrough = passthrough or []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)
        self.rows = handle.getMapState("rows", "m long", SLICE)

    def handleInputRows(self, key, rows, timerValues):
        batches = list(rows)
        new = batches[0] if len(batches) == 1 else pd.concat(batches, ignore_index=True)
        eid, user = (new[c].to_numpy(dtype=object).astype(str) for c in ("event_id", "user_id"))
        order = np.lexsort((eid, new["t"].to_numpy(np.int64), user))
        fresh = [new[c].to_numpy(d)[order] for c, d in (("t", np.int64), ("c", np.int64), ("f", np.int64), ("a", np.float64),
                                                        ("user_id", object), ("l", object))]
        nt = fresh[0]
        own = nt // self.slice_us

        head = self._load_head()
        first_time = head is None
        m, n, c, f, a, u, pair_m, pair_u, pair_l = head or self._no_head()
        stored = {k: self._load_slice(k) for k in
                  np.intersect1d(np.union1d(own, (nt - self.window_us) // self.slice_us), m).tolist()}

        # One sequence: slices not read, as one entry per user; rows of the slices read; the new rows.
        read = list(stored)
        whole, far = ~np.isin(m, read), ~np.isin(pair_m, read)
        parts = [[m[whole] * self.slice_us, c[whole], f[whole], a[whole], u[whole]]] + [s[:5] for s in stored.values()] + [fresh[:5]]
        t, cs, fs, am, us = (np.concatenate(x) for x in zip(*parts))
        ns = np.ones(len(t), np.int64)
        ns[:int(whole.sum())] = n[whole]
        # Locations: those of whole slices stand at the slice's start, like its entry.
        loc_t = np.concatenate([pair_m[far] * self.slice_us] + [s[0] for s in stored.values()] + [nt])
        loc = np.concatenate([pair_l[far]] + [s[5] for s in stored.values()] + [fresh[5]])
        loc_u = np.concatenate([pair_u[far]] + [s[4] for s in stored.values()] + [fresh[4]])

        uc, new_u, loc_uc = _codes(us, fresh[4], loc_u)
        times = np.unique(np.concatenate([t, nt - self.window_us]))          # ranks: (user, time) in one number
        place = lambda who, when: who * len(times) + np.searchsorted(times, when)
        at = place(uc, t)
        by_place = np.argsort(at, kind="stable")
        at, cs, fs, am, ns = at[by_place], cs[by_place], fs[by_place], am[by_place], ns[by_place]
        first, last = place(new_u, nt - self.window_us), place(new_u, nt)
        lo, hi = np.searchsorted(at, first, "left"), np.searchsorted(at, last, "right")
        pn, pc, pf = (np.concatenate([[0], np.cumsum(x)]) for x in (ns, cs, fs))
        cnt = pn[hi] - pn[lo]
        out = pd.DataFrame({
            "event_id": eid[order], "user_id": fresh[4], "t_us": nt,
            "txn_count_1h": cnt, "avg_amount_1h": _half_up((pc[hi] - pc[lo]) / cnt) / 100.0,
            "max_amount_1h": range_max(am, lo, hi), "failed_attempts_1h": pf[hi] - pf[lo],
            "unique_locations_1h": range_distinct(place(loc_uc, loc_t), _codes(loc)[0], first, last + 1),
        })
        for col in self.passthrough:
            out[col] = new[col].to_numpy(dtype=object)[order]

        # Slices that the batch falls into and that stay are written again, with their aggregates.
        newest = max(int(nt.max()), int(m.max(initial=own.max())) * self.slice_us)
        oldest = (newest - self.retain_us) // self.slice_us
        touched = np.unique(own[own >= oldest])
        for k in touched.tolist():
            r = [v[own == k] for v in fresh]
            if k in stored:
                r = [np.concatenate(v) for v in zip(stored[k], r)]
            stored[k] = r
            self.rows.updateValue((k,), (*(v.tobytes() for v in r[:4]), r[4].tolist(), r[5].tolist()))
        for k in np.unique(m[m < oldest]).tolist():
            self.rows.removeKey((k,))
        stays, pairs_stay = (m >= oldest) & ~np.isin(m, touched), (pair_m >= oldest) & ~np.isin(pair_m, touched)
        again = pd.concat([pd.DataFrame(dict(zip("tcfaul", stored[k]))).assign(m=k) for k in touched.tolist()])
        sums = again.groupby(["u", "m"], sort=False).agg(n=("t", "size"), c=("c", "sum"), f=("f", "sum"), a=("a", "max")).reset_index()
        pairs = again[["m", "u", "l"]].drop_duplicates()
        joined = lambda old, stay, col, kind: np.concatenate([old[stay], col.to_numpy(kind)])
        ints = {x: joined(v, stays, sums[x], np.int64).tobytes() for x, v in zip("mncf", (m, n, c, f))}
        self.head.update((*ints.values(), joined(a, stays, sums["a"], np.float64).tobytes(), joined(u, stays, sums["u"], object).tolist(),
                          joined(pair_m, pairs_stay, pairs["m"], np.int64).tobytes(),
                          joined(pair_u, pairs_stay, pairs["u"], object).tolist(),
                          joined(pair_l, pairs_stay, pairs["l"], object).tolist()))
        if first_time:
            self.handle.registerTimer(self._expiry_ms(newest // self.slice_us))
        yield out

    @staticmethod
    def _no_head():
        i, x, o = np.empty(0, np.int64), np.empty(0, np.float64), np.empty(0, object)
        return i, i, i, i, x, o, i, o, o

    def _load_head(self):
        row = self.head.get() if self.head.exists() else None
        if row is None:
            return None
        m, n, c, f, pair_m = (np.frombuffer(bytes(row[i]), np.int64) for i in (0, 1, 2, 3, 6))
        u, pair_u, pair_l = (np.array(list(row[i]), object) for i in (5, 7, 8))
        return m, n, c, f, np.frombuffer(bytes(row[4]), np.float64), u, pair_m, pair_u, pair_l

    def _load_slice(self, k: int):
        row = self.rows.getValue((k,))
        t, c, f = (np.frombuffer(bytes(row[i]), np.int64) for i in range(3))
        return [t, c, f, np.frombuffer(bytes(row[3]), np.float64), np.array(list(row[4]), object), np.array(list(row[5]), object)]

    def _expiry_ms(self, newest_slice: int) -> int:
        return ((newest_slice + 1) * self.slice_us + self.retain_us) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        head = self._load_head()
        if head is not None and self._expiry_ms(int(head[0].max())) > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(self._expiry_ms(int(head[0].max())))
        else:
            self.head.clear()
            self.rows.clear()
        return iter([])

    def close(self) -> None:
        pass


def rolling_features_stream(stream: DataFrame, window_minutes: int = 60, failed_type: str = FAILED_LOGIN,
                            watermark: str = "10 minutes", ts_col: str = "event_time",
                            passthrough: list[str] | None = None, dedupe: bool = True,
                            slices: int = SLICES_PER_WINDOW, user_groups: int = USER_GROUPS) -> DataFrame:
    """W1–W6 on a stream, keyed by groups of users, plus the ``passthrough`` columns
    of each event (for downstream scoring and rules).  Copies of an event
    within the watermark count once (D9); rows without a time are left out.

    ``slices`` is the number of state slices per window: more of them mean
    fewer rows rewritten per batch for a dense user and more state calls.
    ``user_groups`` is the number of state keys, which users are hashed to:
    several per shuffle partition, fixed for the life of a checkpoint, more
    for large batches (``user_groups_for``).
    Needs the RocksDB state store provider (set here if the session has
    none)."""
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        # A commit then writes the batch's changes; whole snapshots follow in the background.
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    window_us = int(window_minutes) * MICROS_PER_MINUTE
    passthrough = [c for c in (passthrough or []) if c not in ("event_id", "user_id", ts_col)]
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    out_schema = ROLLING_OUT + "".join(f", {c} {types[c]}" for c in passthrough)
    # A row without a time has no frame (the pipeline quarantines it before).
    timed = stream.filter(F.col(ts_col).isNotNull()).withWatermark(ts_col, watermark)
    if dedupe:
        timed = timed.dropDuplicatesWithinWatermark(["event_id"])
    prepared = (timed
                .select("event_id", F.coalesce(F.col("user_id"), F.lit("unknown")).alias("user_id"),
                        ts_col, *passthrough,
                        epoch_micros(F.col(ts_col)).alias("t"),
                        cents(F.col("transaction_amount")).alias("c"),
                        F.coalesce(F.col("transaction_amount").cast("double"), F.lit(0.0)).alias("a"),
                        F.coalesce((F.col("event_type") == F.lit(failed_type)).cast("int"), F.lit(0)).alias("f"),
                        F.coalesce(F.col("location"), F.lit("")).alias("l")))
    processor = RollingProcessor(window_us, max(window_us // slices, 1), window_us + interval_us(watermark), passthrough)
    return (prepared.withColumn("user_group", F.pmod(F.xxhash64("user_id"), F.lit(user_groups))).groupBy("user_group")
            .transformWithStateInPandas(processor, out_schema, "append", "EventTime"))
