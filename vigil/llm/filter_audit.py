"""How filters interact: what each removes in every order they can be applied in.

Whether a document passes each filter is a mask of one bit a filter.  The mask alone decides at which step of an order
the document goes: at the first filter it fails.  So every mask is mapped to one big integer of 64-bit fields: a field
for each (order, step), one where the document goes; a field for each filter it fails and for each filter that it alone
fails; and one for the document itself.  Integers are added: over a task's documents, then up a tree of at most
``FAN_IN`` sums a group, per part.  A field counts documents, so below 2**63 of them none carries into the next.
Unpacking is a view of the sum's bytes as 64-bit numbers.  Three sums are kept, of all, of good and of toxic documents.

The filter for copies fails a text that a document of smaller id has.  Equal texts meet by their SHA-256, after their
documents of one part, mask and label are counted, so a text of a third of all documents is a row for each of those.

Cases: null text is empty, null part the empty string.  Rows that repeat an id are documents each, and none of them is
a copy of another of that id.  A null id is no smaller id, fails no copy filter and has no labels.  Labels that repeat
an id count if any of their rows says 1.  Empty documents give no rows.  Columns of any other name are not looked at.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.shared import written

FIELD = 8  # bytes of a counter's field
KINDS = 3  # all, good, toxic
FAN_IN = 256
PARTS_HELD = 1000  # sums a task holds before it passes them on
COPY = "E"
COUNTER = "part string, at long, counter binary"
REPORT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions by filter letter, of a text that is not null."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def orders(letters: str) -> list[str]:
    return ["".join(p) for p in itertools.permutations(letters)]


def packed_masks(letters: str) -> list[int]:
    """For each mask (bit k: the document fails letter k) the integer of its fields."""
    ways, n = orders(letters), len(letters)
    out = []
    for mask in range(1 << n):
        fails = {x for k, x in enumerate(letters) if mask >> k & 1}
        fields = [int(x in fails and not fails & set(way[:s])) for way in ways for s, x in enumerate(way)]
        fields += [int(x in fails) for x in letters] + [int(fails == {x}) for x in letters] + [1]
        out.append(sum(v << 8 * FIELD * k for k, v in enumerate(fields)))
    return out


def _width(letters: str) -> int:
    return FIELD * (len(orders(letters)) * len(letters) + 2 * len(letters) + 1)


def _flush(sums: dict, at: int, width: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(list(sums), pa.string()), pa.array([at] * len(sums), pa.int64()),
        pa.array([b"".join(x.to_bytes(width, "little") for x in own) for own in sums.values()], pa.binary())],
        names=["part", "at", "counter"])


def _add_masks(letters: str):
    """(part, mask, good, toxic, n) -> a task's sum for each part."""
    def run(batches):
        masks, width, at, sums = packed_masks(letters), _width(letters), TaskContext.get().partitionId(), {}
        for batch in batches:
            for part, mask, good, toxic, n in zip(*(c.to_pylist() for c in batch.columns)):
                own = sums.setdefault(part, [0] * KINDS)
                for k, counts in enumerate((True, good, toxic)):
                    if counts:
                        own[k] += n * masks[mask]
                if len(sums) >= PARTS_HELD:
                    yield _flush(sums, at, width)
                    sums.clear()
        yield _flush(sums, at, width)
    return run


def _add_counters(width: int):
    def run(group: pa.Table) -> pa.Table:
        total = [0] * KINDS
        for counter in group.column("counter").to_pylist():
            for k in range(KINDS):
                total[k] += int.from_bytes(counter[k * width:(k + 1) * width], "little")
        sums = {group.column("part")[0].as_py(): total}
        return pa.Table.from_batches([_flush(sums, group.column("at")[0].as_py(), width)])
    return run


def _unpack(letters: str):
    def run(batches):
        ways, n = orders(letters), len(letters)
        for batch in batches:
            for part, counter in zip(batch.column("part").to_pylist(), batch.column("counter").to_pylist()):
                fields = np.frombuffer(counter, "<i8").reshape(KINDS, -1)
                gone = fields[:, :len(ways) * n].reshape(KINDS, len(ways), n)
                fails, alone, docs = (fields[0, len(ways) * n:][a:b] for a, b in ((0, n), (n, 2 * n), (2 * n, None)))
                own = np.array([[letters.index(x) for x in way] for way in ways])
                share = np.array([gone[0][own == k].sum() for k in range(n)])
                columns = [docs[0] - gone[0].cumsum(axis=1), gone[0], fails[own] - gone[0], alone[own], gone[1], gone[2], share[own]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * own.size, pa.string()), pa.array(np.repeat(ways, n), pa.string()),
                    pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(ways))), *(pa.array(c.ravel()) for c in columns)],
                    names=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])
    return run


def masks(docs: DataFrame, labels: DataFrame, failures: dict[str, Column] | None = None, *, id_col: str = "doc_id",
          text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): how many documents fail just these filters.

    ``failures`` are conditions over a column ``text``; the filter for copies takes the last bit.
    """
    failures = text_failures(F.col("text")) if failures is None else failures
    bits = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failures.values())), F.lit(0))
    rows = (docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
            .select("id", "part", bits.alias("mask"), F.unhex(F.sha2("text", 256)).alias("key"))
            .groupBy("id", "part", "mask", "key").agg(F.count("*").alias("c")))
    rows = written(rows, "masks")
    known = (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id"))
             .agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
                  F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")))
    no = F.lit(False)
    labelled = (rows.where("id is not null").join(known, "id", "left")
                .select("id", "part", "mask", "key", "c", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
                .unionByName(rows.where("id is null").withColumns({"good": no, "toxic": no})))
    # An id is once in such a group, so the count of its smallest id is the count of one row.
    texts = written(labelled.groupBy("key", "part", "mask", "good", "toxic")
             .agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("c"))), F.lit(0)).alias("free"),
                  F.min("id").alias("low"), F.min_by("c", "id").alias("first")), "texts")
    lows = texts.groupBy("key").agg(F.min("low").alias("lowest"))
    first = F.col("free") + F.when(F.col("low") == F.col("lowest"), F.col("first")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("mask"), first.alias("n")),
                   F.struct((F.col("mask") + (1 << len(failures))).alias("mask"), (F.col("n") - first).alias("n")))
    return (texts.join(lows, "key").select("part", "good", "toxic", F.inline(both)).where("n > 0")
            .select("part", F.col("mask").cast("int").alias("mask"), "good", "toxic", "n"))


def audit(docs: DataFrame, labels: DataFrame, failures: dict[str, Column] | None = None, **columns: str) -> DataFrame:
    """A row for each part, order of the filters and step; see ``REPORT``.

    kept after the step; removed at it; redundant: fail its filter but went before; unique_fails: fail its filter only;
    good_lost, toxic_lost: of those removed; shapley: what its filter removes, summed over all orders.
    """
    letters = "".join(text_failures(F.lit("")) if failures is None else failures) + COPY
    counted = masks(docs, labels, failures, **columns)
    sums = written(counted.mapInArrow(_add_masks(letters), COUNTER), "counters")
    tasks = (sums.agg(F.max("at")).first()[0] or 0) + 1
    while True:
        tasks = -(-tasks // FAN_IN)
        sums = (sums.withColumn("at", F.expr(f"at div {FAN_IN}")).groupBy("part", "at")
                .applyInArrow(_add_counters(_width(letters)), COUNTER))
        if tasks == 1:
            return sums.mapInArrow(_unpack(letters), REPORT)
        sums = written(sums, "counters")
