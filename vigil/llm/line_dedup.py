"""Removal of runs of lines that occurred before, by winnowing.

A document is the sequence of its lines (split at \\n) that hold a word.  From each line on, the fewest consecutive lines
that hold ``LEAST_WORDS`` words together are a window; a long line is a window alone, short ones need company, and
towards the end of a document there may be none.  Of a window's lines the one with the smallest hash (the last of
equals) is its fingerprint, which neighbouring windows mostly share, and two equal windows have it at the same place.
Fingerprints that occur once anywhere are done with: most of the text.  A repeated fingerprint carries the hashes of
the windows around it that chose it; the first place of each such window, by (doc_id, line), is kept, and at later places
the match is extended over all the windows that agree, both ways, and its lines are deleted.  Hence: a line goes if and
only if it lies in a window that also starts earlier.  Any repeated passage of whole lines with ``LEAST_WORDS`` words goes,
be it one line or many; a short line that is repeated by itself stays.

A fingerprint or window found in a third of all documents costs rows in proportion to its occurrences: occurrences meet
the first place, which a partial aggregate finds and a table holds, never one another, so the join can be split.

Cases: null text stays null; lines without a word are no lines here and stay; a document of fewer than ``LEAST_WORDS``
words never changes, nor does a row with a null id; rows with the same id and text are one place, so neither is later;
rows that share an id but not the text are ordered by a hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.quality import line_ranges
from vigil.llm.shared import tidy, written
from vigil.llm.words import Ranges, Slice, longs, signed, slices

LEAST_WORDS = 20
PLACE = "id long, h long, mark long, runs array<struct<run:long,line:int>>"
LINE_BASE = 0xC2B2AE3D27D4EB4F


def line_windows(part: Slice, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First line and the line after the last of every window of at least ``least`` words."""
    words = np.concatenate([[0], np.cumsum(np.searchsorted(part.starts, ends) - np.searchsorted(part.starts, starts))])
    after = np.searchsorted(words, words[:-1] + least)
    at = np.flatnonzero(after <= len(doc))
    at = at[doc[at] == doc[after[at] - 1]]
    return at, after[at]


def _smallest(hashes: np.ndarray, at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The line of each window with the smallest hash, the last of equals."""
    best = at.copy()
    for k in range(1, int((after - at).max(initial=1))):  # at most as many lines as a window has words
        here = np.flatnonzero(at + k < after)
        lower = hashes[at[here] + k] <= hashes[best[here]]
        best[here[lower]] = at[here[lower]] + k
    return best


def _fingerprints(least: int):
    def work(batches):
        for batch in batches:
            ids, _ = longs(batch.column(0))
            texts, _ = longs(batch.column(1))
            for part in slices(batch.column(2)):
                starts, ends, doc = line_ranges(part)
                at, after = line_windows(part, starts, ends, doc, least)
                if not len(at):
                    continue
                hashes = part.hash_bytes(starts, ends)
                window = Ranges(hashes, LINE_BASE)(at, after)
                chosen = _smallest(hashes, at, after)
                first_line = np.searchsorted(doc, np.arange(len(part.rows)))
                new = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
                rows = part.rows.start + doc[chosen[new]]
                inner = pa.StructArray.from_arrays([pa.array(signed(window)), pa.array((at - first_line[doc[at]]).astype(np.int32))],
                                                   names=["run", "line"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[rows]), pa.array(texts[rows]), pa.array(signed(hashes[chosen[new]])),
                    pa.ListArray.from_arrays(pa.array(np.append(new, len(at)).astype(np.int32)), inner),
                ], names=["id", "h", "mark", "runs"])
    return work


def _without(least: int):
    def work(texts: pa.Array, firsts: pa.Array) -> pa.Array:
        out, lines, removed = texts.to_pylist(), [], []
        edges, values = np.asarray(firsts.offsets), np.asarray(firsts.values)
        gone_any = np.asarray(firsts.is_valid())
        for part in slices(texts):
            starts, ends, doc = line_ranges(part)
            first_line = np.searchsorted(doc, np.arange(len(part.rows) + 1))
            after = np.zeros(len(doc), np.int64)
            windows, after_last = line_windows(part, starts, ends, doc, least)
            after[windows] = after_last
            for k, row in enumerate(part.rows):
                n = first_line[k + 1] - first_line[k]
                lines.append(n)
                removed.append(0)
                if not gone_any[row]:
                    continue
                gone = np.zeros(n, bool)
                for line in values[edges[row]:edges[row + 1]]:
                    gone[line:after[first_line[k] + line] - first_line[k]] = True
                removed[-1] = int(gone.sum())
                deleted = set((starts[first_line[k]:first_line[k + 1]][gone] - part.edges[k]).tolist())
                kept, at = [], 0
                for line in out[row].encode().split(b"\n"):
                    if at not in deleted:
                        kept.append(line)
                    at += len(line) + 1
                out[row] = b"\n".join(kept).decode()
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(removed, pa.int64())],
                                          names=["text", "n_lines", "n_removed"])
    return work


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, h, firsts): for each document the places (line numbers) at which a run starts that occurred before."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"),
                       F.col(text_col).cast("string").alias("text"))
    marks = written(base.where("id is not null").mapInArrow(tidy(_fingerprints(least_words)), PLACE), "fingerprints")
    again = written(marks.groupBy("mark").agg(F.count("*").alias("c")).where("c > 1").select("mark"), "repeated")
    runs = written(marks.join(again, "mark").select("id", "h", F.inline("runs")), "runs")
    place = F.struct("id", "h", "line")
    first = runs.groupBy("run").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    first = written(first.select("run", "first"), "first-places")
    later = runs.join(first, "run").where(place > F.col("first"))
    return later.groupBy("id", "h").agg(F.collect_set("line").alias("firsts"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_words: int = LEAST_WORDS,
                    name: str = "line_dedup") -> DataFrame:
    """``docs`` with the repeated lines out of its text and a struct column ``name`` (n_lines, n_removed).

    A column of that name in ``docs`` is replaced.
    """
    @F.arrow_udf("struct<text:string,n_lines:long,n_removed:long>")
    def cut(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        yield from tidy(lambda some: (_without(least_words)(*columns) for columns in some))(batches)

    text: Column = F.col(text_col).cast("string")
    found = repeated_runs(docs, id_col, text_col, least_words).toDF("__id", "__h", "__firsts")
    joined = docs.withColumn("__h0", F.xxhash64(text)).join(
        found, (F.col(id_col).cast("long") == F.col("__id")) & (F.col("__h0") == F.col("__h")), "left")
    # Nondeterministic, or a filter on the counts would run it a second time.
    done = joined.withColumn("__cut", cut.asNondeterministic()(text, F.col("__firsts")))
    return (done.withColumn(text_col, F.col("__cut.text")).withColumn(name, F.struct("__cut.n_lines", "__cut.n_removed"))
            .select(*docs.columns if name in docs.columns else [*docs.columns, name]))
