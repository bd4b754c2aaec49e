"""Removal of word windows that already occurred in a document with a smaller id.

Documents are range-partitioned by id into chunks of a few megabytes, written once as a bucketed table, so that each of
three passes finds its chunk's texts in place and ids of a lower chunk are smaller than those of a higher one.

1. Every chunk sketches the windows of its documents: the cells that their hashes fall into.  Sketches travel as
   sorted gaps, cut by cell range; where they meet, a cell that two chunks or more have is estimated repeated.  The
   sketch is a count-min sketch of one row, with counts saturating at two and cells in proportion to the corpus: it only
   ever overestimates, by about 6 % of the windows at any size, and no task or driver holds more than a range of it.
2. Each chunk gets its repeated cells back and sends the windows in them, each once, to be grouped exactly by hash;
   the lowest chunk that has a window keeps it, the others learn that they lose it (one bit a window).
3. Inside a chunk the smallest id with a window keeps it.  Words covered by a window that is lost in either way go.

A window that occurs in a third of all documents is one entry a chunk.  Windows are judged on the input texts.

Cases: null text has no words; texts shorter than a window never change, nor do rows with a null id, which count for no
other row either; rows with equal ids don't affect each other; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.shared import ids_and_texts, written
from vigil.llm.words import longs, slices
from vigil.session import ensure_checkpoint_dir

WINDOW, CHUNK_BYTES, SEGMENT_BYTES = 13, 4 << 20, 8 << 20
CELLS_PER_WINDOW = 16
ESCAPE = 65535
PARTS = "chunk long, segment long, cells binary"
EXACT = "chunk long, segment long, hashes binary"
LOST = "chunk long, segment long, lost binary"
KEPT = "id long, n_words long, n_removed long, text string"


def gaps(sorted_cells: np.ndarray, base: int) -> bytes:
    """Distinct sorted numbers from ``base`` on as 16-bit gaps; ESCAPE stands for that many without a number."""
    steps = np.diff(np.concatenate([[base - 1], sorted_cells.astype(np.int64)])) - 1
    skips, rest = np.divmod(steps, ESCAPE)
    at = np.cumsum(skips + 1) - 1
    out = np.full(at[-1] + 1 if len(at) else 0, ESCAPE, np.uint16)
    out[at] = rest
    return out.tobytes()


def ungap(data: bytes, base: int) -> np.ndarray:
    steps = np.frombuffer(data, np.uint16).astype(np.int64)
    number = steps != ESCAPE
    return (np.cumsum(steps + number) + base - 1)[number]


class Chunk:
    """The documents of a chunk in the order of their ids, and their windows' hashes."""

    def __init__(self, table: pa.Table, window: int):
        table = table.combine_chunks()
        ids, self.there = longs(table.column("id").combine_chunks() if table.num_rows else pa.array([], pa.int64()))
        order = np.lexsort((ids, ~self.there))
        self.ids, self.there = ids[order], self.there[order]
        texts = table.column("text").take(pa.array(order)) if table.num_rows else table.column("text")
        self.texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        hashes, docs, firsts, words = [], [], [], []
        for part in slices(self.texts):
            h, doc, first = part.windows(window)
            live = self.there[part.rows.start + doc]
            hashes.append(h[live])
            docs.append(part.rows.start + doc[live])
            firsts.append((first - part.word_edges[doc])[live])
            words.append(part.n_words)
        none = np.zeros(0, np.int64)
        self.hashes = np.concatenate([*hashes, none.astype(np.uint64)])
        self.docs, self.firsts, self.words = (np.concatenate([*x, none]) for x in (docs, firsts, words))


class Layout:
    """Cells and their ranges: the first ``bits`` bits of a hash are its cell, cells are cut into equal segments."""

    def __init__(self, bits: int, segments: int):
        self.bits, self.segments = bits, segments
        self.width = -(-(1 << bits) // segments)

    def cells(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def cut(self, sorted_cells: np.ndarray):
        """(segment, start, end) of the segments that have cells."""
        edges = np.searchsorted(sorted_cells, np.arange(self.segments + 1) * self.width)
        return [(s, a, b) for s, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if b > a]


def _rows(chunk: int, rows: list[tuple[int, bytes]], schema: str) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.table({names[0]: pa.array([chunk] * len(rows), pa.int64()), names[1]: pa.array([s for s, _ in rows], pa.int64()),
                     names[2]: pa.array([b for _, b in rows], pa.binary())})


def _sketch(layout: Layout, window: int):
    def work(key, table):
        cells = np.unique(layout.cells(Chunk(table, window).hashes))
        return _rows(key[0].as_py(), [(s, gaps(cells[a:b], s * layout.width)) for s, a, b in layout.cut(cells)], PARTS)
    return work


def _repeated(layout: Layout):
    """All chunks' cells of a segment -> for each chunk those that another chunk has too."""
    def work(key, table):
        segment = key[0].as_py()
        base = segment * layout.width
        parts = [ungap(x, base) for x in table.column("cells").to_pylist()]
        cells = np.sort(np.concatenate(parts))
        many = np.unique(cells[1:][cells[1:] == cells[:-1]])
        rows = [(c, gaps(own, base)) for c, p in zip(table.column("chunk").to_pylist(), parts)
                if len(own := np.intersect1d(p, many, True))]
        return pa.table({"chunk": pa.array([c for c, _ in rows], pa.int64()), "segment": pa.array([segment] * len(rows), pa.int64()),
                         "cells": pa.array([b for _, b in rows], pa.binary())})
    return work


def _suspects(layout: Layout, hashes: np.ndarray, replies: pa.Table) -> np.ndarray:
    """Sorted distinct hashes whose cells were estimated repeated."""
    cells = [ungap(b, s * layout.width) for s, b in sorted(zip(replies.column("segment").to_pylist(), replies.column("cells").to_pylist()))]
    if not cells:
        return np.zeros(0, np.uint64)
    cells, hashes = np.concatenate(cells), np.unique(hashes)
    own = layout.cells(hashes)
    return hashes[cells[np.minimum(np.searchsorted(cells, own), len(cells) - 1)] == own]


def _send(layout: Layout, window: int):
    def work(key, docs, replies):
        if not docs.num_rows:
            return _rows(0, [], EXACT)
        hashes = _suspects(layout, Chunk(docs, window).hashes, replies)
        return _rows(key[0].as_py(), [(s, hashes[a:b].tobytes()) for s, a, b in layout.cut(layout.cells(hashes))], EXACT)
    return work


def _decide(key, table):
    """All chunks' suspects of a segment -> for each chunk a bit a suspect: a lower chunk has it."""
    table = table.combine_chunks().sort_by("chunk")
    parts = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    every = np.concatenate(parts)
    _, first, which = np.unique(every, return_index=True, return_inverse=True)  # the first is in the lowest chunk
    lost = first[which] < np.repeat(np.cumsum([0, *map(len, parts)])[:-1], [len(p) for p in parts])
    edges = np.cumsum([0, *map(len, parts)])
    bits = [np.packbits(lost[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:])]
    return pa.table({"chunk": table.column("chunk"), "segment": table.column("segment"), "lost": pa.array(bits, pa.binary())})


def _finish(layout: Layout, window: int):
    def work(key, docs, replies):
        if not docs.num_rows:
            return pa.table({c.split()[0]: pa.array([], pa.string() if c.endswith("string") else pa.int64()) for c in KEPT.split(", ")})
        chunk = Chunk(docs, window)
        hashes = chunk.hashes
        order = np.argsort(hashes, kind="stable")  # windows come by id, so the first of equals has the smallest
        ordered = hashes[order]
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        start = np.flatnonzero(new)
        holder = chunk.ids[chunk.docs[order[start]]] if len(start) else np.zeros(0, np.int64)
        gone = np.zeros(len(hashes), bool)
        gone[order] = chunk.ids[chunk.docs[order]] > np.repeat(holder, np.diff(np.append(start, len(ordered))))
        marked = replies.select(["segment", "cells"]).filter(pc.is_valid(replies.column("cells")))
        suspects = _suspects(layout, hashes, marked)
        bits = {s: b for s, b in zip(replies.column("segment").to_pylist(), replies.column("lost").to_pylist()) if b is not None}
        if bits:
            lost = np.concatenate([suspects[a:b][np.unpackbits(np.frombuffer(bits[s], np.uint8), count=b - a).astype(bool)]
                                   for s, a, b in layout.cut(layout.cells(suspects))])
            if len(lost):
                gone |= lost[np.minimum(np.searchsorted(lost, hashes), len(lost) - 1)] == hashes
        edges = np.concatenate([[0], np.cumsum(chunk.words)])
        cover = np.zeros(edges[-1] + 1, np.int64)
        at = edges[chunk.docs[gone]] + chunk.firsts[gone]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + window, -1)
        keep = np.cumsum(cover)[:-1] == 0
        n_kept = np.concatenate([[0], np.cumsum(keep)])
        kept = n_kept[edges[1:]] - n_kept[edges[:-1]]
        texts = []
        for k, text in enumerate(chunk.texts.to_pylist()):
            words = (text or "").encode().split()
            if kept[k] < chunk.words[k]:
                words = compress(words, keep[edges[k]:edges[k + 1]].tolist())
            texts.append(b" ".join(words).decode())
        return pa.table({"id": pa.array(chunk.ids, mask=~chunk.there), "n_words": pa.array(chunk.words.astype(np.int64)),
                         "n_removed": pa.array((chunk.words - kept).astype(np.int64)), "text": pa.array(texts, pa.string())})
    return work


def _chunked(base: DataFrame, chunks: int) -> DataFrame:
    """The documents as a table bucketed by chunk; chunks are ranges of ids."""
    spark, name = base.sparkSession, f"llm_chunks_{uuid.uuid4().hex}"
    (base.repartitionByRange(chunks, "id").withColumn("chunk", F.spark_partition_id().cast("long"))
     .write.bucketBy(chunks, "chunk").option("compression", "zstd")
     .option("path", f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}").saveAsTable(name))
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay in the shared folder; the frame has them and their buckets
    return table


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW,
                    chunk_bytes: int = CHUNK_BYTES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, n_removed, text (the kept words joined by one space)."""
    base = ids_and_texts(docs, id_col, text_col)
    total = int(base.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    layout = Layout(max(10, (CELLS_PER_WINDOW * total // 5).bit_length()), max(1, -(-total // segment_bytes)))
    table = _chunked(base, max(1, -(-total // chunk_bytes)))
    parts = table.groupBy("chunk").applyInArrow(_sketch(layout, window), PARTS)
    replies = written(parts.groupBy("segment").applyInArrow(_repeated(layout), PARTS), "repeated-cells")
    exact = table.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_send(layout, window), EXACT)
    lost = exact.groupBy("segment").applyInArrow(_decide, LOST)
    answers = replies.withColumn("lost", F.lit(None).cast("binary")).unionByName(lost.withColumn("cells", F.lit(None).cast("binary")))
    return (table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_finish(layout, window), KEPT)
            .withColumnRenamed("id", id_col))
