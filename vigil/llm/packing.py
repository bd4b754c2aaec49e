"""Token sequences of a fixed length, filled by hierarchical best fit.

Texts become token ids plus an end id; only documents longer than a sequence are cut.  Pieces are dealt by a hash of
their number to nodes of about ``DEAL``, so that each has the corpus's mix of lengths however it is stored, and every
node packs its own by best fit, longest first.  Bins with at most ``slack`` tokens to spare are final; the others go up
a tree in which a node packs the underfull bins of ``FAN_IN`` nodes, as items, by best fit again.

A node passes on its emptiest ``CARRY`` bins, the rest of its bins being final, so no task holds more than ``FAN_IN *
CARRY`` bins.  That costs no sequence: best fit opens a bin only for what fits in no other, so no two bins of a node go
together and at most one is half empty.  A node above therefore moves at most ``FAN_IN`` bins, and what fits into a bin
held back fits into every one passed on, as those have more room.

Token ids are those of the whole text: the tokenizer lower-cases and never joins across white space, nor a letter with
ASCII punctuation, so words and the punctuation behind them are looked up in a bounded table and only new ones are
encoded.

Cases: null text is empty and gives one piece, the end id alone; rows that repeat an id are packed each; null ids are
carried along; no rows give no sequences.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.shared import ids_and_texts, release, tidy, written

LENGTH, END_ID, SLACK, FAN_IN, CARRY, DEAL = 4096, 1, 16, 8, 4096, 1 << 16
KNOWN_WORDS = 1 << 16  # of a generation, and what one batch adds; two generations are kept, about 90 MB a worker
TEXT_BYTES = 4 << 20
PUNCTUATION = ".,;:!?#$%&*"
PIECES = "uid long, id long, piece int, start long, length long, ids binary"
BINS = "done boolean, node long, bin long, fill int, uids array<long>, offsets array<int>"


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    """The tokenizer, which ids end a word, and the ids of words met: the current generation and the one before."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ends = np.array([(tokenizer.id_to_token(k) or "").endswith("</w>") for k in range(tokenizer.get_vocab_size())])
    return tokenizer, ends, [{}, {}]


def _encode_new(tokenizer, ends: np.ndarray, words: list[str], known: dict[str, bytes]) -> None:
    """Adds the ids of new words.  Words of Latin-1 letters alone are one unit each, whose last token ends a word, so
    many are encoded as one text; all others by themselves."""
    plain = [w for w in words if w.isalpha() and max(w) <= "ÿ"]
    other = [w for w in words if not (w.isalpha() and max(w) <= "ÿ")]
    for w, got in zip(other, tokenizer.encode_batch_fast(other, add_special_tokens=False)):
        known[w] = array("I", got.ids).tobytes()
    for lo in range(0, len(plain), 256):
        some = plain[lo:lo + 256]
        ids = np.array(tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
        data, cuts = ids.tobytes(), (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
        for w, a, b in zip(some, [0, *cuts[:-1]], cuts, strict=True):
            known[w] = data[a:b]


def encode(texts: pa.Array, path: str) -> tuple[memoryview, np.ndarray]:
    """Ids of all texts as unsigned 32-bit numbers (little-endian, as the machines are), and where each text's begin.

    The distinct words of the texts are looked up, the rest is done on columns.
    """
    tokenizer, ends, generations = _tokenizer(path)
    if len(generations[0]) > KNOWN_WORDS:
        generations[:] = {}, generations[0]  # words still in use move over, the others go with the next change
    known, older = generations
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = words.values.dictionary_encode()
    listed = coded.dictionary.to_pylist()
    new = [w for w in listed if w not in known]
    known.update((w, older[w]) for w in new if w in older)
    new = [w for w in new if w not in older]
    tails = {w: stem for w in new if (stem := w.rstrip(PUNCTUATION)) != w and stem[-1:].isascii() and stem[-1:].isalpha()}
    parts = {w for w in new if w not in tails}.union(tails.values(), (w[len(stem):] for w, stem in tails.items()))
    known.update((w, older[w]) for w in parts if w in older)
    _encode_new(tokenizer, ends, [w for w in parts if w not in known], known)
    for w, stem in tails.items():
        known[w] = known[stem] + known[w[len(stem):]]
    ids = pa.array([known[w] for w in listed], pa.binary()).take(coded.indices)
    _, places, data = ids.buffers()
    places = np.frombuffer(places, np.int32)[ids.offset:ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
    return memoryview(data) if data else memoryview(b""), places[np.asarray(words.offsets)].astype(np.int64)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _gathered(batches, most: int):
    """(ids, texts) of about ``most`` bytes of text: the more at once, the fewer distinct words to look up."""
    ids, texts, size = [], [], 0
    for batch in batches:
        ids += batch.column(0).to_pylist()
        texts.append(pc.fill_null(batch.column(1), ""))
        size += texts[-1].nbytes
        if size >= most:
            yield ids, pa.concat_arrays(texts)
            ids, texts, size = [], [], 0
    if ids:
        yield ids, pa.concat_arrays(texts)


def _cut(path: str | None, length: int, end_id: int):
    def work(batches):
        end, count, task = np.array([end_id], "<u4").tobytes(), 0, TaskContext.get().partitionId() << 40
        for ids, texts in _gathered(batches, TEXT_BYTES):
            data, edges = encode(texts, path or default_tokenizer())
            rows: dict[str, list] = {k: [] for k in ("uid", "id", "piece", "start", "length", "ids")}
            for doc, begin, stop in zip(ids, edges[:-1].tolist(), edges[1:].tolist()):
                got = bytes(data[begin:stop]) + end
                for piece, a in enumerate(range(0, len(got), 4 * length)):
                    part = got[a:a + 4 * length]
                    for k, v in zip(rows, (task | count, doc, piece, a // 4, len(part) // 4, part)):
                        rows[k].append(v)
                    count += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], names=list(rows))
    return work


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None,
           length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(uid, id, piece, start, length, ids): the documents as token pieces of at most ``length``."""
    return ids_and_texts(docs, id_col, text_col).mapInArrow(tidy(_cut(path, length, end_id)), PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items of each bin; longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has room r
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            same = by_room[room]
            target = same.pop()
            if not same:
                rooms ^= 1 << room
            bins[target].append(item)
        else:
            room, target = capacity, len(bins)
            bins.append([item])
        room -= size
        if room:
            by_room.setdefault(room, []).append(target)
            rooms |= 1 << room
    return bins


def _pack(fill: np.ndarray, uids: list[np.ndarray], offsets: list[np.ndarray], node: int, first_bin: int,
          capacity: int, slack: int, last: bool) -> pa.RecordBatch:
    """Packs bins (or single pieces) as items; rows of ``BINS``."""
    groups = best_fit(fill, capacity)
    filled = np.array([int(fill[g].sum()) for g in groups], np.int64)
    order = np.argsort(filled, kind="stable")
    done = np.ones(len(groups), bool)
    if not last:
        loose = order[filled[order] < capacity - slack][:CARRY]
        done[loose] = False
    all_uids, all_offsets, edges = [], [], [0]
    for g in groups:
        at = 0
        for item in g:
            all_uids.append(uids[item])
            all_offsets.append(offsets[item] + at)
            at += int(fill[item])
        edges.append(edges[-1] + sum(len(uids[item]) for item in g))
    edges = pa.array(np.array(edges, np.int32))
    flat = lambda x, t: pa.ListArray.from_arrays(edges, pa.array(np.concatenate([*x, np.zeros(0, t)]).astype(t)))
    return pa.RecordBatch.from_arrays([
        pa.array(done), pa.array(np.full(len(groups), node // FAN_IN, np.int64)),
        pa.array(np.arange(first_bin, first_bin + len(groups), dtype=np.int64)), pa.array(filled.astype(np.int32)),
        flat(all_uids, np.int64), flat(all_offsets, np.int32)], names=["done", "node", "bin", "fill", "uids", "offsets"])


def _first(capacity: int, slack: int):
    """Packs a node's pieces."""
    def work(key, table):
        table = table.combine_chunks().sort_by("uid")
        node, ids, n = key[0].as_py(), np.asarray(table.column("uid")), np.asarray(table.column("length"))
        out = _pack(n, np.split(ids, len(ids))[:len(ids)], [np.zeros(1, np.int32)] * len(ids), node, node << 28, capacity, slack, False)
        release()
        return pa.Table.from_batches([out])
    return work


def _merge(capacity: int, slack: int, level: int, last: bool):
    def work(key, table):
        table = table.combine_chunks().sort_by("bin")
        node = key[0].as_py()
        rows = lambda name: (lambda c: np.split(np.asarray(c.values), np.asarray(c.offsets)[1:-1]))(
            c.combine_chunks() if isinstance(c := table.column(name), pa.ChunkedArray) else c)
        out = _pack(np.asarray(table.column("fill")).astype(np.int64), rows("uids"), rows("offsets"), node,
                    (level << 56) + (node << 28), capacity, slack, last)
        release()
        return pa.Table.from_batches([out])
    return work


def sequences(cut: DataFrame, *, capacity: int = LENGTH, slack: int = SLACK) -> DataFrame:
    """(uid, sequence_id, offset) for every row of ``cut`` (uid, length): a place in a sequence."""
    nodes = max(1, -(-cut.count() // DEAL))
    dealt = cut.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(nodes)).alias("node"))
    level, bins = 0, written(dealt.groupBy("node").applyInArrow(_first(capacity, slack), BINS), "bins")
    final = [bins.where("done")]
    while True:
        nodes, level = -(-nodes // FAN_IN), level + 1
        merged = bins.where("not done").groupBy("node").applyInArrow(_merge(capacity, slack, level, nodes <= 1), BINS)
        bins = written(merged, "bins")
        final.append(bins.where("done"))
        if nodes <= 1:
            break
    out = final[0]
    for more in final[1:]:
        out = out.union(more)
    return (out.select(F.col("bin").alias("sequence_id"), F.inline(F.arrays_zip("uids", "offsets")))
            .select(F.col("uids").alias("uid"), "sequence_id", F.col("offsets").cast("long").alias("offset")))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None,
           length: int = LENGTH, end_id: int = END_ID, slack: int = SLACK) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids (little-endian 32-bit), sequence_id, offset."""
    cut = written(pieces(docs, id_col, text_col, path=path, length=length, end_id=end_id), "pieces")
    # As many rows as pieces: never broadcast, however small its estimate.
    return (cut.join(sequences(cut, capacity=length, slack=slack).hint("merge"), "uid")
            .select(F.col("id").alias(id_col), "piece", "start", "length", "ids", "sequence_id", "offset"))
