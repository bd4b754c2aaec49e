"""Phrases of two and three words by set-oriented mining of occurrence relations (SETM).

1. Texts are cut into pieces and words.  A chunk holds whole documents of one language, some ``CHUNK_BYTES`` of them (or
   one longer document), and its occurrence relation: a word for each place, in order, with an empty place between
   pieces, so two words are neighbours in a piece if and only if their places follow each other.  The relations are
   written once as sorted blocks, with each chunk's words and their counts.
2. Word counts add up to the frequent words, which get numbers.  They go back to the chunks that hold them (a semi-join
   of each relation with the frequent words), where the relation is merge-joined with itself at adjacent places.
3. The chunk's pair counts meet those of other chunks; pairs frequent in all go back to the chunks that hold them, the
   relation of pairs is semi-joined with them and merge-joined at adjacent places once more, which gives triples.

What travels is a row for each phrase and chunk, never for each occurrence, so a phrase of a third of all places is a
row a chunk.  Words and phrases are compared as themselves, not by hashes; counts and scores are exact.

Cases: null text is empty; null language is ``und``, as is the language of that name; rows that repeat are counted each
time.  A piece without words has none of anything.  Empty tables, or no frequent phrase, give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.shared import release, tidy, written
from vigil.llm.words import LOWER
from vigil.operators.summary import global_index

CHUNK_BYTES = 1 << 23
BLOCK = 1 << 16  # places, or words, of a row
WORD, SPACE, BREAK = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = SPACE
KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = BREAK
RELATION = "chunk long, lang string, at int, n int, places binary, first int, words array<string>, counts array<long>"


def occurrences(text: bytes) -> tuple[np.ndarray, pa.Array]:
    """The word number (from 1; 0: none) at each place, and the words in order of their numbers."""
    data = np.take(LOWER, np.frombuffer(text, np.uint8))
    kind = np.take(KIND, data)
    word = kind == WORD
    change = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = change[::2], change[1::2]
    edges = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data[word])])
    found = words.dictionary_encode()
    piece = np.searchsorted(np.flatnonzero(kind == BREAK), starts)
    new = np.concatenate([[0], np.diff(piece) > 0]) if len(starts) else np.zeros(0)
    place = np.arange(len(starts)) + np.cumsum(new).astype(np.int64)
    out = np.zeros(place[-1] + 1 if len(place) else 0, np.int32)
    out[place] = np.asarray(found.indices) + 1
    return out, found.dictionary.cast(pa.string())


def _packed(places: np.ndarray) -> bytes:
    """Byte planes, compressed: most numbers are small."""
    return pa.compress(np.ascontiguousarray(places.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(block: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(block, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<i4").ravel()


def _chunk_rows(chunk: int, lang: str, texts: list[bytes]):
    places, words = occurrences(b"\n".join(texts))
    counts = np.bincount(places, minlength=len(words) + 1)[1:]
    for k in range(0, max(len(places), len(words)), BLOCK):
        some, own = places[k:k + BLOCK], words[k:k + BLOCK]
        yield pa.RecordBatch.from_arrays([
            pa.array([chunk], pa.int64()), pa.array([lang], pa.string()), pa.array([k], pa.int32()), pa.array([len(some)], pa.int32()),
            pa.array([_packed(some)], pa.binary()), pa.array([k], pa.int32()),
            pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.concat_arrays([own])),
            pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(counts[k:k + BLOCK], pa.int64()))],
            names=["chunk", "lang", "at", "n", "places", "first", "words", "counts"])


def _relations(chunk_bytes: int):
    """(lang, text) -> the blocks of each chunk; at most twice ``chunk_bytes`` (or one text more) are held at once."""
    def run(batches):
        chunk, held, size = TaskContext.get().partitionId() << 32, {}, {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text) + 1
                if size[lang] >= chunk_bytes or sum(size.values()) >= 2 * chunk_bytes:
                    full = max(size, key=size.get)
                    del size[full]
                    yield from _chunk_rows(chunk, full, held.pop(full))
                    chunk += 1
        for lang in list(held):
            yield from _chunk_rows(chunk, lang, held.pop(lang))
            chunk += 1
    return run


def adjacent(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge join of two sorted lists of places: rows of ``left`` and ``right`` where the right place is the next one."""
    at = np.searchsorted(right, left + 1)
    there = at < len(right)
    there[there] = right[at[there]] == left[there] + 1
    return np.flatnonzero(there), at[there]


def _members(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name).combine_chunks())


def _frequent_words(blocks: pa.Table, numbers: np.ndarray, locals_: np.ndarray):
    """The relation semi-joined with the frequent words: places, words as the chunk numbers them, and their numbers in all."""
    order = np.argsort(_members(blocks, "at"))
    parts = [_unpacked(blocks.column("places")[int(k)].as_py(), blocks.column("n")[int(k)].as_py()) for k in order]
    places = np.concatenate([*parts, np.zeros(0, np.int32)])
    number = np.zeros(max(places.max(initial=0), locals_.max(initial=0)) + 1, np.int64)
    number[locals_] = numbers
    where = np.flatnonzero(number[places] > 0)
    return where, places[where].astype(np.int64), number


def _cut(arrays: list, names: list[str]) -> pa.Table:
    release()
    whole = pa.RecordBatch.from_arrays(arrays, names=names)
    return pa.Table.from_batches([whole.slice(k, BLOCK) for k in range(0, whole.num_rows, BLOCK)], whole.schema)


def _pairs(blocks: pa.Table, words: pa.Table) -> pa.Table:
    """A chunk's pairs of frequent words, in the numbers of all, with counts."""
    place, word, number = _frequent_words(blocks, _members(words, "a"), _members(words, "local"))
    i, j = adjacent(place, place)
    pairs, counts = np.unique(word[i] << 32 | word[j], return_counts=True)
    chunk = blocks.column("chunk")[0].as_py() if blocks.num_rows else 0
    return _cut([pa.array(np.full(len(pairs), chunk)), pa.array(number[pairs >> 32]), pa.array(number[pairs & 0xFFFFFFFF]),
                 pa.array(counts.astype(np.int64))], ["chunk", "a", "b", "c"])


def _triples(blocks: pa.Table, known: pa.Table) -> pa.Table:
    """A chunk's triples both of whose pairs are frequent, with counts."""
    local, a, b = (_members(known, x) for x in ("local", "a", "b"))
    single = local > 0
    place, word, number = _frequent_words(blocks, a[single], local[single])
    order = np.argsort(number)  # numbers of all back to those of the chunk
    back = lambda x: order[np.searchsorted(number[order], x)]
    frequent = np.sort(back(a[~single]) << 32 | back(b[~single]))
    i, j = adjacent(place, place)
    pair = word[i] << 32 | word[j]
    at = np.searchsorted(frequent, pair)
    held = at < len(frequent)
    held[held] = frequent[at[held]] == pair[held]
    place, at = place[i][held], at[held]
    i, j = adjacent(place, place)
    triples, counts = np.unique(at[i] << 32 | frequent[at[j]] & 0xFFFFFFFF, return_counts=True)
    pair = frequent[triples >> 32] if len(triples) else triples
    return _cut([pa.array(number[pair >> 32]), pa.array(number[pair & 0xFFFFFFFF]), pa.array(number[triples & 0xFFFFFFFF]),
                 pa.array(counts.astype(np.int64))], ["a", "b", "w", "c"])


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts below 10**16."""
    wide = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def mined(docs: DataFrame, least: int, *, text_col: str = "text", lang_col: str = "lang",
          chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tables of the words (a, lang, word, f), pairs (a, b, f) and triples (a, b, w, f) that occur ``least`` times or more,
    and (lang, n) with all words of each language."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    relations = written(texts.mapInArrow(tidy(_relations(chunk_bytes)), RELATION), "occurrences")
    totals = relations.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n"))
    own = (relations.select("chunk", "lang", "first", F.posexplode(F.arrays_zip("words", "counts")).alias("k", "x"))
           .select("chunk", "lang", (F.col("first") + F.col("k") + 1).alias("local"), F.col("x.words").alias("word"), F.col("x.counts").alias("c")))
    counted = own.groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    words = written(global_index(counted, ["lang", "word"], "a").select((F.col("a") + 1).alias("a"), "lang", "word", "f"), "words")

    held = written(own.join(words, ["lang", "word"]).select("chunk", "local", "a"), "held-words")
    blocks = relations.where("n > 0").select("chunk", "at", "n", "places")
    found = (blocks.groupBy("chunk").cogroup(held.groupBy("chunk")).applyInArrow(_pairs, "chunk long, a long, b long, c long"))
    total = F.sum("c").over(Window.partitionBy("a", "b"))
    held_pairs = written(found.select("chunk", "a", "b", total.alias("f")).where(F.col("f") >= least), "held-pairs")
    pairs = held_pairs.groupBy("a", "b").agg(F.first("f").alias("f"))

    known = (held.withColumn("b", F.lit(0).cast("long"))
             .unionByName(held_pairs.select("chunk", F.lit(0).alias("local"), "a", "b")))
    triples = (blocks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_triples, "a long, b long, w long, c long")
               .groupBy("a", "b", "w").agg(F.sum("c").alias("f")).where(F.col("f") >= least))
    return words, written(pairs, "pairs"), written(triples, "triples"), totals


def collocations(docs: DataFrame, *, least: int = 10, cover: tuple[int, int] = (50, 100), top: int = 2000,
                 text_col: str = "text", lang_col: str = "lang", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``top`` phrases of two and three words.

    A phrase that occurs a times scores floor(1000000 * a * a / (l * r)) at the cut, into parts that occur l and r times,
    where that is lowest (the first such cut).  A pair inside a triple of at least ``cover`` of its count is left out.
    """
    words, pairs, triples, totals = mined(docs, least, text_col=text_col, lang_col=lang_col, chunk_bytes=chunk_bytes)

    def word(column: str, *, lang: bool = False) -> DataFrame:
        return words.select(F.col("a").alias(column), *(["lang"] if lang else []), F.col("word").alias(f"w_{column}"), F.col("f").alias(f"f_{column}"))

    covered = (triples.select("a", "b", "f").union(triples.select("b", "w", "f").toDF("a", "b", "f"))
               .groupBy("a", "b").agg(F.max("f").alias("longer")))
    two = (pairs.join(covered, ["a", "b"], "left").where(F.col("longer").isNull() | (cover[1] * F.col("longer") < cover[0] * F.col("f")))
           .select("a", "b", "f").join(word("a", lang=True), "a").join(word("b"), "b")
           .select("lang", F.concat_ws(" ", "w_a", "w_b").alias("phrase"), "f", F.col("f_a").alias("l"), F.col("f_b").alias("r"),
                   _score(F.col("f"), F.col("f_a"), F.col("f_b")).alias("score")))
    three = (triples.join(pairs.withColumnRenamed("f", "f_ab"), ["a", "b"])
             .join(pairs.toDF("b", "w", "f_bw"), ["b", "w"])
             .join(word("a", lang=True), "a").join(word("b"), "b").join(word("w"), "w"))
    first, second = _score(F.col("f"), F.col("f_a"), F.col("f_bw")), _score(F.col("f"), F.col("f_ab"), F.col("f_w"))
    three = three.select(
        "lang", F.concat_ws(" ", "w_a", "w_b", "w_w").alias("phrase"), "f", F.when(first <= second, F.col("f_a")).otherwise(F.col("f_ab")).alias("l"),
        F.when(first <= second, F.col("f_bw")).otherwise(F.col("f_w")).alias("r"), F.least(first, second).alias("score"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase"))
    best = two.unionByName(three).withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
