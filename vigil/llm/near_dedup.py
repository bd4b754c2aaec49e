"""Near-duplicate groups of documents by SuperMinHash.

1. A document's set holds the hashes of its distinct word shingles.  One pass makes the set's size, a 128-bit key
   of the whole set and a SuperMinHash signature: every element ranks the slots by a random permutation, drawn one
   swap at a time, and stops as soon as no later rank can lower a slot.  Equal sets are one class from here on.
2. The signature is cut into bands.  Classes that agree in a band share a bucket.  Each bucket has a hub, the
   member that shares most buckets overall, and each member meets the hub on the full sets.
3. Members of one hub that fail against it may still link to each other.  They first meet a second hub among
   themselves, and what fails there a third, so that copies of another text need no links with one another.  Written
   as differences from the hub, two linked sets must share part of their rarest differences, so a prefix filter over
   those (rarest in the group first, positions bounding what can still agree) finds every such pair without listing the
   pairs of the group; pairs that linked to the same hub are left out.  These too are confirmed on the full sets.
4. Links that hold are grouped: union-find inside each partition, then star contraction between partitions.

Cases: null or blank text has the empty set, links to nothing and is its own group.  A null id takes no part: its
component is null and it is kept.  A row is its id and its text: rows that repeat an id with different texts are linked
each by their own text, and their component_id is the smallest doc_id of their own group.  Two linked classes are missed
only if they agree in no band: at the default bands below 4 in 10 million at a similarity of 0.85.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.shared import ids_and_texts, may_contain, tidy, written
from vigil.llm.words import Slice, lists, longs, mix, signed, slices

SIGNATURES = "id long, h long, n_shingles long, k1 long, k2 long, bands array<long>"
SECOND_HUBS = 2
U64 = np.uint64


def distinct_shingles(part: Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and where each document's begin."""
    hashes, doc, _ = part.windows(size, whole_if_short=True)
    edges = np.searchsorted(doc, np.arange(len(part.rows) + 1))
    for a, b in zip(edges[:-1], edges[1:]):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(len(part.rows) + 1))


def super_minhash(keys: np.ndarray, edges: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (documents x slots): rank in the permutation in the top 7 bits, a random fraction below."""
    n = len(edges) - 1
    best = np.full(n * slots, np.iinfo(U64).max, U64)
    row = np.repeat(np.arange(n), np.diff(edges))
    order = None
    for j in range(slots):
        pick = j + (((mix(keys, 2 * j + 1) >> U64(32)) * U64(slots - j)) >> U64(32)).astype(np.int64)
        if j == 0:
            slot, first = pick, pick
        else:
            if order is None:  # only elements of documents that need a second step have their permutation kept
                order = np.tile(np.arange(slots, dtype=np.uint8), (len(keys), 1))
                each = np.arange(len(keys))
                order[each, first] = 0
                order[:, 0] = first
            each = np.arange(len(keys))
            slot = order[each, pick].astype(np.int64)
            order[each, pick] = order[each, j]
        np.minimum.at(best, row * slots + slot, (U64(j) << U64(57)) | (mix(keys, 2 * j + 2) >> U64(7)))
        worst = (best.reshape(n, slots).max(axis=1) >> U64(57)).astype(np.int64) if n else np.zeros(0, np.int64)
        more = worst[row] > j
        if not more.all():
            keys, row, first = keys[more], row[more], first[more]
            order = None if order is None else order[more]
        if not len(keys):
            break
    return best.reshape(n, slots)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    rows = signatures.shape[1] // bands
    out = np.tile(np.arange(bands, dtype=U64), (len(signatures), 1))
    for k in range(rows):
        out = mix(out ^ signatures[:, k::rows][:, :bands], 11 + k)
    return out


def _set_keys(keys: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each document's whole set."""
    sums = [np.concatenate([[U64(0)], np.cumsum(mix(keys, seed), dtype=U64)]) for seed in (101, 102)]
    k1, k2 = (mix(s[edges[1:]] - s[edges[:-1]], 3) for s in sums)
    return k1, k2


def _signatures(size: int, bands: int, rows: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, there = longs(batch.column(0))
            for part in slices(batch.column(1), lower):
                keys, edges = distinct_shingles(part, size)
                n = np.diff(edges)
                own = slice(part.rows.start, part.rows.stop)
                k1, k2 = _set_keys(keys, edges)
                alone = n == 0
                k1[alone] = mix(ids[own][alone].astype(U64), 103)
                keyed = band_keys(super_minhash(keys, edges, bands * rows), bands)
                live = (n > 0) & there[own]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[own], mask=~there[own]), batch.column(2)[own], pa.array(n.astype(np.int64)),
                    pa.array(signed(k1), mask=~there[own]), pa.array(signed(k2), mask=~there[own]),
                    lists(signed(keyed[live].ravel()), np.concatenate([[0], np.cumsum(live * bands)]), pa.int64()),
                ], names=["id", "h", "n_shingles", "k1", "k2", "bands"])
    return run


def _sets(size: int, lower: bool):
    def run(batches):
        for batch in batches:
            for part in slices(batch.column(0), lower):
                keys, edges = distinct_shingles(part, size)
                k1, k2 = _set_keys(keys, edges)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(k1)), pa.array(signed(k2)), lists(signed(keys), edges, pa.int64())], names=["k1", "k2", "members"])
    return run


def _row_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    edges = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.values).view(U64), edges


def _against_hub(num: int, den: int):
    """Rows (hub, id, set, hub's set) -> the link."""
    def run(batches):
        for batch in batches:
            own, a = _row_values(batch.column(2))
            hubs, b = _row_values(batch.column(3))
            linked = []
            for k in range(batch.num_rows):
                x, h = own[a[k]:a[k + 1]], hubs[b[k]:b[k + 1]]
                same = len(np.intersect1d(x, h, True))
                linked.append(den * same >= num * (len(x) + len(h) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["hub", "id", "linked"])
    return run


def _differences(num: int, den: int):
    """Rows (hub, id, linked, set, hub's set) -> sizes, how many differences suffice for the prefix, all differences."""
    far, near = den - num, den + num  # linked: near * differences <= far * (sizes of both)

    def run(batches):
        for batch in batches:
            own, a = _row_values(batch.column(3))
            hubs, b = _row_values(batch.column(4))
            out = {"size": [], "diff": [], "short": [], "reach": [], "keys": []}
            for k, linked in enumerate(batch.column(2).to_pylist()):
                x, h = own[a[k]:a[k + 1]], hubs[b[k]:b[k + 1]]
                keys = np.setxor1d(x, h, True)
                d, nx, nh = len(keys), len(x), len(h)
                short = max(0, d - (near * d + far * (nh - nx)) // (2 * near))  # against a set that isn't linked to the hub
                long = min(d, far * nx // num + 1)  # against any
                short = short if linked else min(short, long)
                for name, v in (("size", nx), ("diff", d), ("short", short), ("reach", short if linked else long), ("keys", keys.view(np.int64))):
                    out[name].append(v)
            edges = np.concatenate([[0], np.cumsum([len(x) for x in out["keys"]])]).astype(np.int32)
            keys = np.concatenate([*out["keys"], np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(2), *(pa.array(out[c], pa.int64()) for c in ("size", "diff", "short", "reach")),
                lists(keys, edges, pa.int64())], names=["hub", "id", "linked", "size", "diff", "short", "reach", "keys"])
    return run


def _confirm(num: int, den: int):
    def run(batches):
        for batch in batches:
            xs, a = _row_values(batch.column(2))
            ys, b = _row_values(batch.column(3))
            good = []
            for k in range(batch.num_rows):
                x, y = xs[a[k]:a[k + 1]], ys[b[k]:b[k + 1]]
                same = len(np.intersect1d(x, y, True))
                good.append(den * same >= num * (len(x) + len(y) - same))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
    return run


def _forest(batches):
    """Union-find over a partition's links: each node with the smallest of its tree, roots left out."""
    up: dict[int, int] = {}

    def root(x):
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p] if p in up else p
            x = p
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    rows = [(x, r) for x in up if (r := root(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())],
                                     names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (id, component): every linked node with the smallest node it reaches.

    Rounds of star contraction (every node points its larger neighbours, then its smaller ones, at its smallest
    neighbour) until nothing changes; the number of rounds is logarithmic in the longest path.
    """
    edges = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).mapInArrow(tidy(_forest), "u long, v long")
                    .distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(low.toDF("u", "v")).distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.toDF("id", "component")
        seen = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5,
                    similarity: tuple[int, int] = (80, 100), bands: int = 20, rows: int = 4,
                    lower: bool = True) -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, component_id (smallest id of the group), kept, text_hash, group.

    Two documents link if ``similarity[1] * |A and B| >= similarity[0] * |A or B|`` over their word shingles.  ``group``
    is the same number for all rows of a group, null for rows that can't link.
    """
    if bands * rows > 128:
        raise ValueError("bands * rows is at most 128, as ranks have 7 bits")
    num, den = similarity
    base = ids_and_texts(docs, id_col, text_col)
    sig = written(base.select("id", "text", F.xxhash64("text").alias("h"))
                  .mapInArrow(tidy(_signatures(shingle, bands, rows, lower)), SIGNATURES), "signatures")
    key = F.xxhash64("k1", "k2").alias("c")  # a class: all rows with the same set
    classes = (sig.where("id is not null and n_shingles > 0").groupBy("k1", "k2")
               .agg(F.min("id").alias("rep"), F.first("bands").alias("bands")).select("k1", "k2", key, "rep", "bands"))
    keys = classes.select("c", "rep", F.explode("bands").alias("b"))
    many = keys.groupBy("b").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(keys.join(many, "b"), "buckets")
    score = shared.groupBy("c").agg(F.sum("n").alias("s"))
    scored = shared.join(score, "c").select("b", "c", "s")
    hubs = scored.groupBy("b").agg(F.max(F.struct("s", "c")).alias("h")).select("b", F.col("h.c").alias("hub"))
    members = written(shared.join(hubs, "b").where("c <> hub").select("hub", F.col("c").alias("id")).distinct(), "members")

    wanted = written(shared.select(F.col("rep").alias("id")).distinct(), "wanted")
    texts = (base.where(may_contain(wanted, "id", "id")).groupBy("id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
             .join(wanted, "id", "left_semi"))
    sets = written(texts.select("text").mapInArrow(tidy(_sets(shingle, lower)), "k1 long, k2 long, members array<long>")
                   .select(key.alias("id"), "members"), "sets")

    def meet(pairs: DataFrame, left: str, right: str) -> DataFrame:
        return (pairs.join(sets.toDF(left, "x"), left).join(sets.toDF(right, "y"), right).select(left, right, "x", "y")
                .mapInArrow(tidy(_confirm(num, den)), f"{left} long, {right} long"))

    met = written(members.join(sets, "id").join(sets.toDF("hub", "hub_members"), "hub").select("hub", "id", "members", "hub_members")
                  .mapInArrow(tidy(_against_hub(num, den)), "hub long, id long, linked boolean"), "met")
    links = met.where("linked").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    loose = met.where("not linked").select("hub", "id").distinct()
    known = met.where("linked").select("hub", "id", F.col("hub").alias("of"))
    loose_hubs = loose.select("hub").distinct()
    for _ in range(SECOND_HUBS):
        second = (loose.join(score.withColumnRenamed("c", "id"), "id").groupBy("hub").agg(F.max(F.struct("s", "id")).alias("h"))
                  .select("hub", F.col("h.id").alias("second")))
        tried = written(loose.join(second, "hub"), "second-hubs")
        found = written(meet(tried.where("id <> second").select("id", "second").distinct(), "id", "second").distinct(), "second-links")
        links = links.union(found)
        held = tried.join(found, ["id", "second"], "left_semi").union(tried.where("id = second").select("id", "second", "hub"))
        held = written(held.select("hub", "id", F.col("second").alias("of")), "held")
        known, loose = known.union(held), written(loose.join(held, ["hub", "id"], "left_anti"), "loose")
    known = known.groupBy("hub", "id").agg(F.min("of").alias("of"))

    apart = written(
        met.join(written(loose_hubs, "loose-hubs"), "hub", "left_semi").join(sets, "id").join(sets.toDF("hub", "h"), "hub")
        .select("hub", "id", "linked", "members", "h")
        .mapInArrow(tidy(_differences(num, den)), "hub long, id long, linked boolean, size long, diff long, short long, reach long, keys array<long>"),
        "differences")
    each = apart.select("hub", "id", F.explode("keys").alias("key"))
    often = written(each.groupBy("hub", "key").agg(F.count("*").alias("f")).where("f > 1"), "often")
    # In the order (how often in the group, key) those found once come first; only their number matters.
    shared_keys = each.join(often, ["hub", "key"])
    place = F.row_number().over(Window.partitionBy("hub", "id").orderBy("f", "key"))
    ranked = shared_keys.select("hub", "id", "key", (place - 1).alias("j"), F.count("*").over(Window.partitionBy("hub", "id")).alias("n"))
    at = written(ranked.join(apart.drop("keys"), ["hub", "id"]).join(known, ["hub", "id"], "left")
                 .select("hub", "id", "key", "size", "diff", "linked", "short", "reach", F.coalesce("of", "id").alias("of"),
                         (F.col("diff") - F.col("n") + F.col("j")).alias("i")).where("i < reach"), "prefixes")
    left = at.where("not linked").select("hub", "key", *(F.col(c).alias(f"u_{c}") for c in ("id", "size", "diff", "i", "of")))
    right = at.where("i < short").select("hub", "key", "id", "size", "diff", "i", "of")
    differ, total = "diff + u_diff - 2 * least(diff - i, u_diff - u_i)", "size + u_size"
    pairs = (left.join(right, "hub key".split())
             .where(f"id <> u_id and of <> u_of and {den + num} * ({differ}) <= {den - num} * ({total})")
             .select(F.least("id", "u_id").alias("a"), F.greatest("id", "u_id").alias("b")).distinct())
    group = components(links.union(meet(pairs, "a", "b"))).toDF("c", "group")
    grouped = written(classes.join(group, "c", "left").select("k1", "k2", "rep", F.coalesce("group", "c").alias("group")), "grouped")
    label = (grouped.join(grouped.groupBy("group").agg(F.min("rep").alias("component")), "group")
             .select("k1", "k2", "component", "group"))
    own = sig.join(label, ["k1", "k2"], "left")
    component = F.coalesce("component", "id")
    return own.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), F.col("h").alias("text_hash"),
                      F.when(F.col("id").isNotNull(), F.col("group")).alias("group"))
