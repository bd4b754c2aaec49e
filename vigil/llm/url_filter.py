"""URL verdicts from Bloom filter cascades; DataFrame functions only.

Rules (host, path, verdict) and a list of blocked domains are sets of keys.  A key is a host, or a host and the start
of a path (``example.com/en/``): a path is empty or begins with ``/``, so a key reads in one way.  A url has a candidate
key for each shape (number of host labels, length of path) that some entry has: its last labels and its path's start.
The entries that fit a url are its candidates that are entries.

Membership is exact and needs no join.  The universe of a cascade is every distinct candidate key of the corpus.  Level
1 is a Bloom filter of the entries; the keys of the rest that it takes for entries go into level 2, the entries that
level 2 takes for those into level 3, and so on until a level errs on no key of the universe.  A key's first level that
refuses it tells the side it is on.  One cascade holds the rules, one the blocking rules among the rules, one the list.

A cascade is a literal of the plan, one byte or so an entry, of at most ``MAX_BYTES`` by its estimate; entries beyond
that are dealt by hash to segments with a cascade each, and the rows pass one segment after the other, written between.

Cases: a null url, or one without ``://``, has an empty host and path.  Entries with a null host or verdict don't count;
a null path is empty; of equal rules a blocking one wins.  Of fitting rules the longest (code points) decides, at equal
length the one with more host labels.  Empty tables give no rows.  A column of the result's name is replaced.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.shared import written

MAX_BYTES = 1 << 20
BITMAP_BITS = 8 * 4096  # of one bitmap_construct_agg
LATER_HASHES, MOST_HASHES = 4, 8
MAX_HOST = 253  # longest name of a host; longer ones are not put on the list

# Words that put a domain on the list when its own label, cut at hyphens, holds one.
LISTED_WORDS = ["ads", "adult", "bets", "casino", "pills", "spam"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host up to ``/``, ``?``, ``#`` (A-Z lower-cased), then the path up to ``?``, ``#``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def n_labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The url's keys of these (labels, path length) shapes, in their order."""
    if not shapes:
        return F.array().cast("array<string>")
    fits = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).alias("m")) for n, m in shapes]),
                    lambda s: (s["n"] <= n_labels(host)) & (s["m"] <= F.length(path)))
    return F.transform(fits, lambda s: F.concat(F.call_function("substring_index", host, F.lit("."), -s["n"]),
                                                F.substring(path, F.lit(1), s["m"])))


@dataclass
class Level:
    number: int
    bits: int
    hashes: int
    content: Column  # a binary literal

    @classmethod
    def of(cls, keys: DataFrame, number: int, n: int, others: int) -> Level:
        """A filter of the ``n`` keys; the first one is sized by how many others it meets."""
        hashes = LATER_HASHES if number > 1 else min(MOST_HASHES, max(1, round(math.log2(max(others / n, 2)))))
        bits = -(-math.ceil(n * hashes / math.log(2)) // BITMAP_BITS) * BITMAP_BITS
        at = F.explode(F.array(*[p + 1 for p in _places(F.col("key"), number, bits, hashes)]))
        found = (keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b"))
                 .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap")).collect())  # bits/8 bytes at most
        content = bytearray(bits // 8)
        for b, bitmap in found:
            content[(b - 1) * 4096:b * 4096] = bitmap
        return cls(number, bits, hashes, F.lit(bytes(content)))

    def holds(self, key: Column) -> Column:
        def bit(at: Column) -> Column:
            byte = F.ascii(F.decode(F.substring(self.content, F.shiftright(at, 3).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
            return F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1
        return F.forall(F.array(*_places(key, self.number, self.bits, self.hashes)), bit)


def _places(key: Column, number: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(number), F.lit(k)), F.lit(bits).cast("long")) for k in range(hashes)]


def _levels(entries: DataFrame, rest: DataFrame) -> list[Level]:
    levels: list[Level] = []
    inside, outside, n, others = entries, rest, entries.count(), rest.count()
    while n:
        level = Level.of(inside, len(levels) + 1, n, others)
        levels.append(level)
        wrong = written(outside.where(level.holds(F.col("key"))), "false-positives")
        inside, outside, n, others = wrong, inside, wrong.count(), n
    return levels


@dataclass
class Cascade:
    """Exact membership over a universe: the levels of each segment of the keys."""

    segments: list[list[Level]]

    @classmethod
    def of(cls, universe: DataFrame, entry: Column, max_bytes: int = MAX_BYTES) -> Cascade:
        """``universe`` (key, ...) of distinct keys; ``entry`` tells which of them are entries."""
        n, total = universe.where(entry).count(), universe.count()
        bits = n * min(MOST_HASHES, max(1, math.log2(max(total / max(n, 1), 2)))) / math.log(2) * 1.5
        count = max(1, math.ceil(bits / 8 / max_bytes))
        own = [universe.where(_segment(F.col("key"), count) == g) for g in range(count)] if count > 1 else [universe]
        return cls([_levels(u.where(entry).select("key"), u.where(~entry).select("key")) for u in own])

    def within(self, g: int, key: Column) -> Column:
        levels = self.segments[g]
        out = F.lit(len(levels) % 2 == 1)
        for level in reversed(levels):
            out = F.when(~level.holds(key), F.lit(level.number % 2 == 0)).otherwise(out)
        return out if len(self.segments) == 1 else (_segment(key, len(self.segments)) == g) & out

    def add(self, df: DataFrame, keys: Column, name: str) -> DataFrame:
        """``df`` with the entries among the array ``keys``; segment after segment, so one is in memory at a time."""
        df = df.withColumn(name, F.filter(keys, lambda k: self.within(0, k)))
        for g in range(1, len(self.segments)):
            df = written(df, "url-segment")
            df = df.withColumn(name, F.concat(name, F.filter(keys, lambda k: self.within(g, k))))
        return df


def _segment(key: Column, count: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("segment")), F.lit(count))


def listed_domains(hosts: DataFrame, words: list[str] = LISTED_WORDS) -> DataFrame:
    """(key): the corpus's domains whose first label, cut at hyphens, holds one of the words."""
    parts = F.col("host"), F.sequence(F.lit(1), n_labels(F.col("host")))
    keys = hosts.where(F.length("host").between(1, MAX_HOST)).select(F.explode(F.transform(
        parts[1], lambda n: F.call_function("substring_index", parts[0], F.lit("."), -n))).alias("key"))
    held = F.arrays_overlap(F.split(F.substring_index("key", ".", 1), "-"), F.array(*map(F.lit, words)))
    return keys.where(held).distinct()


def judged(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", words: list[str] = LISTED_WORDS,
           name: str = "url_filter", max_bytes: int = MAX_BYTES) -> DataFrame:
    """``pages`` with a struct column ``name`` (host, path, rule, verdict).

    ``rules`` has columns host, path, verdict (``allow`` or ``block``).  Without a fitting rule the verdict is ``block``
    for hosts at or below a listed domain (``listed_domains``), else ``allow``.
    """
    host, path = host_and_path(F.col(url_col))
    rules = rules.where("host is not null and verdict is not null").select(
        F.translate("host", string.ascii_uppercase, string.ascii_lowercase).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"), (F.col("verdict") == "block").alias("block"))
    urls = pages.select(host.alias("host"), path.alias("path"))
    listed = written(listed_domains(urls.select("host").distinct(), words), "listed")
    shape = rules.select(n_labels(F.col("host")).alias("n"), F.length("path").alias("m")).distinct()
    of_rules = sorted({(r["n"], r["m"]) for r in shape.collect()}, reverse=True)
    # At most 127 numbers of labels, as listed names are no longer than MAX_HOST.
    of_list = sorted({(r["n"], 0) for r in listed.select(n_labels(F.col("key")).alias("n")).distinct().collect()}, reverse=True)

    no, yes = F.lit(False), F.lit(True)
    seen = urls.select(F.explode(candidates(F.col("host"), F.col("path"), sorted({*of_rules, *of_list}))).alias("key")).distinct()
    universe = written(
        seen.select("key", yes.alias("seen"), no.alias("rule"), no.alias("block"), no.alias("listed"))
        .union(rules.select(F.concat("host", "path"), no, yes, "block", no))
        .union(listed.select("key", no, no, no, yes))
        .groupBy("key").agg(*[F.max(c).alias(c) for c in ("seen", "rule", "block", "listed")]).where("seen"), "universe")
    by_rule = Cascade.of(universe, F.col("rule"), max_bytes)
    blocking = Cascade.of(universe.where("rule"), F.col("block"), max_bytes)
    on_list = Cascade.of(universe, F.col("listed"), max_bytes)

    def longest(keys: Column) -> Column:
        return F.reduce(keys, F.lit(None).cast("string"), lambda a, k: F.when(a.isNull() | (F.length(k) > F.length(a)), k).otherwise(a))

    out = by_rule.add(pages.withColumns({"__host": host, "__path": path}), candidates(F.col("__host"), F.col("__path"), of_rules), "__rules")
    out = out.withColumn("__rule", longest(_ordered(F.col("__rules"), by_rule)))
    out = blocking.add(out, F.array_compact(F.array("__rule")), "__blocks")
    out = on_list.add(out, candidates(F.col("__host"), F.lit(""), of_list), "__listed")
    stop = F.when(F.col("__rule").isNotNull(), F.size("__blocks") > 0).otherwise(F.size("__listed") > 0)
    verdict = F.struct(F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"),
                       F.when(stop, "block").otherwise("allow").alias("verdict"))
    return out.withColumn(name, verdict).select(*pages.columns if name in pages.columns else [*pages.columns, name])


def _ordered(keys: Column, cascade: Cascade) -> Column:
    """Keys found segment by segment, those of more labels first again."""
    if len(cascade.segments) == 1:
        return keys
    host = lambda k: F.regexp_extract(k, r"^[^/]*", 0)
    return F.array_sort(keys, lambda a, b: n_labels(host(b)) - n_labels(host(a)))
