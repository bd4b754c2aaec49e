"""Packed counters against a walk of every document through every order."""

import collections
import itertools
import re

from pyspark.sql import functions as F

from tests.llm.fixtures import document_rows, documents
from vigil.llm import filter_audit
from vigil.llm.filter_audit import audit, orders, packed_masks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, labels):
    low = {}
    for i, t, *_ in rows:
        if i is not None:
            low[t or ""] = min(low.get(t or "", i), i)
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    out = collections.defaultdict(lambda: [0] * 6)
    for i, t, part, *_ in rows:
        t, part = t or "", part or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
                 "D": bool(set(t) & set("#$%&*|")), "E": i is not None and i > low[t]}
        for order in itertools.permutations("ABCDE"):
            here = True
            for step, x in enumerate(order, 1):
                row = out[part, "".join(order), step]
                removed = here and fails[x]
                row[2] += fails[x] and not here
                here = here and not fails[x]
                row[0] += here
                row[1] += removed
                row[3] += [k for k in fails if fails[k]] == [x]
                row[4] += removed and i in good
                row[5] += removed and i in toxic
    shapley = collections.Counter()
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] += row[1]
    return {(part, order, step): (*row, shapley[part, order[step - 1]]) for (part, order, step), row in out.items()}


def answers(df):
    return {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}


def test_every_order_against_a_walk(spark, monkeypatch):
    rows = document_rows()
    rows += [(None, "", None, "s"), (None, "one", "fr", "s"), (2000, "one", "", "s"), (2000, "one", "", "s"), (2000, "other", "en", "s"),
             (-5, "SHOUT $", "de", "s"), (2001, "HALF the Text", "de", "s"), (2002, "oak " * 300, "en", "s"), (2003, "x" * 300000, "it", "s")]
    rows += [(3000 + k, f"copy {k % 2}", ["en", "de"][k % 3 % 2], "s") for k in range(60)]
    labels = [(i, k % 2, (k // 2) % 2) for k, i in enumerate(r[0] for r in rows if r[0] is not None)]
    labels += [(labels[0][0], None, 1), (labels[1][0], 0, None), (99999, 1, 1), (None, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 as good", "'x' as id")
    df = documents(spark, rows, clash=["part", "mask", "key", "n", "low", "good", "at"])
    want = plain(rows, labels)
    got = answers(audit(df, known))
    assert got == want and len(got) == 600 * len({r[2] or "" for r in rows})
    # A tree of several levels, and tasks that pass their sums on early, add up to the same.
    for name, value in (("FAN_IN", 2), ("PARTS_HELD", 1)):
        monkeypatch.setattr(filter_audit, name, value)
    assert answers(audit(df, known)) == want
    assert audit(documents(spark, []), known).collect() == []
    assert answers(audit(df, known.limit(0))).keys() == want.keys()


def test_other_filters_and_no_carry(spark):
    masks = packed_masks("XE")
    n = (1 << 63) - 1
    assert len(orders("ABCDE")) * 5 == 600
    fields = (n * masks[3]).to_bytes(9 * 8, "little")
    assert [int.from_bytes(fields[k:k + 8], "little") for k in range(0, 72, 8)] == [n, 0, n, 0, n, n, 0, 0, n]
    df = documents(spark, [(1, "a", "en", "s"), (2, "a", "en", "s"), (3, "bb", "en", "s")])
    got = answers(audit(df, spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int"), {"X": F.length("text") > 1}))
    assert got == {("en", "XE", 1): (2, 1, 0, 1, 0, 0, 2), ("en", "XE", 2): (1, 1, 0, 1, 1, 0, 2),
                   ("en", "EX", 1): (2, 1, 0, 1, 1, 0, 2), ("en", "EX", 2): (1, 1, 0, 1, 0, 0, 2)}
