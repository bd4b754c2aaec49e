"""Small tables with the awkward cases, and plain versions of what the operators compute."""

import random

from pyspark.sql import types as T

WORDS = ["ash", "birch", "cedar", "elm", "fir", "hazel", "ivy", "larch", "maple", "oak", "pine", "rowan", "Über", "été",
         "spruce", "willow", "yew", "The", "the", "of", "and", "a.", "b,", "#tag", "x|y"] + [f"w{k}" for k in range(300)]
SPACE = b" \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().split()  # bytes split at exactly \x20 and \x09-\x0D


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def prose(rng, n, per_line=12):
    lines, left = [], n
    while left > 0:
        k = min(left, rng.randint(3, per_line))
        lines.append(" ".join(rng.choice(WORDS) for _ in range(k)))
        left -= k
    return "\n".join(lines)


def edited(rng, text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


def document_rows(seed=5):
    """(doc_id, text, lang, source): copies, near copies, shared passages, nulls, blanks, long and repeated rows."""
    rng = random.Random(seed)
    base = [prose(rng, n) for n in (200, 120, 60, 45, 30)]
    passage = prose(rng, 60)
    texts = [*base, base[0], base[0], base[1]]
    texts += [edited(rng, base[k % 3], share) for k in range(12) for share in (0.005, 0.02, 0.04)]
    texts += [prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(4)]
    texts += [None, "", "   \n\t ", "one", "two words", "one", prose(rng, 9000), "oak " * 300, "same line\n" * 30,
              "no newline", " lead and trail ", " nbsp em", "<|endoftext|> [INST] </s>"]
    texts += [prose(rng, rng.randint(1, 90)) for _ in range(25)]
    rows = [(k * 3 + 1, t, rng.choice(["en", "de", None]), f"src{k % 3}") for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                          T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


def documents(spark, rows=None, clash=()):
    """A frame over several partitions; ``clash`` adds columns of those names."""
    df = spark.createDataFrame(document_rows() if rows is None else rows, DOCUMENTS).repartition(3, "source")
    for name in clash:
        df = df.selectExpr("*", f"'x' as `{name}`")
    return df


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict(True) for r in df.collect()}
