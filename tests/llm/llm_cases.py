"""Small tables with the awkward rows that every operator has to take, and plain versions of the operators."""

import random

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# columns named like those that operators make or use inside
CLASHING = ["size", "shard", "slot", "k", "key", "n", "regs", "digest", "word", "rest", "row", "take", "kept", "host", "declared", "spans", "doc", "u"]
VOCABULARY = ["water", "stone", "Über", "river", "naïve", "light", "green", "Night", "paper", "x1", "the", "of", "and", "morning", "wind", "日本"]


def words(seed, n):
    rnd = random.Random(seed)
    return [rnd.choice(VOCABULARY) + (str(rnd.randrange(40)) if rnd.random() < 0.6 else "") for _ in range(n)]


def rows():
    base = words(1, 90)
    near = base[:60] + ["other"] + base[61:]
    far = base[:45] + words(2, 45)
    passage = " ".join(words(3, 60))
    out = [
        (1, " ".join(base), "en", "a", 1), (2, " ".join(base), "en", "a", 1), (3, " ".join(base).upper(), "en", "b", 1),
        (4, " ".join(near), "de", "b", 1), (5, " ".join(far), "de", None, 1),
        (6, " ".join(words(4, 40)) + "\n" + passage, "en", "a", 1), (7, passage + " " + " ".join(words(5, 40)), "fr", "c", 1),
        (8, None, "en", "a", None), (9, "", None, "a", 0), (10, " \n\t ", None, None, 4), (11, "one", "en", "c", 3), (12, "one", "en", "c", 3),
        (13, "a b c d", "en", "c", 7), (14, "A B C D", "en", "c", 7), (None, " ".join(words(6, 30)), "en", "b", 1), (None, " ".join(base), "en", "a", 1),
        (None, None, None, None, None), (15, " ".join(words(7, 20)), "en", "a", 1), (15, " ".join(words(7, 20)), "en", "a", 1),
        (16, "z" * 700, "en", "d", 700), (17, "é" * 150 + "z" * 260, "en", "d", 410), (18, "日本 " * 300, "ja", "d", 900),
        (19, " ".join(words(8, 6000)), "en", "a", 1), (20, "  \x85\x1c", "en", "a", 4), (21, "x" * 40000, "en", "a", 40000),
    ]
    return out + [(100 + i, " ".join(words(50 + i % 9, 25 + i % 9)), "en", "src%d" % (i % 4), 1) for i in range(30)]


def frame(spark, data=None):
    """The table with further columns of clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


def split(text):
    return (text or "").encode().split()


def shingle_set(text):
    w = [x.decode() for x in split((text or "").translate(LOWER))]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def smallest_reachable(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def covered(texts, length):
    """For each text, which of its bytes lie in a string of `length` bytes that starts elsewhere too."""
    from collections import Counter

    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        out.append((b, bytes(mark)))
    return out
