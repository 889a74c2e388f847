"""Fixtures of the operator tests: rows that are awkward on purpose."""

import random

WORDS = "the of and to in is that for an or ed ing th er on re tion able un pre con dis".split()


def sentence(rng, n):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


def awkward(seed=1):
    """(doc_id, text): null, empty, blank, repeated rows, one id with two texts, a null
    id, ties, marks, accents, a long text, copies."""
    rng = random.Random(seed)
    base = sentence(rng, 120)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, base), (4, base), (5, base + " more"), (6, "a"), (7, "It's 'S we'll''s !! 12 3é  x\n\n y"),
            (7, "another text of the same id"), (8, "same row"), (8, "same row"), (None, "a text without an id"), (9, "z" * 5000),
            (10, sentence(rng, 20_000)), (11, "İstanbul ΑΣ straße ﬁn 日本語 テスト 😀 <|endoftext|> end"), (12, "  x​")]
    rows += [(100 + i, sentence(rng, rng.randint(1, 60))) for i in range(40)]
    return rows


def frame(spark, rows, clash=()):
    """The rows as documents; ``clash`` adds columns of those names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in clash:
        df = df.withColumn(c, F.lit("own"))
    return df


def multiset(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))
