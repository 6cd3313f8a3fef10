"""Documents for the operator tests, with nulls, repeats, extremes and clashing extra columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *(T.StructField(n, T.StringType()) for n in ("seed", "key", "node", "component", "score", "_text", "id", "words", "shard", "toxic_", "bin")),
])
CLASHING = 11
WORDS = {
    "en": "the of and to in that was for with this from house river stone light water green north window garden".split(),
    "de": "der die das und nicht von mit auf für über haus fluss stein licht wasser grün norden fenster garten schön".split(),
    "fr": "le la les des et que pour dans avec être maison rivière pierre lumière eau verte nord fenêtre jardin forêt".split(),
}


def prose(rng, n, lang="en"):
    return " ".join(rng.choice(WORDS[lang]) + (str(rng.randrange(1000)) if rng.random() < 0.3 else "") for _ in range(n))


def frame(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, None, None)[:4]
        full.append((doc_id, text, lang, source, None if text is None else len(text), *["x"] * CLASHING))
    return spark.createDataFrame(full, SCHEMA)


def awkward(seed=0, n=60):
    """Rows with every kind of trouble."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(1, 120), lang), lang, f"s{i % 3}") for i, lang in ((i, rng.choice(list(WORDS))) for i in range(n))]
    rows += [(1000, None, "en", None), (1001, "", None, "s0"), (1002, "   \n\t ", "en", "s0"), (1003, "?!., 123", "en", "s1"), (None, "text without an id " * 5, None, "s1")]
    rows += [(1004, prose(rng, 20_000), "en", "s0"), (1005, "é" * 70_000, "fr", "s0"), (1006, rows[0][1], "en", "s0"), (1007, rows[0][1], None, None), rows[3], rows[3]]
    rows += [(1008, "x\x00y <|endoftext|> \U0001f600\U0001f468\u200d\U0001f469 日本語 ١٢٣ \u00a0 \u2003 don't WE'LL", "en", "s2")]
    return rows
