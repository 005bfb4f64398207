from __future__ import annotations

import random

WORDS = [a + b + c for a in ("ka", "lo", "mi", "su", "te") for b in ("ran", "vel", "dor", "pix") for c in ("", "e", "um", "ix", "or")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n: int, rng: random.Random) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(spark, texts, schema=SCHEMA):
    """texts: list of text, or of (doc_id, text)."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t) if t is not None else None) for i, t in rows], schema)


def edge_docs(spark):
    """Nulls in every column, empty and blank texts, one word, a very long text, ties, repeated rows, names that clash."""
    rng = random.Random(5)
    long = prose(30_000, rng)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, long), (6, "word"), (6, "word"), (None, "no id " + prose(40, rng)), (7, long + " tail"), (8, "x" * 50_000), (9, "é😀 ü")]
    out = [(i, t, None if i == 4 else "en", None if i == 5 else "src0", None, 1, 2, 3, 4.0) for i, t in rows]
    return spark.createDataFrame(out, SCHEMA + ", n long, cls long, text_key long, score double")


def components(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
