from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from cutledger.llm import pii, queries

from .common import docs, edge_docs, prose

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if ok(k, m.group())]


def found(df):
    return [[(s.kind, s.start, s.end) for s in r.x] for r in df.select(pii.base_spans(F.col("text")).alias("x")).collect()]


def test_spans_are_those_of_the_patterns(spark):
    rng = random.Random(1)
    bits = ["a@b.co", "x_y%z@q-r.s.t", "@", ".", "..", "-", "+", " ", "(", ")", "é", "😀", "1", "22", "255", "256", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 123-4567", "10.0.0.1", "999.1.1.1", "\x01", "\x02", "_", "com", "a", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += ["a@b.com_x@c.de", "1.2.3.4.5.6.7.8", "00255.0.0.01", "1" * 3000, "a." * 3000 + "@b", "a@b" + ".c" * 5000, "+" * 500 + "1" * 20]
    assert found(docs(spark, texts).coalesce(1)) == [spans(t) for t in texts]


def test_query_digests(spark, data):
    got = {r.doc_id: r for r in queries.op5_pii(spark, data).collect()}
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        want = spans(r.text)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [got[r.doc_id][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS]
        assert got[r.doc_id].spans.startswith(text)


def test_a_term_that_gives_an_entity_away_is_found(spark):
    rng = random.Random(2)
    texts = [f"{prose(20, rng)} write to Zorblax at zed@corp.example soon {prose(20, rng)}" for _ in range(6)]
    texts += [prose(25, rng) for _ in range(900)] + ["we met Zorblax again " + prose(9, rng)]
    rows = docs(spark, texts)
    got = {r.doc_id: r for r in pii.find(rows).collect()}
    last = texts[-1]
    (span,) = got[len(texts) - 1].terms
    assert last[span.start : span.end] == "Zorblax"
    common = {texts[i][s.start : s.end] for i, r in got.items() for s in r.terms}
    assert "Zorblax" in common and not common & {"kdoesnotexist"}
    assert all(not r.terms for i, r in got.items() if 6 <= i < len(texts) - 1)
    clean = {r.doc_id: r.text for r in pii.sanitise(rows).collect()}
    assert "Zorblax" not in clean[len(texts) - 1] and "zed@corp.example" not in clean[0] and "[EMAIL]" in clean[0]
    assert clean[10] == texts[10]


def told(texts):
    """term -> replacement, by counting in the plainest way: pairs of entities and words beside them, over distinct texts."""
    import math
    from collections import defaultdict

    import regex

    words = lambda t: set(regex.findall(r"\p{L}{3,}", t.lower()))
    texts = {t or "" for t in texts}
    holds, near, owns, pairs, contexts = (defaultdict(set) for _ in range(5))
    for t in texts:
        for w in words(t):
            holds[w].add(t)
        for kind, a, b in spans(t):
            value = t[a:b]
            entity = kind, value.lower() if kind == "email" else value if kind == "ip" else re.sub("[^0-9]", "", value)
            left, right = t[max(0, a - pii.CONTEXT) : a], t[b : b + pii.CONTEXT]
            left = re.sub(r"^\S+", "", left) if a > pii.CONTEXT else left
            right = re.sub(r"\S+$", "", right) if len(right) == pii.CONTEXT else right
            both = f"{left} {right}".lower()
            owns[entity].add(t)
            for w in words(both):
                near[w].add(t)
                pairs[entity, w].add(t)
                contexts[entity, w].add(both)
    best = {}
    for (entity, w), shown in pairs.items():
        n, share = len(shown), len(shown) / len(holds[w])
        bits = math.log2(n * len(texts) / (len(holds[w]) * len(owns[entity])))
        if n >= pii.LEAST_DOCS and len(contexts[entity, w]) >= pii.LEAST_CONTEXTS and share >= pii.DISCLOSES and bits >= pii.BITS:
            best[w] = max(best.get(w, 0), share)
    return {w: "" if share >= pii.REMOVED else "[TERM]" for w, share in best.items()}


def test_disclosing_terms_are_those_of_brute_force(spark, data):
    import regex

    rng = random.Random(7)
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    owners = [("Quellbar", "quell@corp.example", 5), ("Vimtor", "+1 555 123 4567", 4), ("Drosk", "10.1.2.3", 3), ("Rarely", "once@corp.example", 2), ("Münchow", "4111 1111 1111 1111", 6)]
    for name, data_of, n in owners:
        texts += [f"{prose(rng.randint(3, 30), rng)} {name} has {data_of}, {prose(rng.randint(3, 30), rng)}" for _ in range(n)]
        texts += [f"{prose(8, rng)} {name} again" for _ in range(0 if name == "Vimtor" else n // 3)]
    texts += texts[-3:] + [None, ""] + [prose(rng.randint(5, 40), rng) for _ in range(900)]
    want = told(texts)
    assert {"quellbar", "vimtor", "drosk", "münchow"} <= set(want) and "rarely" not in want and set(want.values()) == {"", "[TERM]"}
    got = {r.doc_id: r for r in pii.find(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        mine = [(m.start(), m.end(), want[m.group().lower()]) for m in regex.finditer(r"\p{L}{3,}", t or "") if m.group().lower() in want]
        assert [(s.start, s.end, s.tag) for s in got[i].terms] == mine


def test_redaction_covers_overlaps(spark):
    texts = ["call 4111 1111 1111 1111 or a@1.2.3.4 now", "é 10.0.0.1", None, ""]
    rows = pii.sanitise(docs(spark, texts))
    got = {r.doc_id: r for r in rows.collect()}
    assert got[0].text == "call [CARD] or [EMAIL] now"
    assert got[1].text == "é [IP]" and got[1].n_chars == 6
    assert got[2].text is None and got[3].text == ""


def test_edges(spark):
    frame = edge_docs(spark)
    assert pii.find(frame).count() == 11
    out = pii.sanitise(frame)
    assert out.columns == frame.columns and out.count() == 11
    assert pii.find(frame.limit(0)).count() == 0 and pii.sanitise(frame.limit(0)).count() == 0


def test_a_megabyte_of_spans(spark):
    """A text of 60,000 addresses is found, put in context and redacted in seconds, not in the square of them."""
    import time

    text = "é \U0001f600 intro, " + " ".join(f"u{i}@ex{i % 977}.org" for i in range(60_000)) + " end"
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    frame.select(pii.base_spans(F.lit("a@b.cd"))).collect()
    start = time.time()
    spans = frame.select(pii.base_spans(F.col("text")).alias("s"), "text").select("s", pii.redact(F.col("text"), F.col("s")).alias("r"), pii._contexts(F.col("text"), F.col("s")).alias("c"))
    row = spans.selectExpr("size(s) as n", "s[59999] as last", "r", "size(c) as k", "c[30000].terms as t").collect()[0]
    assert row.n == row.k == 60_000 and text[row.last.start : row.last.end] == "u59999@ex402.org" and row.r == "é \U0001f600 intro, " + " ".join(["[EMAIL]"] * 60_000) + " end"
    assert time.time() - start < 40
