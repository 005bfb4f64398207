"""SentencePiece encoding and decoding; edit-aware token counts."""

from __future__ import annotations

import random
import struct

import pytest

from cutledger.llm import pieces, queries, token_counts

from .common import docs, edge_docs

TEXTS = ["", " ", "a  b ", "\n x\t", "日本語 😀 text", "▁", "a▁b", "<s> hi </s>", "<0x41>", "é́ ", "x" * 60 + " " * 5, "Hello, world. " * 30]


def field(number, kind, payload):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    tag = varint(number << 3 | kind)
    return tag + (varint(payload) if kind == 0 else payload if kind == 5 else varint(len(payload)) + payload)


def unigram_model(byte_fallback):
    """A small unigram model: its file's bytes, with scores that make several cuts possible."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_fallback:
        rows += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    rows += [("▁", -2.0, 1), ("▁he", -3.1, 1), ("▁hello", -5.5, 1), ("llo", -3.2, 1), ("l", -4.0, 1), ("o", -4.1, 1), ("h", -4.2, 1), ("e", -4.3, 1), ("▁world", -6.0, 1), ("wor", -3.9, 1), ("ld", -3.8, 1), ("w", -5, 1), ("r", -5.1, 1), ("d", -5.2, 1)]
    out = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, k)) for p, s, k in rows)
    return out + field(2, 2, field(3, 0, 1) + field(35, 0, int(byte_fallback))) + field(3, 2, field(3, 0, 1) + field(4, 0, 1) + field(5, 0, 1))


@pytest.mark.parametrize("fallback", [False, True])
def test_unigram_parity(fallback):
    from sentencepiece import SentencePieceProcessor

    data = unigram_model(fallback)
    other = SentencePieceProcessor(model_proto=data)
    coder = pieces.Encoder(data, 1)
    texts = ["hello world", "hello  hello", " world held", "zé hello", "", "o", "wordl hello世"]
    ids, bounds, _ = coder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == other.encode(texts)
    known = [t for t in texts if fallback or set(t) <= set("helowrd ")]
    assert coder.decode(other.encode(known)) == other.decode(other.encode(known))


def test_bpe_parity_and_round_trip(spark, data):
    rows = docs(spark, TEXTS).select("doc_id", "text").unionByName(spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text"))
    out = pieces.encode(rows, queries.PIECES, verify=1)
    got = {r.doc_id: r for r in out.collect()}
    assert all(r.parity for r in got.values())
    texts = {r.doc_id: r.text for r in rows.collect()}
    back = {r.doc_id: r.text for r in pieces.decode(out, queries.PIECES).collect()}
    for i, t in texts.items():
        assert back[i] == t.replace("▁", " ")
        assert got[i].same_text == ("▁" not in t) and got[i].n_tokens == len(got[i].ids)


def test_joined_words_give_the_ids_of_whole_texts():
    from sentencepiece import SentencePieceProcessor

    data = pieces._bytes(queries.PIECES)
    other = SentencePieceProcessor(model_proto=data)
    rng = random.Random(8)
    bits = ["the", "Tion", "été", "²", ".", ",", "\n", " ", "  ", "▁", "12", "'s", "日本", "😀", "\t", "(", "x" * 30, "\r\n", "ñ", "—", "_", "\x00"[:0], "ǅ", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["\n" * 300, " \n ", "word\n"]
    coder = pieces.Encoder(data, 1)
    ids, bounds, parity = coder.encode(texts, True)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == other.encode(texts)
    assert all(parity)
    raw, stops = coder.decoded(ids, bounds)
    got = [bytes(raw[a:b]).decode() for a, b in zip(stops[:-1], stops[1:], strict=True)]
    assert got == coder.decode([ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)])


@pytest.mark.parametrize("joined", [True, False])
def test_another_encoding_of_one_word_shows_in_every_text_that_has_it(monkeypatch, joined):
    coder = pieces.Encoder(pieces._bytes(queries.PIECES), 1)
    if not joined:
        coder.between, coder.cut = None, __import__("re").compile("▁*[^▁]+|▁+").findall
    true = coder._theirs
    # the other library cuts the word "wrong" into letters
    letters = true(["x wrong"])[0][1:]
    split = [i for c in "wrong" for i in true([f"x\n{c}"])[0][2:]]

    def theirs(texts):
        out = []
        for ids in true(texts):
            for k in range(len(ids) - len(letters) + 1):
                if ids[k : k + len(letters)] == letters:
                    ids = ids[:k] + split + ids[k + len(letters) :]
                    break
            out.append(ids)
        return out

    monkeypatch.setattr(coder, "_theirs", theirs)
    texts = ["all is well", "this is wrong", "well", "", "so wrong again"]
    assert coder.encode(texts, True)[2] == [True, False, True, True, False]
    assert coder.encode(["well wrong", "this"], True)[2] == [False, True]


def test_pieces_edges(spark):
    got = pieces.encode(edge_docs(spark), queries.PIECES, verify=1).collect()
    assert len(got) == 11 and all(r.parity and r.same_text for r in got)
    assert pieces.encode(edge_docs(spark).limit(0), queries.PIECES).count() == 0


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts._bytes(queries.RANKS))


def test_pattern_is_that_of_the_files():
    import public_tokenizers

    assert token_counts.PATTERN == public_tokenizers.PATTERN


def test_edits_leave_the_tree_as_if_built_anew(counter):
    rng = random.Random(1)
    bits = ["", " ", "x", "'s", "\n\n", "  word ", "123", "!!", " \n", "é ü", "word", "'", "   "]
    for start in ["", "a", "it's   \n\n  x ", "   ", "The end. " * 90, "a1b2  c's\n" * 60, " " * 40]:
        tree, text = token_counts.Tree(start, counter), start
        for _ in range(60):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 0, 1, 3, 10, 200]))
            new = rng.choice(bits)
            change = tree.edit(a, b, new)
            before = len(counter.bpe.encode_ordinary(text))
            text = text[:a] + new + text[b:]
            assert tree.text == text and change == tree.total() - before
            assert [s for leaf in tree.sizes for s in leaf] == [len(p) for p in counter.pieces(text)]
            assert tree.total() == len(counter.bpe.encode_ordinary(text))
            for i in range(1, tree.width):
                assert tree.tokens[i] == tree.tokens[2 * i] + tree.tokens[2 * i + 1]


def test_counts_query(spark, data, counter):
    import hashlib
    import zlib

    got = {r.doc_id: r for r in queries.op9_token_counts(spark, data).collect()}
    for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect():
        t = r.text or ""
        half = len(t) // 2
        place = zlib.crc32(t.encode()) % (len(t) + 1)
        mine = t[:half] + t[half : half + 40].upper() + t[half + 40 :]
        mine = mine[:place] + t[:30] + mine[place:]
        mine = mine[7:]
        assert got[r.doc_id].n_tokens == len(counter.bpe.encode_ordinary(t))
        assert got[r.doc_id].n_after == len(counter.bpe.encode_ordinary(mine))
        assert got[r.doc_id].text_sha == hashlib.sha256(mine.encode()).hexdigest()
        assert got[r.doc_id].n_encoded < 120


def test_counts_edges(spark):
    from pyspark.sql import functions as F

    kind = "array<struct<start:int,finish:int,added:string>>"
    frame = edge_docs(spark).withColumn("edits", F.when(F.col("doc_id") < 6, F.from_json(F.lit('[{"start": -5, "finish": 99999999, "added": "new text"}, null, {"start": null, "finish": null, "added": null}, {"start": 50, "finish": 2, "added": "!"}]'), kind)))
    got = {r.doc_id: r for r in token_counts.counts(frame, queries.RANKS).collect()}
    assert len(got) == 10
    assert len({got[i].text_sha for i in range(1, 6)}) == 1 and got[8].n_after == got[8].n_tokens
    assert token_counts.counts(frame.limit(0), queries.RANKS).count() == 0


def test_kept_trees_take_later_edits(spark, data, counter):
    """Trees are written, edited, written and edited again; each time as if built anew, and little is encoded."""
    from pyspark.sql import functions as F

    from cutledger.llm.scratch import cut

    kind = "array<struct<start:int,finish:int,added:string>>"
    edits = lambda text: F.from_json(F.lit(text), kind)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    kept = cut(token_counts.trees(docs, queries.RANKS))
    one = cut(token_counts.edited(kept.withColumn("edits", edits('[{"start": 10, "finish": 12, "added": "  new"}]')), queries.RANKS))
    two = token_counts.edited(one.withColumn("edits", edits('[{"start": 3, "finish": 3, "added": "x"}, {"start": 0, "finish": 1, "added": ""}]')), queries.RANKS).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(two) == len(texts)
    for r in two:
        t = texts[r.doc_id]
        t = t[:10] + "  new" + t[12:]
        t = (t[:3] + "x" + t[3:])[1:]
        assert r.text == t and r.n_after == len(counter.bpe.encode_ordinary(t)) and r.n_encoded < 30
        assert sum(map(sum, r.counts)) == r.n_after and sum(map(sum, r.sizes)) == len(t)
