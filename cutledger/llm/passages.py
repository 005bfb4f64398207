"""Substring dedup (operator 2): passages that repeat across documents, by paragraph MinHash banding.

A passage can start and end anywhere, in a line or over lines, so each run of PARAGRAPH words counts as a paragraph.
Its band is the MinHash of its five 5-word shingles (one row a band: runs that share many paragraphs have many bands,
and one is enough). Neighbouring paragraphs mostly have the same least shingle, which is kept once, at its place.
Documents whose bands collide are joined; along the shift at which they collide their words are compared exactly, and
a passage is what edit distance by substitution leaves: words that all lie in windows of LEAST words with SHARE equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .filters import in_filter, seed_filter
from .scratch import cut, drop
from .words import Words, chunks, mix, text_bytes

SHINGLE = 5
#: Nine words, five shingles: any nine words in a row that two texts share give both the same band, so of passages in
#: which each tenth word is another one none is missed.
PARAGRAPH = 9
#: The shortest passage, and the share of equal words in it.
LEAST, SHARE = 20, 0.8
#: Bytes of a word's hash that are compared: other words are taken for equal once in 2e7.
HASH = 3
#: Words compared beyond the outermost common bands of a shift.
BEYOND = 32
#: Documents without an id have keys from here on: behind all others.
_NO_ID = 1 << 62


def _sliding(x: np.ndarray, size: int, f: np.ufunc) -> np.ndarray:
    """f over x[i : i + size] for each i, by doubling."""
    out, width = x, 1
    while width * 2 <= size:
        out = f(out[:-width], out[width:])
        width *= 2
    if width < size:
        rest = size - width
        out = f(out[:-rest], out[rest:])
    return out


def bands(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted word indexes at which a least shingle of a paragraph starts, and those shingles' hashes."""
    hashes, whole = words.shingles(SHINGLE)
    n, size = len(hashes), PARAGRAPH - SHINGLE + 1
    if n < PARAGRAPH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    least = _sliding(hashes, size, np.minimum)
    last = np.arange(len(least)) + size - 1
    # no hash is 0: a window over two texts chooses nothing
    least = np.where((owner[: len(least)] == owner[last]) & whole[last], least, 0)
    padded = np.concatenate([np.zeros(size - 1, np.uint64), least, np.zeros(size - 1, np.uint64)])
    at = np.flatnonzero((_sliding(padded, size, np.maximum)[:n] == hashes) & whole)
    return at, hashes[at]


def key(doc_id: Column, text: Column) -> Column:
    """A document's number: its doc_id; without one, a number of its text behind all ids."""
    return F.coalesce(doc_id.cast("long"), F.shiftrightunsigned(F.xxhash64(text), 2).bitwiseOR(F.lit(_NO_ID)))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.where(text.isNotNull()).select(key(F.col("doc_id"), text).alias("doc"), text.alias("text"))


def beside(words: Words, at: np.ndarray) -> np.ndarray:
    """Four bits of each of the four words before a shingle (upper half) and after it (lower half); 0 beyond the text."""
    owner = np.searchsorted(words.first, at, side="right") - 1
    low, high = words.first[owner], words.first[owner + 1]
    bits = words.hash & np.uint64(15)
    out = np.zeros(len(at), np.uint64)
    for step in (-4, -3, -2, -1, SHINGLE, SHINGLE + 1, SHINGLE + 2, SHINGLE + 3):
        place = at + step
        inside = (place >= low) & (place < high)
        out = (out << np.uint64(4)) | np.where(inside, bits[np.where(inside, place, 0)], np.uint64(0))
    return out


def alike(a: Column, b: Column) -> Column:
    """Whether three of the four words before, or of those after, agree in what ``beside`` keeps."""
    x = a.bitwiseXOR(b)
    other = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3)).bitwiseAND(F.lit(0x11111111))
    return (F.bit_count(other.bitwiseAND(F.lit(0xFFFF))) <= 1) | (F.bit_count(F.shiftrightunsigned(other, 16).bitwiseAND(F.lit(0xFFFF))) <= 1)


def elsewhere(met: DataFrame, bands: DataFrame) -> DataFrame:
    """doc, mark, other, its_mark: of the occurrences in ``met`` (doc, band, mark) of some ``bands``, each with the first document that has the band with the same three of the four words before, or after.

    Eight keys an occurrence say which three words, and what they are; rows grow with the occurrences, never with their pairs.
    """
    some = met.join(bands.hint("merge"), "band", "left_semi")
    masks = [m << side for side in (0, 16) for m in (0xFFF0, 0xFF0F, 0xF0FF, 0x0FFF)]
    keys = F.array(*[F.xxhash64("band", F.lit(m), F.col("mark").bitwiseAND(F.lit(m))) for m in masks])
    rows = some.select("doc", "mark", F.explode(keys).alias("key"))
    firsts = rows.groupBy("key").agg(F.min("doc").alias("other"), F.min_by("mark", "doc").alias("its_mark"), F.max("doc").alias("two"))
    return rows.join(firsts.where("other < two").drop("two").hint("merge"), "key").where("doc > other").drop("key").distinct()


def occurrences(docs: DataFrame, first: bool = False) -> DataFrame:
    """doc, band, mark (place of its shingle in the upper half, what ``beside`` keeps in the lower) of each paragraph's band; of equal ones of a document only the ``first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            words = Words(part.column("text"), alnum=True)
            at, found = bands(words)
            if not len(at):
                continue
            owner = np.searchsorted(words.first, at, side="right") - 1
            mark = ((at - words.first[owner]).astype(np.uint64) << np.uint64(32)) | beside(words, at)
            if first:
                order = np.lexsort((found, owner))  # stable, and places rise
                new = np.ones(len(at), bool)
                new[1:] = (found[order][1:] != found[order][:-1]) | (owner[order][1:] != owner[order][:-1])
                keep = np.sort(order[new])
                owner, found, mark = owner[keep], found[keep], mark[keep]
            yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(owner)), pa.array(found.astype(np.int64)), pa.array(mark.astype(np.int64))], names=["doc", "band", "mark"])

    return _keyed(docs).mapInArrow(run, "doc long, band long, mark long")


def word_hashes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, words (HASH bytes of each word's hash) of the documents in ``wanted`` (doc).

    A filter of fixed size goes to the tasks, so that of the others few are dealt out for the join.
    """
    bits = docs.sparkSession.sparkContext.broadcast(seed_filter(wanted.select(F.col("doc").alias("seed"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = mix(batch.column("doc").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            for part in chunks(iter([batch.filter(pa.array(in_filter(bits.value, keys)))])):
                words = Words(part.column("text"), alnum=True)
                raw = np.ascontiguousarray(words.hash.view(np.uint8).reshape(-1, 8)[:, :HASH]).tobytes()
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([raw[HASH * a : HASH * b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)], pa.binary())], names=["doc", "words"])

    found = _keyed(docs).mapInArrow(run, "doc long, words binary").join(wanted.hint("merge"), "doc", "left_semi")
    return found.groupBy("doc").agg(F.min("words").alias("words"))


def passages(same: np.ndarray, first: np.ndarray, least: int = LEAST, share: float = SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and end of the passages of many rows of equal and other words, laid end to end (row i is same[first[i] : first[i + 1]]): words in windows of ``least`` with ``share`` equal, ends equal."""
    none = np.zeros(0, np.int64)
    if len(same) < least:
        return none, none, none
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    total = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero((total[least:] - total[:-least] >= int(np.ceil(share * least - 1e-9))) & (owner[least - 1 :] == owner[: len(owner) - least + 1]))
    if not len(good):
        return none, none, none
    row = owner[good]
    new = np.flatnonzero((np.diff(good, prepend=-least - 1) > least) | (np.diff(row, prepend=-1) > 0))
    row, hit = row[new], np.flatnonzero(same)
    start = hit[np.searchsorted(hit, good[new])]
    end = hit[np.searchsorted(hit, np.append(good[new[1:] - 1], good[-1]) + least) - 1] + 1
    return row, start - first[row], end - first[row]


def parts(same: np.ndarray, least: int = LEAST, share: float = SHARE) -> list[tuple[int, int]]:
    """The passages (first, end) of one row."""
    _, start, end = passages(same, np.array([0, len(same)]), least, share)
    return list(zip(start.tolist(), end.tolist(), strict=True))


def compared(docs: DataFrame, shifts: DataFrame, least: int, share: float) -> DataFrame:
    """doc, word, n, other, its_word: each passage of ``doc`` that ``other`` has too, at the shifts (doc, other, shift, first, last) given."""
    docs_of = cut(shifts.select("doc").union(shifts.select(F.col("other").alias("doc"))).distinct(), "wanted")
    # written, so that both sides of the joins are plain shuffles, whose hot keys can be split
    words = cut(word_hashes(docs, docs_of), "words")
    low = F.greatest(F.lit(0), F.col("shift"), F.col("first") - BEYOND)
    near = shifts.withColumn("low", low).withColumn("size", F.col("last") + SHINGLE + BEYOND - F.col("low"))
    piece = lambda start: F.expr(f"substring(words, cast({HASH} * ({start}) + 1 as int), cast({HASH} * size as int))")
    near = near.join(words.hint("merge"), "doc").withColumn("mine", piece("low")).drop("words", "first", "last")
    near = near.join(words.select(F.col("doc").alias("other"), "words").hint("merge"), "other").withColumn("theirs", piece("low - shift"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "mine"):
            (mine, ends), (theirs, _) = text_bytes(b.column("mine")), text_bytes(b.column("theirs"))
            equal = mine == theirs
            row, start, end = passages(np.logical_and.reduce([equal[k::HASH] for k in range(HASH)]), ends // HASH, least, share)
            doc, other, shift, low = (b.column(c).to_numpy().astype(np.int64)[row] for c in ("doc", "other", "shift", "low"))
            columns = [doc, low + start, end - start, other, low + start - shift]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc", "word", "n", "other", "its_word"])

    # both as long as the shorter one is, so that rows can be laid end to end
    near = near.select("doc", "other", "shift", "low", F.expr("substring(mine, 1, length(theirs))").alias("mine"), F.expr("substring(theirs, 1, length(mine))").alias("theirs"))
    found = near.mapInArrow(run, "doc long, word long, n long, other long, its_word long")
    found = cut(found.distinct(), "links")
    drop(words, docs_of)
    return found


def _runs(spans: DataFrame) -> DataFrame:
    """doc, word, run, end: the start and the end of the union of overlapping spans (doc, word, end) that each span is in."""
    once = spans.groupBy("doc", "word").agg(F.max("end").alias("end"))
    order = Window.partitionBy("doc").orderBy("word")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    starts = once.withColumn("new", F.when(F.coalesce(F.max("end").over(before), F.lit(-1)) <= F.col("word"), F.col("word")))
    named = starts.withColumn("run", F.max("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return named.select("doc", "word", "run", "end")


def repeated(docs: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """Passages of ``docs`` (doc_id, text) that another document has too.

    Returns doc_id, first_word, n_words (in words as below), copy_of, removed. Two documents share a passage where,
    at one shift, every word lies in a window of ``least`` words of which ``share`` are equal; of overlapping ones the
    union counts. A passage that an earlier document (smaller doc_id) has too is removed; one that only later ones
    have stays, so that one of each stays. copy_of: the smallest doc_id of the cluster, the component of passages
    that are linked or overlap in a document.

    Words are runs of letters and digits, lower-cased (A-Z). Null and empty texts and those of under ``least`` words
    have no passage. Rows without a doc_id come after all others, as one document for each text; their doc_id is
    null here. Rows equal in doc_id and text count once; of a doc_id with several texts one text is compared. Repeats
    inside one document don't count. Other columns are ignored, whatever their names.

    A band links each document that has it to the first that has it, never all pairs, if three of the four words before
    or after it agree; where they don't for some document, also to the first with the same three of these (``elsewhere``);
    documents linked at one shift are compared once there. Each step is an aggregate with partial sums or a join whose hot keys can be split.
    """
    spread = occurrences(docs, first=True).groupBy("band").agg(F.min("doc").alias("other"), F.min_by("mark", "doc").alias("its_mark"), F.max("doc").alias("two"))
    spread = cut(spread.where("other < two").drop("two"), "spread")
    met = cut(occurrences(docs).join(spread.hint("merge"), "band").where("doc >= other"), "met")
    place = lambda c: F.shiftright(c, 32).cast("int")
    line = lambda rows: rows.select("doc", "other", place("mark").alias("word"), (place("mark") - place("its_mark")).alias("shift"))
    same = alike(F.col("mark"), F.col("its_mark"))
    other = F.col("doc") > F.col("other")
    lines = line(met.where(other & same)).unionByName(line(elsewhere(met, met.where(other & ~same).select("band").distinct())))
    shifts = cut(lines.groupBy("doc", "other", "shift").agg(F.min("word").alias("first"), F.max("word").alias("last")), "shifts")
    drop(spread, met)
    links = compared(docs, shifts, least, share)
    drop(shifts)
    mine = links.select("doc", "word", (F.col("word") + F.col("n")).alias("end"))
    theirs = links.select(F.col("other").alias("doc"), F.col("its_word").alias("word"), (F.col("its_word") + F.col("n")).alias("end"))
    places = cut(_runs(mine.unionByName(theirs)), "places")
    node = lambda doc: F.xxhash64(doc, "run")
    ends = links.join(places.select("doc", "word", node("doc").alias("a")), ["doc", "word"])
    ends = ends.join(places.select(F.col("doc").alias("other"), F.col("word").alias("its_word"), node("doc").alias("b")), ["other", "its_word"])
    reached = components(ends.select("a", "b"))
    named = places.groupBy("doc", "run").agg(F.max("end").alias("end")).withColumn("node", node("doc")).join(reached, "node")
    named = named.join(named.groupBy("comp").agg(F.min("doc").alias("copy_of")), "comp").select("doc", "run", "end", "copy_of")
    named = cut(named, "clusters")
    gone = _runs(mine).groupBy("doc", F.col("run").alias("word")).agg(F.max("end").alias("end"))
    gone = gone.join(places.drop("end"), ["doc", "word"]).select("doc", "run", "word", (F.col("end") - F.col("word")).alias("n"))
    stay = named.join(gone, ["doc", "run"], "left_anti").select("doc", "run", "copy_of", F.col("run").alias("word"), (F.col("end") - F.col("run")).alias("n"), F.lit(False).alias("removed"))
    out = stay.unionByName(gone.join(named.drop("end"), ["doc", "run"]).withColumn("removed", F.lit(True)))
    bare = lambda c: F.when(F.col(c) < _NO_ID, F.col(c))
    return out.select(bare("doc").alias("doc_id"), F.col("word").alias("first_word"), F.col("n").alias("n_words"), bare("copy_of").alias("copy_of"), "removed")
