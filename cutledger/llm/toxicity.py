"""Toxicity (operator 4): multiple-instance learning, sentence scores joined by noisy-or."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut
from .words import Words, chunks, text_bytes

#: Labelled documents that the model is fitted on at most (those with the least hash of doc_id).
SAMPLE = 6000
#: Words are features if that many of the sampled distinct texts hold them; the most telling ones stay.
LEAST_TEXTS, MOST_WORDS = 5, 20_000
#: Pairs of a sentence and a feature that the model is fitted on at most: texts count whole, in the order of their hash.
MOST_PAIRS = 4_000_000
#: Parts of the sample that take turns in being scored by a model fitted on the others, to calibrate scores.
FOLDS = 3
#: Besides a word, its first bytes are a feature of their own (for words that are longer).
PREFIX = 6
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True


@dataclass
class Model:
    """Sorted word hashes, their weights, and the log odds of a sentence without any of them; the line that makes a text's log odds those of label 1."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0


def sentences(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words, the sentence of each word, and for each sentence its text and its first word.

    A sentence ends after . ! ? or a line's end, and with the text; only those with a word count.
    """
    words = Words(texts, alnum=True)
    data, _ = text_bytes(texts)
    marks = np.cumsum(_END[data])
    owner = np.repeat(np.arange(len(texts)), np.diff(words.first))
    place = marks[words.start] if len(words.start) else np.zeros(0, np.int64)
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    return words, np.cumsum(new) - 1, owner[first], first


def fit(sent_doc: np.ndarray, sent_of: np.ndarray, word_of: np.ndarray, lean: np.ndarray, toxic: np.ndarray, rounds: int = 400, ridge: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights of the features and the bias, by minimising the loss of the noisy-or of sentences.

    ``sent_doc``: the text of each sentence; ``sent_of``, ``word_of``: sentence and feature of each distinct pair;
    ``lean``: log ratio of each feature's shares among toxic and other texts, from where the weights start.
    """
    n, words, bags = len(sent_doc), len(lean), len(toxic)
    order = np.argsort(word_of, kind="stable")
    by_word, sent_by_word = word_of[order], sent_of[order]
    y = toxic[sent_doc] == 1
    theta = np.append(np.clip(lean, -1, 3), -5.0)
    m1 = m2 = np.zeros(words + 1)
    for t in range(1, rounds + 1):
        z = theta[-1] + np.bincount(sent_of, theta[word_of], n)
        p = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-9, 1 - 1e-9)
        clean = np.exp(np.bincount(sent_doc, np.log1p(-p), bags))
        pull = np.where(y, -(clean / np.maximum(1 - clean, 1e-9))[sent_doc], 1.0) * p
        grad = np.append(np.bincount(by_word, pull[sent_by_word], words), pull.sum()) / bags
        grad[:-1] += ridge * theta[:-1] / np.sqrt(bags)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta = theta - 0.08 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
    return theta[:-1], float(theta[-1])


@dataclass
class Bags:
    """Texts as bags of sentences: the text of each sentence, sentence and feature of each distinct pair, the texts' labels."""

    sent_doc: np.ndarray
    sent_of: np.ndarray
    word_of: np.ndarray
    toxic: np.ndarray

    def part(self, texts: np.ndarray) -> Bags:
        """Those of ``texts`` (a mask) alone."""
        sents = texts[self.sent_doc]
        pairs = sents[self.sent_of]
        place = lambda mask, x: (np.cumsum(mask) - 1)[x]
        return Bags(place(texts, self.sent_doc[sents]), place(sents, self.sent_of[pairs]), self.word_of[pairs], self.toxic[texts])

    def lean(self, words: int) -> np.ndarray:
        """Log ratio of each feature's shares among toxic and other texts."""
        pair = np.unique(self.sent_doc[self.sent_of] * words + self.word_of)
        bad = self.toxic[pair // words] == 1
        n1 = int((self.toxic == 1).sum())
        return np.log((np.bincount(pair[bad] % words, minlength=words) + 0.5) / (n1 + 1)) - np.log((np.bincount(pair[~bad] % words, minlength=words) + 0.5) / (len(self.toxic) - n1 + 1))

    def fit(self, words: int) -> tuple[np.ndarray, float]:
        return fit(self.sent_doc, self.sent_of, self.word_of, self.lean(words), self.toxic)

    def log_odds(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return text_odds(bias + np.bincount(self.sent_of, weights[self.word_of], len(self.sent_doc)), self.sent_doc, len(self.toxic))


def text_odds(z: np.ndarray, sent_doc: np.ndarray, texts: int) -> np.ndarray:
    """Log odds of the noisy-or of each text's sentences, from theirs; at least -30, for a text without any too."""
    p = np.minimum(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 - 1e-12)
    clean = np.bincount(sent_doc, np.log1p(-p), texts)
    return np.clip(np.log(np.maximum(-np.expm1(clean), 1e-13)) - clean, -30, 30)


def calibrate(odds: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Scale and shift of log odds that make them those of label 1: logistic regression, by Newton steps."""
    h = np.stack([odds, np.ones(len(odds))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(h @ w, -30, 30)))
        step = np.linalg.solve((h * (p * (1 - p) + 1e-9)[:, None]).T @ h + np.diag([1e-3, 1e-3]), h.T @ (toxic - p) - 1e-3 * (w - [1, 0]))
        w += np.clip(step, -0.5, 0.5)
        if np.abs(step).max() < 1e-6:
            break
    # texts keep their order
    return max(float(w[0]), 0.1), float(w[1])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct features of each text."""
    for part in chunks(batches):
        words = Words(part.column("text"), alnum=True)
        both = (words.hash, words.prefixes(PREFIX))
        rows = [np.unique(np.concatenate([x[a:b] for x in both])) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array([r[r != 0].astype(np.int64) for r in rows], pa.list_(pa.int64()))], names=["toxic", "feature"])


def cells(words: Words, sent: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a sentence and a known feature in it (known: sorted hashes)."""
    if not len(known) or not len(words.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = []
    for sign in (words.hash, words.prefixes(PREFIX)):
        at = np.minimum(np.searchsorted(known, sign), len(known) - 1)
        hit = known[at] == sign
        found.append(sent[hit] * len(known) + at[hit])
    pairs = np.unique(np.concatenate(found))
    return pairs // len(known), pairs % len(known)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled documents (text, toxic); equal texts count once, with their mean label rounded.

    The features are chosen by a grouped count over the sample; only their counts, and which sentence holds which (at
    most MOST_PAIRS), reach the driver. Scores of texts by models that did not see them calibrate the final model's.
    Without both labels the score is about 0 or about the labels' own value for every text.
    """
    ids = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("id"), "id", "toxic").limit(sample)
    rows = docs.where("text is not null").select(F.col("doc_id").alias("id"), "text").join(F.broadcast(ids), "id")
    rows = cut(rows.groupBy("text").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic")), "sample")
    seen = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n0, n1 = seen.get(0, 0), seen.get(1, 0)
    if not n0 or not n1:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0 if n1 else -30.0)
    counts = rows.mapInArrow(_features, "toxic int, feature array<long>").select("toxic", F.explode("feature").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
    lean = F.log((F.col("bad") + 0.5) / (n1 + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (n0 + 1))
    top = counts.where(F.col("n") >= LEAST_TEXTS).withColumn("lean", lean).orderBy((F.abs("lean") * F.sqrt("n")).desc(), "feature").limit(MOST_WORDS).select("feature").toPandas()
    known = np.sort(top["feature"].to_numpy(np.int64).view(np.uint64))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            words, sent, sent_doc, _ = sentences(part.column("text"))
            s, w = cells(words, sent, known)
            first = np.searchsorted(sent_doc, np.arange(part.num_rows + 1))
            bounds = np.searchsorted(s, first).astype(np.int32)
            local = (s - first[sent_doc[s]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("toxic"), pa.array(np.diff(first).astype(np.int32)), pa.ListArray.from_arrays(bounds, local), pa.ListArray.from_arrays(bounds, w.astype(np.int32))],
                names=["key", "toxic", "sentences", "sent", "word"],
            )

    found = rows.select(F.xxhash64("text").alias("key"), "text", "toxic").mapInArrow(held, "key long, toxic int, sentences int, sent array<int>, word array<int>")
    found = cut(found, "bags")
    sizes = found.select("key", F.size("word").alias("n")).toPandas().sort_values("key", ignore_index=True)  # a row for each of the sample
    most = int(np.searchsorted(np.cumsum(sizes["n"].to_numpy(np.int64)), MOST_PAIRS, side="right"))
    got = found.where(F.col("key") <= int(sizes["key"].iloc[max(min(most, len(sizes)) - 1, 0)])).toPandas().sort_values("key", ignore_index=True)
    sents = got["sentences"].to_numpy(np.int64)
    sent_of, word_of = (np.concatenate([np.asarray(x, np.int64) for x in got[c]]) for c in ("sent", "word"))
    sent_of += np.repeat(np.cumsum(sents) - sents, got["sent"].map(len))
    bags = Bags(np.repeat(np.arange(len(got)), sents), sent_of, word_of, got["toxic"].to_numpy())
    odds = np.zeros(len(got))
    for fold in range(FOLDS):
        mine = np.arange(len(got)) % FOLDS == fold
        odds[mine] = bags.part(mine).log_odds(*bags.part(~mine).fit(len(known)))
    weights, bias = bags.fit(len(known))
    big = np.abs(weights) > 1e-3
    return Model(known[big], weights[big], bias, *calibrate(odds, bags.toxic))


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, held_out (passed), score, offending: (start, end, score) of sentences that score ``least`` or more.

    start and end count code points of the text from the first to after the last word. A null or empty text, or
    one without a word, scores 0. The score of a text is 1 - product of (1 - sentence score), calibrated: whole texts,
    any length; word order within a sentence and repeats in it don't count. Repeated rows give a row each; other
    columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            texts = part.column("text")
            words, sent, sent_doc, first = sentences(texts)
            z = np.full(len(first), model.bias)
            held, which = cells(words, sent, model.words)
            z += np.bincount(held, model.weights[which], len(first))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            p = np.minimum(p, 1 - 1e-12)
            total = 1 / (1 + np.exp(-np.clip(model.scale * text_odds(z, sent_doc, len(texts)) + model.shift, -30, 30)))
            total[np.bincount(sent_doc, minlength=len(texts)) == 0] = 0
            bad = np.flatnonzero(p >= least)
            data, offsets = text_bytes(texts)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            last = np.append(first[1:], len(words.hash)) - 1
            spans = [[] for _ in range(len(texts))]
            for s in bad:
                base = points[offsets[sent_doc[s]]]
                spans[sent_doc[s]].append({"start": int(points[words.start[first[s]]] - base), "end": int(points[words.end[last[s]]] - base), "score": float(p[s])})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.clip(total, 0, 1)), pa.array(spans, kind)], names=["doc_id", "held_out", "score", "offending"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, offending array<struct<start:int,end:int,score:double>>")
