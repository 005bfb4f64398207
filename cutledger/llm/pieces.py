"""SentencePiece encoding and decoding (operator 7) on the tokenizers library, rebuilt from a model's bytes."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from .words import chunks, text_bytes

SPACE = "▁"
#: Format of the model file: field numbers of its messages, and the values of its enums.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: A model of more bytes isn't sent to the executors.
MOST_BYTES = 64 << 20


@dataclass
class Model:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim: bool = True
    escape: bool = True
    suffix: bool = False


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        elif tag & 7 == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif tag & 7 in (1, 5):
            size = 8 if tag & 7 == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {tag & 7}")
        yield tag >> 3, value


def parse(data: bytes) -> Model:
    """Reads a model file's bytes."""
    out = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            out.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(_fields(value))
            out.kind, out.byte_fallback, out.suffix = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(_fields(value))
            out.charsmap, out.dummy_prefix, out.trim, out.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
    return out


def _merges(model: Model, ids: dict[str, int]) -> list[tuple[str, str]]:
    """All pairs of pieces that make a piece, by that piece's score, then by its place."""
    order = sorted((i for i, p in enumerate(model.pieces) if p[2] in (NORMAL, USER) and len(p[0]) > 1), key=lambda i: (-model.pieces[i][1], i))
    out = []
    for i in order:
        text = model.pieces[i][0]
        pairs = [(text[:k], text[k:]) for k in range(1, len(text)) if text[:k] in ids and text[k:] in ids]
        out += sorted(pairs, key=lambda p: (ids[p[0]], ids[p[1]]))
    return out


def words_apart(model: Model) -> bool:
    """Whether no piece joins a word to the blanks after it: then text can be cut before each run of blanks."""
    return all(SPACE not in p.lstrip(SPACE) for p, _, kind in model.pieces if kind in (NORMAL, USER)) and not model.suffix


def build(data: bytes) -> Tokenizer:
    """A tokenizer with the model's pieces, scores or merges, normaliser, blank marker and byte fallback."""
    model = parse(data)
    ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
    if model.kind == BPE:
        plain = {p: i for p, i in ids.items()}
        core = models.BPE(plain, _merges(model, ids), unk_token=model.pieces[unknown][0] if unknown is not None else None, fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind}")
    steps: list = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.trim:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.escape:
        steps.append(normalizers.Replace(" ", SPACE))
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE if model.escape else " "))
    out = Tokenizer(core)
    out.normalizer = normalizers.Sequence(steps)
    if words_apart(model) and model.escape:
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    out.encode_special_tokens = True
    return out


#: Words that a Python worker remembers with their ids, and words that are encoded as one text.
REMEMBERED, JOINED = 1 << 19, 256
#: Latin letters (Basic Latin, Latin-1, Extended-A and -B).
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"


def cuts(model: Model) -> tuple[str, bool]:
    """A pattern that cuts normalised text into words no piece joins, and whether a line's end is a word of its own.

    Blanks go with what stands after them. Where no piece holds a Latin letter beside another character (but for
    blanks before it), letters are words apart from the rest; where no longer piece holds a line's end, it is a word of its
    own. Without byte fallback unknown characters in a row are one piece, so then only blanks cut.
    """
    pieces = [p.lstrip(SPACE) for p, _, kind in model.pieces if kind in (NORMAL, USER)]
    lines = model.byte_fallback and not any("\n" in p and len(p) > 1 for p, _, kind in model.pieces if kind in (NORMAL, USER))
    letters = lines and all(len({bool(re.match(f"[{LETTERS}]", c)) for c in p}) < 2 for p in pieces)
    rest = f"{SPACE}\n" if lines else SPACE
    words = [f"{SPACE}*[{LETTERS}]+", f"{SPACE}*[^{LETTERS}{rest}]+"] if letters else [f"{SPACE}*[^{rest}]+"]
    return "|".join([*words, f"{SPACE}+", *["\n"] * lines]), lines


class Encoder:
    """Encodes and decodes lists of texts. Where words are independent, each distinct word is encoded once while it is remembered."""

    def __init__(self, data: bytes, threads: int) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        self.data, self.threads, self.model = data, threads, parse(data)
        self.whole = build(data)
        self.apart = self.whole.pre_tokenizer is not None
        #: the normaliser only marks blanks
        self.as_is = not self.model.charsmap and not self.model.trim and self.model.escape
        self.other = None
        surface = [self._surface(p, kind) for p, _, kind in self.model.pieces]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.width = np.array([len(x) for x in surface], np.int64)
        self.begin = np.cumsum(self.width) - self.width
        if self.apart:
            self.bare = build(data)
            self.bare.normalizer = normalizers.Sequence([])
            self.bare.pre_tokenizer = None
            pattern, lines = cuts(self.model)
            self.cut = re.compile(pattern).findall
            line = self.bare.encode("\n", add_special_tokens=False).ids
            #: the id that stands between words encoded as one text
            self.between = line[0] if lines and len(line) == 1 else None
            self._forget()

    @staticmethod
    def _surface(piece: str, kind: int) -> bytes:
        """The bytes that a piece stands for; 0xFF, which no text holds, for an unknown one."""
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return {UNKNOWN: b"\xff", CONTROL: b""}.get(kind, piece.replace(SPACE, " ").encode())

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.sizes, self.agree = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)

    def _theirs(self, texts: list[str]) -> list[list[int]]:
        """What the sentencepiece library makes of the texts."""
        if self.other is None:
            from sentencepiece import SentencePieceProcessor

            self.other = SentencePieceProcessor(model_proto=self.data)
        return self.other.encode(texts, num_threads=self.threads)

    def _own(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str], verify: bool) -> None:
        """Encodes words; if ``verify``, by the other library too. Words are joined by line ends where those are words by themselves."""
        prefix = int(self.model.dummy_prefix)
        if self.between is None or new == ["\n"]:
            got = self._own(new)
            flat = np.array([i for x in got for i in x], np.int32)
            sizes = np.array([len(x) for x in got], np.int64)
            agree = np.ones(len(new), bool)
            if verify:
                # the blank before a word is the one that the library puts before a text; a line's end has none, so it is in all joined texts
                agree[:] = [a == b or w == "\n" for w, a, b in zip(new, got, self._theirs([w[prefix:].replace(SPACE, " ") for w in new]), strict=True)]
        else:
            parts, sizes, agree = [], [], []
            groups = [new[i : i + JOINED] for i in range(0, len(new), JOINED)]
            joined = ["\n" + "\n".join(g) for g in groups]
            got = self._own([SPACE * prefix + j for j in joined])
            theirs = self._theirs([j.replace(SPACE, " ") for j in joined]) if verify else got
            for group, ids, their in zip(groups, got, theirs, strict=True):
                same = np.ones(len(group), bool)
                if ids != their:
                    single = ["\n" + w for w in group]
                    same[:] = [a == b for a, b in zip(self._own([SPACE * prefix + w for w in single]), self._theirs([w.replace(SPACE, " ") for w in single]), strict=True)]
                ids = np.array(ids[prefix:], np.int32)
                stop = ids == self.between
                sizes.append(np.diff(np.append(np.flatnonzero(stop), len(ids))) - 1)
                parts.append(ids[~stop])
                agree.append(same)
            flat, sizes, agree = map(np.concatenate, (parts, sizes, agree))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat])
        self.agree = np.concatenate([self.agree, agree])

    def _codes(self, words: list[str], verify: bool) -> np.ndarray:
        """The place of each word among those known; new ones are encoded together first."""
        codes = list(map(self.known.get, words))
        if None in codes:
            new = list(dict.fromkeys(w for w, c in zip(words, codes, strict=True) if c is None))
            if len(self.known) + len(new) > REMEMBERED and self.known:
                self._forget()
                return self._codes(words, verify)
            lines = [w for w in new if w == "\n"]
            new = [w for w in new if w != "\n"]
            for part in (new, lines):
                if part:
                    self._learn(part, verify)
            codes = list(map(self.known.get, words))
        return np.array(codes, np.int64)

    def normal(self, text: str) -> str:
        if self.as_is:
            return (SPACE if text and self.model.dummy_prefix else "") + text.replace(" ", SPACE)
        return self.whole.normalizer.normalize_str(text)

    def encode(self, texts: list[str], verify: bool = False) -> tuple[np.ndarray, np.ndarray, list[bool] | None]:
        """All ids, n + 1 bounds of the texts in them, and, if ``verify``, whether the sentencepiece library gives each text the same ids.

        Where words are independent and the normaliser only marks blanks, both libraries encode each distinct word,
        and texts whose blanks are not single ones between words as a whole too; else every text as a whole.
        """
        if not self.apart:
            got = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)
            return np.array([i for x in got for i in x], np.int32), bounds, [a == b for a, b in zip(got, self._theirs(texts), strict=True)] if verify else None
        split = [self.cut(self.normal(t)) for t in texts]
        counts = np.array([len(s) for s in split], np.int64)
        codes = self._codes(list(chain.from_iterable(split)), verify and self.as_is)
        starts = np.cumsum(self.sizes) - self.sizes
        own = self.sizes[codes]
        ends = np.concatenate([[0], np.cumsum(own)])
        at = np.repeat(starts[codes] - ends[:-1], own) + np.arange(int(ends[-1]))
        stops = np.concatenate([[0], np.cumsum(counts)])
        ids, bounds = self.flat[at], ends[stops]
        if not verify:
            return ids, bounds, None
        wrong = np.concatenate([[0], np.cumsum(~self.agree[codes])])[stops]
        parity = (np.diff(wrong) == 0).tolist()
        whole = [i for i, t in enumerate(texts) if not self.as_is or t[:1] == " " or t[-1:] == " " or "  " in t or SPACE in t]
        for i, theirs in zip(whole, self._theirs([texts[i] for i in whole]), strict=True):
            parity[i] = np.array_equal(ids[bounds[i] : bounds[i + 1]], theirs)
        return ids, bounds, parity

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the ids of each text decode to, and their n + 1 bounds; the blank put before a text is taken off."""
        width = self.width[ids]
        ends = np.concatenate([[0], np.cumsum(width)])
        data = self.surface[np.repeat(self.begin[ids] - ends[:-1], width) + np.arange(int(ends[-1]))]
        stops = ends[bounds]
        if self.model.dummy_prefix:
            some = stops[:-1] < stops[1:]
            first = stops[:-1][some]
            blank = np.zeros(len(stops) - 1, np.int64)
            blank[some] = data[first] == 32
            keep = np.ones(len(data), bool)
            keep[first[data[first] == 32]] = False
            data, stops = data[keep], stops - np.concatenate([[0], np.cumsum(blank)])
        return data, stops

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode_batch(ids, skip_special_tokens=False)


@lru_cache(maxsize=2)
def encoder(data: bytes, threads: int, verify: bool) -> Encoder:
    """One for all tasks of a Python worker; what it remembers is verified or not."""
    return Encoder(data, threads)


def same_bytes(data: np.ndarray, stops: np.ndarray, other: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """For each text whether its part of ``data`` is its part of ``other``."""
    size = np.diff(stops)
    same = size == np.diff(marks)
    if not same.all():
        own = np.repeat(same, size)
        data, other = data[own], other[np.repeat(same, np.diff(marks))]
        size = size[same]
    wrong = np.concatenate([[0], np.cumsum(data != other)])[np.concatenate([[0], np.cumsum(size)])]
    same[same] = np.diff(wrong) == 0
    return same


def _bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    return data


def encode(docs: DataFrame, model_path: str, threads: int = 2, verify: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids, same_text, parity for each row of ``docs`` (doc_id, text).

    ``model_path`` is read on the driver; its bytes (at most MOST_BYTES) go to the tasks. same_text: decoding the
    ids gives the text again (not so where the model's normaliser changes it). parity: the ids are those of the
    sentencepiece library, for every text (null if not ``verify``). A null text counts as empty and has no ids.
    Whole texts; special tokens' names in a text are ordinary text. Repeated rows give a row each; other columns
    are ignored, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(_bytes(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model.value, threads, verify)
        for part in chunks(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            ids, bounds, parity = coder.encode(texts, verify)
            same = same_bytes(*coder.decoded(ids, bounds), *text_bytes(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(bounds).astype(np.int64)),
                    pa.ListArray.from_arrays(bounds.astype(np.int32), ids.astype(np.int32)),
                    pa.array(same),
                    pa.array(parity or [None] * len(texts), pa.bool_()),
                ],
                names=["doc_id", "n_tokens", "ids", "same_text", "parity"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, same_text boolean, parity boolean")


def decode(encoded: DataFrame, model_path: str, threads: int = 2) -> DataFrame:
    """doc_id, text for each row of ``encoded`` (doc_id, ids); null ids give a null text, an id outside the model nothing."""
    model = encoded.sparkSession.sparkContext.broadcast(_bytes(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model.value, threads, False)
        for part in batches:
            ids = part.column("ids").to_pylist()
            texts = coder.decode([[i for i in x or [] if i is not None] for x in ids])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([None if x is None else t for x, t in zip(ids, texts, strict=True)], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
