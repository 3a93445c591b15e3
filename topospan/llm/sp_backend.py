"""SentencePiece models through the tokenizers library.

The model protobuf is parsed into pieces, scores, types and normaliser flags; from them a
tokenizers `Tokenizer` is rebuilt: dummy prefix and metaspace marker, Unigram scores or BPE merges
(ordered by piece score, as SentencePiece merges), byte fallback, and the decoder. Texts are cut
before each run of markers, which changes nothing as long as no piece holds a marker after
another character (checked when the model is loaded; otherwise whole texts are segments). Each
worker gives the segments that it has not met to the Tokenizer's `encode_batch`, which normalises,
cuts and encodes them on several native threads, and holds each against SentencePiece itself;
`parity` tells whether all segments of a text agree (texts that end in a lone marker, which no
segment can stand for, are compared whole).

Defined results: null and empty texts give no tokens, `roundtrip` and `parity` true; very long
texts are encoded whole; repeated rows give equal values; the segment cache is bounded by
`cache_segments` and only saves time. The model file reaches executors through a broadcast of its
bytes (a model's size doesn't depend on the data, and is checked against `max_model_bytes`).
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings

MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes):
    """(number, value) of a protobuf message; groups don't occur in these files."""

    def varint(at):
        value = shift = 0
        while True:
            x = raw[at]
            at += 1
            value |= (x & 127) << shift
            shift += 7
            if x < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = raw[at : at + n], at + n
        elif kind == 2:
            n, at = varint(at)
            value, at = raw[at : at + n], at + n
        else:
            raise ValueError("not a SentencePiece model")
        yield key >> 3, value


class Model:
    """What a SentencePiece model file says, and the Tokenizer rebuilt from it."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(raw):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.types.append(own.get(3, _NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.unigram = trainer.get(3, 1) == 1
        self.byte_fallback = bool(trainer.get(35, 0))
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.squeeze = bool(normalizer.get(4, 1))
        self.charsmap = bytes(normalizer.get(2, b""))
        self.unknown = self.types.index(_UNKNOWN)
        if trainer.get(24, 0):
            raise ValueError("models with the marker as a suffix are not supported")
        self.cut = not any(re.search(f"[^{MARK}]{MARK}", p) for p, t in zip(self.pieces, self.types, strict=True) if t in (_NORMAL, _USER))

    def merges(self) -> list[tuple[str, str]]:
        """Pairs whose join is a piece, best-scored piece first; equal scores keep the ids' order."""
        ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == _NORMAL}
        found = []
        for p, i in ids.items():
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    found.append((-self.scores[i], i, ids[p[:k]], ids[p[k:]], p[:k], p[k:]))
        return [x[4:] for x in sorted(found)]

    def normalizer(self):
        from tokenizers import Regex, normalizers

        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        return normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])

    def tokenizer(self, bare: bool = False):
        """The Tokenizer; `bare` ones take segments that are normalised already."""
        from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

        if self.unigram:
            model = models.Unigram(list(zip(self.pieces, self.scores, strict=True)), self.unknown, self.byte_fallback)
        else:
            model = models.BPE(vocab={p: i for i, p in enumerate(self.pieces)}, merges=self.merges(), unk_token=self.pieces[self.unknown], fuse_unk=True, byte_fallback=self.byte_fallback)
        out = Tokenizer(model)
        if not bare:
            out.normalizer = self.normalizer()
            if self.cut:
                out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
            out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        return out

    def piece_bytes(self) -> list[bytes]:
        """What each id stands for when decoded."""
        return [bytes([int(p[3:5], 16)]) if t == _BYTE else b"" if t == _CONTROL else " ⁇ ".encode() if t == _UNKNOWN else p.replace(MARK, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]


class Codec:
    """Encodes and decodes batches of texts; kept by each worker."""

    def __init__(self, raw: bytes, cache_segments: int = 800_000, threads: int = 2):
        import sentencepiece

        self.model = Model(raw)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.bare, self.whole, self.prep = self.model.tokenizer(bare=True), self.model.tokenizer(), self.model.normalizer()
        self.own = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.plain = not self.model.charsmap and not self.model.squeeze and self.model.dummy_prefix and self.model.cut
        self.bytes, self.most, self.threads = self.model.piece_bytes(), cache_segments, threads
        self.ids: dict[str, bytes] = {}  # little-endian int32
        self.old: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.split = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        if self.plain and "  " not in text and MARK not in text and not text.startswith(" ") and not text.endswith(" "):
            return text.split(" ")
        whole = self.prep.normalize_str(text)
        cut = self.split(whole) if self.model.cut else [whole]
        return [x[1:] if self.plain and x[1:] and x[1] != MARK else x for x in cut]

    def spelled(self, segment: str) -> str:
        """A segment's normalised text: plain models' segments are keyed without a single leading marker."""
        return segment if not self.plain or segment.startswith(MARK) else MARK + segment

    def learn(self, segments: set[str]) -> None:
        """Ids of segments that the cache lacks, and whether SentencePiece gives the same.

        The cache has two generations of half the bound each; what the older holds moves on when used.
        """
        if 2 * len(self.ids) > self.most:
            self.old, self.ids = self.ids, {}
        asked = segments.difference(self.ids)
        if self.old:
            self.ids.update((x, self.old[x]) for x in asked.intersection(self.old))
            asked.difference_update(self.old)
        fresh = list(asked)
        got = self.tokenize(fresh)
        self.ids.update((x, array("i", ids).tobytes()) for x, ids in zip(fresh, got, strict=True))
        if self.plain and fresh:
            said = self.own.encode(list(map(self.raw, fresh)), num_threads=self.threads)
            self.odd.update(x for x, a, b in zip(fresh, said, got, strict=True) if a != b and x != MARK)

    def raw(self, segment: str) -> str:
        """A text that a plain model normalises to the segment."""
        return self.spelled(segment)[1:].replace(MARK, " ")

    def tokenize(self, segments: list[str]) -> list[list[int]]:
        """Ids of segments, by a batch of the whole Tokenizer; of normalised ones by one that doesn't normalise again."""
        if not self.plain:
            return [e.ids for e in self.bare.encode_batch_fast(segments, add_special_tokens=False)]
        out = [e.ids for e in self.whole.encode_batch_fast(list(map(self.raw, segments)), add_special_tokens=False)]
        lone = [t.id for t in self.bare.model.tokenize(MARK)]
        return [lone if x == MARK else ids for x, ids in zip(segments, out, strict=True)]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Each text's ids as little-endian int32, and whether SentencePiece gives the same."""
        cut = [self.segments(x) for x in texts]
        self.learn(set(chain.from_iterable(cut)))
        ids = [b"".join(map(self.ids.__getitem__, x)) for x in cut]
        if not self.plain:
            return ids, [np.frombuffer(a, "<i4").tolist() == b for a, b in zip(ids, self.own.encode(texts, num_threads=self.threads), strict=True)]
        same = [not self.odd or self.odd.isdisjoint(x) for x in cut]
        for k, x in enumerate(cut):
            if MARK in x:
                same[k] = np.frombuffer(ids[k], "<i4").tolist() == self.own.encode(texts[k])
        return ids, same

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<i4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


_CODECS: dict[bytes, Codec] = {}


def codec_of(raw: bytes) -> Codec:
    """A worker's codec of a model, kept for its later tasks."""
    key = hashlib.sha256(raw).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(raw)
    return _CODECS[key]


def _pieces_of(batch: pa.RecordBatch, most_chars: int = 4_000_000):
    """(ids, texts) of a batch in parts of bounded size."""
    keys, texts, size = [], [], 0
    for key, text in zip(batch.column(0), batch.column(1), strict=True):
        keys.append(key.as_py())
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= most_chars:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def model_bytes(df: DataFrame, model_path: str, max_model_bytes: int = 64 << 20):
    """A broadcast of the file's bytes; raises if it is larger than a model may be."""
    with open(model_path, "rb") as f:
        raw = f.read(max_model_bytes + 1)
    if len(raw) > max_model_bytes:
        raise ValueError(f"{model_path} has more than {max_model_bytes} bytes")
    return df.sparkSession.sparkContext.broadcast(raw)


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, parity): the token ids of each whole text."""
    raw = model_bytes(df, model_path)

    def run(batches):
        codec = codec_of(raw.value)
        for batch in batches:
            for keys, texts in _pieces_of(batch):
                ids, same = codec.encode(texts)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())), pa.array(same, pa.bool_())], names=["doc_id", "ids", "parity"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, parity boolean")


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the text of each list of ids; null gives the empty text."""
    raw = model_bytes(df, model_path)

    def run(batches):
        codec = codec_of(raw.value)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], "<i4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def encode_digest(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: n_tokens, ids_sha256 (of little-endian int32 ids), roundtrip (decoding gives the text back) and parity."""
    raw = model_bytes(df, model_path)

    def run(batches):
        codec = codec_of(raw.value)
        for batch in batches:
            for keys, texts in _pieces_of(batch):
                ids, same = codec.encode(texts)
                sha = [hashlib.sha256(x).hexdigest() for x in ids]
                back = [codec.decode(x) == t for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sha), pa.array(back, pa.bool_()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids_sha256", "roundtrip", "parity"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, roundtrip boolean, parity boolean")
