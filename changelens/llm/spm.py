"""SentencePiece encoding and decoding with the tokenizers library.

The model file's protobuf is read here, and normaliser, white-space marker, pieces with
their scores (unigram) or merges (BPE), and byte fallback are rebuilt as a fast
tokenizer.  It encodes whole batches in several threads.  ``verify`` compares it with
the original library, text by text.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

MARK = "▁"
#: A run of markers with what follows up to the next one.
STRETCH = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Where the model file lies unless the environment names another one.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class Proto:
    """The parts of a SentencePiece model that matter here."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = 1  # 1 unigram, 2 bpe
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield key >> 3, raw[at : at + size]
        at += size


def parse(raw: bytes) -> Proto:
    """Read a serialized model: pieces (field 1), trainer (2) and normaliser (3)."""
    out = Proto()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            out.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    out.kind = v
                elif n == 35:
                    out.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    out.charsmap = v
                elif n in (3, 4, 5):
                    setattr(out, {3: "add_prefix", 4: "squeeze", 5: "escape"}[n], bool(v))
    return out


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """All ways to make a piece of two others, the piece of best score first."""
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER, UNUSED)}
    found = []
    for piece, score, kind in pieces:
        if kind == NORMAL:
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in ids and right in ids:
                    found.append((-score, ids[left], ids[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def build(proto: Proto) -> Tokenizer:
    """The fast tokenizer. Texts are cut before each run of markers; this is exact if no
    piece has a marker after another character, and left out otherwise."""
    vocab = [(p, s) for p, s, _ in proto.pieces]
    unknown = next((i for i, (_, _, kind) in enumerate(proto.pieces) if kind == UNKNOWN), None)
    if proto.kind == 2:
        model = models.BPE({p: i for i, (p, _) in enumerate(vocab)}, _merges(proto.pieces), unk_token=None if unknown is None else vocab[unknown][0], fuse_unk=True, byte_fallback=proto.byte_fallback, cache_capacity=50_000)
    elif proto.kind == 1:
        model = models.Unigram(vocab, unknown, proto.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are supported")
    out = Tokenizer(model)
    steps: list = [normalizers.Precompiled(proto.charsmap)] if proto.charsmap else []
    if proto.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if proto.add_prefix:
        steps.append(normalizers.Prepend(" "))
    if proto.escape:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p, _, kind in proto.pieces if kind == NORMAL):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(STRETCH.pattern), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if proto.add_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return out


class Codec:
    """Encodes and decodes lists of texts. threads: of one task's batches."""

    def __init__(self, raw: bytes, threads: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        proto = parse(raw)
        self.tokenizer = build(proto)
        self.by_word = self.tokenizer.pre_tokenizer is not None and proto.escape and not (proto.charsmap or proto.squeeze)
        self.add_prefix, self.text_of = proto.add_prefix, [_plain(p, kind) for p, _, kind in proto.pieces]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each whole text; an empty text has none."""
        found = self.tokenizer.encode_batch_fast([t for t in texts if t], add_special_tokens=False)
        ids = iter(found)
        return [next(ids).ids if t else [] for t in texts]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """The texts of lists of ids. Pieces that stand for themselves are only put
        together; lists with others, like parts of a character, go to the library."""
        out: list = []
        for own in ids:
            try:
                text = "".join(map(self.text_of.__getitem__, own))
                out.append(text[1:] if self.add_prefix and text[:1] == " " else text)
            except TypeError:
                out.append(None)
        rest = [k for k, t in enumerate(out) if t is None]
        for k, text in zip(rest, self.tokenizer.decode_batch([ids[k] for k in rest], skip_special_tokens=True), strict=True):
            out[k] = text
        return out


def _plain(piece: str, kind: int) -> str | None:
    """What a piece stands for whatever is beside it: its text, an ASCII byte's character."""
    if kind == BYTE:
        byte = int(piece[3:5], 16)
        return chr(byte) if byte < 128 else None
    return piece.replace(MARK, " ") if kind in (NORMAL, USER) else None


def model_file() -> bytes:
    """The serialized model that SENTENCEPIECE_MODEL names, read on the driver."""
    return Path(os.environ.get("SENTENCEPIECE_MODEL", MODEL)).read_bytes()


@lru_cache(maxsize=1)
def _codec(raw: bytes, threads: int) -> Codec:
    """One for all tasks of a worker process."""
    return Codec(raw, threads)


def verify(raw: bytes, texts: list[str]) -> list[str]:
    """The texts whose ids differ from the original library's."""
    import sentencepiece

    own = Codec(raw).encode(texts)
    other = sentencepiece.SentencePieceProcessor(model_proto=raw).encode(texts)
    return [t for t, a, b in zip(texts, own, other, strict=True) if a != b]


def _encoded(codec: Codec, values: list) -> list:
    """Ids of each text, of null for null; some texts at a time, to bound memory."""
    out: list = []
    for s in range(0, len(values), 64):
        part = values[s : s + 64]
        out += [None if t is None else i for t, i in zip(part, codec.encode([t or "" for t in part]), strict=True)]
    return out


def encode(raw: bytes, text: Column, threads: int = 2) -> Column:
    """Ids of each whole text as an array; null texts give null, empty ones no ids."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(raw, threads)
        for batch in batches:
            yield pd.Series(_encoded(codec, batch.tolist()), dtype=object)

    return F.pandas_udf(run, "array<int>")(text)


class _Counts(dict):
    """How many ids a normalised word has; at most 200,000 words are remembered."""

    def __init__(self, codec: Codec):
        self.codec, self.model = codec, codec.tokenizer.model

    def __missing__(self, word: str) -> int:
        n = len(self.model.tokenize(word))
        if len(word) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=1)
def _counts(raw: bytes) -> _Counts:
    """One for all tasks of a worker process."""
    return _Counts(_codec(raw, 1))


def counted(raw: bytes, texts: list[str | None]) -> list[int]:
    """How many ids each whole text has; null and empty texts have none.

    Where the encoder cuts texts before each run of markers and its normaliser only puts
    markers, a text has as many ids as its stretches, so that those that repeat are
    encoded once. Else the whole texts are encoded.
    """
    counts = _counts(raw)
    if not counts.codec.by_word:
        return [len(x or []) for x in _encoded(counts.codec, texts)]
    start = MARK if counts.codec.add_prefix else ""
    return [sum(map(counts.__getitem__, STRETCH.findall(start + t.replace(" ", MARK)))) if t else 0 for t in texts]


def count(raw: bytes, text: Column) -> Column:
    """How many ids each whole text has (``counted``): none for null and empty ones. Each
    row is counted alone, so equal texts have equal counts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(counted(raw, batch.tolist()), dtype="int64")

    return F.pandas_udf(run, "long")(text)


def decode(raw: bytes, ids: Column, threads: int = 2) -> Column:
    """The text of each array of ids; null arrays give null, empty ones an empty text. Each
    row is decoded alone. Ids within an array aren't null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(raw, threads)
        for batch in batches:
            texts = codec.decode([[] if x is None else [int(i) for i in x] for x in batch])
            yield pd.Series([None if x is None else t for x, t in zip(batch, texts, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(ids)


def round_trip(df: DataFrame, raw: bytes, *, doc_id: str = "doc_id", text: str = "text", threads: int = 2) -> DataFrame:
    """(doc_id, ids, restored) for each row: the ids of its whole text, and whether
    decoding them gives the text again. Both are null for null texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw, threads)
        for batch in batches:
            for s in range(0, batch.num_rows, 64):  # small batches go back, to bound memory
                part = batch.slice(s, 64)
                texts = part.column(1).to_pylist()
                own = _encoded(codec, texts)
                back = codec.decode([x or [] for x in own])
                same = [None if t is None else t == b for t, b in zip(texts, back, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.list_(pa.int32())), pa.array(same, pa.bool_())], ["doc_id", "ids", "restored"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, restored boolean")
