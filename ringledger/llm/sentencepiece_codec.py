"""SentencePiece encoding with byte offsets into the original text, and decoding.

The text is normalised here: at every place the longest key of the model's compiled character map (a double-array
trie) is replaced by its value, everything else is copied, spaces become the piece separator, and every
normalised byte keeps the source byte it came from. The merges of the model (with its normaliser switched
off) then cut the normalised text, and each piece is projected back to source bytes.

Scale: documents stream through ``mapInPandas`` in small batches; nothing is shuffled, collected or broadcast. The
model is read in each Python worker from ``model_path`` (a path on every executor), or from bytes given with the closure.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = "▁"


def fields(data: bytes):
    """(number, value) of a protobuf message; value is int or bytes."""
    at, end = 0, len(data)

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


def message(number: int, body: bytes) -> bytes:
    head, size = bytes([number << 3 | 2]), len(body)
    while size > 127:
        head += bytes([size & 127 | 128])
        size >>= 7
    return head + bytes([size]) + body


#: A later normaliser message is merged into the model's own: no map, no dummy prefix, no white space handling.
NO_NORMALISER = message(3, message(1, b"identity") + message(2, b"") + bytes([3 << 3, 0, 4 << 3, 0, 5 << 3, 0]))


class CharacterMap:
    """Keys and values of a compiled map: a double-array trie over UTF-8 bytes, then null-ended values."""

    def __init__(self, blob: bytes) -> None:
        self.units, self.values = np.zeros(0, np.uint32), b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units, self.values = np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size :]
        self._units = self.units.tolist()

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and value of the longest key at ``at``."""
        units, found = self._units, None
        if not units:
            return None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.values[value : self.values.index(b"\0", value)])
        return found

    def first_characters(self) -> set[str]:
        """The characters that keys begin with."""
        if not self._units:
            return set()
        starts, todo = set(), [(self._offset(self._units[0]), b"")]
        while todo:
            node, prefix = todo.pop()
            for byte in range(256):
                to = node ^ byte
                if to < len(self._units) and (unit := self._units[to]) & 0x800000FF == byte and (byte or unit):
                    key = prefix + bytes([byte])
                    try:
                        starts.add(key.decode())
                    except UnicodeDecodeError:
                        if len(key) < 4:
                            todo.append((to ^ self._offset(unit), key))
        return starts


class Codec:
    def __init__(self, model: bytes) -> None:
        pieces, normaliser, trainer = [], {}, {}
        for number, value in fields(model):
            if number == 1:
                pieces.append(dict(fields(value)))
            elif number == 3:
                normaliser |= dict(fields(value))
            elif number == 2:
                trainer |= dict(fields(value))
        self.map = CharacterMap(normaliser.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(normaliser.get(n, 1)) for n in (3, 4, 5))
        self.suffix = bool(trainer.get(24, 0))
        self.symbols = sorted((p[1] for p in pieces if p.get(3, 1) == 4), key=len, reverse=True)
        self.sizes = np.array([1 if p.get(3, 1) == 6 else len(p[1]) for p in pieces], np.int64)
        self.unknown = [k for k, p in enumerate(pieces) if p.get(3, 1) == 2]
        starts = self.map.first_characters() | {s.decode()[0] for s in self.symbols} | ({" "} if self.squeeze else set())
        self.trigger = re.compile("[" + re.escape("".join(sorted(starts))) + "]") if starts else None
        self.cut = sentencepiece.SentencePieceProcessor(model_proto=model + NO_NORMALISER)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)

    def _step(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Source bytes taken at ``at`` and what they become."""
        for symbol in self.symbols:
            if data.startswith(symbol, at):
                return len(symbol), symbol
        if found := self.map.longest(data, at):
            return found
        first = data[at]
        size = 1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4
        return size, data[at : at + size]

    def _runs(self, text: str):
        """(source start, source length, bytes, changed) in order; unchanged runs are long."""
        if self.trigger is None:
            data = text.encode()
            yield 0, len(data), data, False
            return
        data, at, byte_at, char_at = text.encode(), 0, 0, 0
        for m in self.trigger.finditer(text):
            byte_at += len(text[char_at : m.start()].encode())
            char_at = m.start()
            if byte_at < at:  # inside what a longer key has taken
                continue
            if byte_at > at:
                yield at, byte_at - at, data[at:byte_at], False
            size, value = self._step(data, byte_at)
            yield byte_at, size, value, True
            at = byte_at + size
        if at < len(data):
            yield at, len(data) - at, data[at:], False

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the source byte of each of its bytes (and of its end)."""
        if not text:
            return "", np.zeros(1, np.int64)
        out, sources, before = [], [], self.squeeze
        started, total = False, 0
        mark = SPACE.encode() if self.escape else b" "
        for start, size, value, changed in self._runs(text):
            if before:
                value = value.lstrip(b" ") if value.startswith(b" ") else value
            total = start + size
            if not value:
                if not started and out == []:
                    pass
                continue
            if not started:
                started = True
                if self.dummy and not self.suffix:
                    out.append(mark)
                    sources.append(np.full(len(mark), start, np.int64))
            bytes_ = np.frombuffer(value, np.uint8)
            places = np.full(len(value), start, np.int64) if changed else np.arange(start, start + size)[-len(value) :]
            if self.escape and b" " in value:
                places = np.repeat(places, np.where(bytes_ == 32, 3, 1))
                out.append(value.replace(b" ", mark))
            else:
                out.append(value)
            if not changed:  # a character's bytes all stand for its first byte
                spread = np.frombuffer(out[-1], np.uint8)
                inner = (spread & 0xC0) == 0x80
                places = places[np.maximum.accumulate(np.where(inner, 0, np.arange(len(spread))))]
            sources.append(places)
            before = self.squeeze and value.endswith(b" ")
        if self.squeeze:
            while out and out[-1].endswith(mark):
                keep = len(out[-1]) - len(mark)
                total = int(sources[-1][keep])
                out[-1], sources[-1] = out[-1][:keep], sources[-1][:keep]
                if not keep:
                    out.pop()
                    sources.pop()
            if not out:
                return "", np.array([total])
        if self.dummy and self.suffix and out:
            out.append(mark)
            sources.append(np.full(len(mark), total, np.int64))
        return b"".join(out).decode("utf-8", "replace"), np.concatenate([*sources, [total]])

    def encode(self, texts: list[str | None], spans: bool = True) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
        """Ids, and for each id the source bytes [start, end) that it stands for."""
        normal = [self.normalise(t or "") for t in texts]
        out = []
        for ids, (text, source) in zip(self.cut.encode([n for n, _ in normal], num_threads=1), normal, strict=True):
            if not spans:
                out.append((ids, None, None))
                continue
            sizes = self.sizes[ids] if ids else np.zeros(0, np.int64)
            if any(u in ids for u in self.unknown):
                sizes = np.array([1 if self.sizes[i] == 1 and p.startswith("<0x") else len(p.encode()) for i, p in zip(ids, self.cut.encode(text, out_type=str), strict=True)])
            ends = np.cumsum(sizes)
            out.append((ids, source[ends - sizes].astype(np.int32), source[ends].astype(np.int32)))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode(ids) if ids else []


_codecs: dict[str, Codec] = {}


def codec(model_path: str) -> Codec:
    if model_path not in _codecs:
        with open(model_path, "rb") as f:
            _codecs[model_path] = Codec(f.read())
    return _codecs[model_path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``id_col, ids, starts, ends`` (source bytes of each id) and, with ``decode``, ``decoded``.

    Null texts are encoded as empty ones: no ids, empty ``decoded``. Whole texts are encoded, whatever their length; repeated rows
    are returned as often as they came, an empty table gives an empty one, and other columns are not read.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>, starts array<int>, ends array<int>" + ", decoded string" * decode

    def run(batches):
        c = codec(model_path)
        for batch in batches:
            found = c.encode([t if isinstance(t, str) else "" for t in batch["text"]])
            out = {id_col: batch[id_col], "ids": [np.array(f[0], np.int32) for f in found], "starts": [f[1] for f in found], "ends": [f[2] for f in found]}
            yield pd.DataFrame(out | ({"decoded": c.decode([f[0] for f in found])} if decode else {}))

    return common.small_batches(docs.select(id_col, F.col(text_col).alias("text"))).mapInPandas(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.coalesce(F.array_max("ends"), F.lit(0)).cast("long").alias("n_bytes"))


QUERIES = {"op4_sentencepiece": op4_sentencepiece}
ORACLES: dict[str, str] = {}
