"""SentencePiece encoding and decoding that keeps the byte span of every piece in the source text.

The normaliser is written out here: the longest prefix found in the model's compiled character map is replaced, and
every byte of the normalised text records the source byte it came from. A piece covers a run of normalised bytes, so
its span in the source is read off that record. The merges themselves come from the installed library.

Defined results: a null text is an empty one (begin and end ids alone); texts of any length are encoded whole; equal
texts give equal results; rows are never merged or dropped, and other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import give_back, utf8
from .common import pieces as cut

MARK = "▁"
MOST_BYTES = 2_000_000  # of text at a time, as ids, spans and decoded text take several times that
CACHE_WORDS = 200_000
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a serialised protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class CharMap:
    """Longest-prefix search in a compiled character map: a double-array trie, then the replacement strings."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and byte length of the longest key that starts at ``at``; None if there is none."""
        units = self.units
        if not units:
            return None
        node, found, length = (units[0] >> 10) << ((units[0] & 512) >> 6), None, 0
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units) or units[node] & 0x800000FF != text[i]:
                break
            unit = units[node]
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found, length = units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        return self.strings[found : self.strings.index(b"\0", found)], length


class PieceModel:
    """A model file: pieces, normaliser and the library's processor."""

    def __init__(self, path: str):
        data = open(path, "rb").read()
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.names, self.types, spec = [], [], {}
        for field, value in wire(data):
            if field == 1:
                piece = dict(wire(value))
                self.names.append(piece[1])
                self.types.append(piece.get(3, NORMAL))
            elif field == 3:
                spec = dict(wire(value))
        self.map = CharMap(spec.get(2, b""))
        self.dummy_prefix, self.trim, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.symbols = sorted((n for n, t in zip(self.names, self.types) if t == USER_DEFINED), key=len, reverse=True)
        self.lengths = np.array([1 if t == BYTE else len(n) for n, t in zip(self.names, self.types)], dtype=np.int64)
        self.begin, self.end = (np.array([x], "<u4").tobytes() for x in (self.processor.bos_id(), self.processor.eos_id()))
        crossing = any(re.search(f"[^{MARK}]{MARK}", n.decode(errors="replace")) for n, t in zip(self.names, self.types) if t == NORMAL)
        # words can be encoded one by one when no piece reaches across a word's start and nothing is rewritten
        self.by_word = not (self.map.units or self.trim or crossing or self.symbols) and self.dummy_prefix and self.escape and BYTE in self.types
        self.mark = np.array([self.processor.piece_to_id(MARK)], "<u4").tobytes()
        self.words: dict[str, bytes] = {}

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and the end) the source byte it starts at."""
        if not text:
            return b"", np.zeros(1, np.int64)
        mark = MARK.encode() if self.escape else b" "
        out, source, at = bytearray(), [], 0
        steps = []
        while at < len(text):
            symbol = next((s for s in self.symbols if text.startswith(s, at)), None)
            found = (symbol, len(symbol)) if symbol else self.map.longest(text, at)
            if not found:
                size = 1 if text[at] < 0xC0 else 2 if text[at] < 0xE0 else 3 if text[at] < 0xF0 else 4
                found = text[at : at + size], size
            steps.append((found[0], at, found[1]))
            at += found[1]
        at, first = 0, 0
        if self.trim:
            while first < len(steps) and steps[first][0] == b" ":
                at, first = at + steps[first][2], first + 1
            if first == len(steps):
                return b"", np.zeros(1, np.int64)
        if self.dummy_prefix:
            out += mark
            source += [at] * len(mark)
        after_space = self.trim
        for piece, start, size in steps[first:]:
            while after_space and piece.startswith(b" "):
                piece = piece[1:]
            for byte in piece:
                unit = mark if byte == 32 else bytes([byte])
                out += unit
                source += [start] * len(unit)
            at = start + size
            if piece or not self.trim:
                after_space = self.trim and piece.endswith(b" ")
        if self.trim:
            while out.endswith(mark):
                del out[-len(mark) :]
                at = source[len(out)]
                del source[len(out) :]
        return bytes(out), np.array([*source, at], np.int64)

    def alignment(self, text: bytes) -> np.ndarray:
        """The record of ``normalise`` alone; computed in bulk where the character map is empty."""
        if not self.by_word or not text:
            return self.normalise(text)[1]
        data = np.frombuffer(text, np.uint8)
        widths = np.where(data == 32, 3, 1)
        return np.concatenate([np.zeros(3, np.int64), np.repeat(np.arange(len(data)), widths), [len(data)]])

    def _fill(self, words: list[str]) -> None:
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        fresh = [w for w in dict.fromkeys(words) if w not in self.words]
        filled = [w for w in fresh if w]
        for word, ids in zip(filled, self.processor.encode(filled, num_threads=1)):
            self.words[word] = np.array(ids, "<u4").tobytes()
        self.words[""] = self.mark

    def encode(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Ids as little-endian unsigned 32-bit integers with begin and end, and each inner piece's (begin, end) bytes."""
        string = text.decode("utf-8", "replace")
        if self.by_word:
            if not string:
                ids = b""
            elif MARK in string or "  " in string or string[0] == " " or string[-1] == " ":
                words = [x[1:].replace(MARK, " ") for x in re.findall(f"{MARK}+[^{MARK}]*", MARK + string.replace(" ", MARK))]
                ids = self._joined(words)
            else:
                ids = self._joined(string.split(" "))
            lengths = self.lengths[np.frombuffer(ids, "<u4")]
        else:
            names = self.processor.encode(string, out_type=str)
            ids = np.array(self.processor.encode(string), "<u4").tobytes()
            kinds = np.frombuffer(ids, "<u4").tolist()
            lengths = np.array([1 if self.types[k] == BYTE else len(n.encode()) for n, k in zip(names, kinds)], np.int64)
        source = self.alignment(text)
        ends = np.cumsum(lengths)
        spans = np.stack([source[ends - lengths], source[ends]], axis=1) if len(ends) else np.zeros((0, 2), np.int64)
        return self.begin + ids + self.end, spans

    def _joined(self, words: list[str]) -> bytes:
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            self._fill(words)
            return b"".join(map(self.words.__getitem__, words))

    def decode(self, ids: bytes) -> str:
        return self.processor.decode(np.frombuffer(ids, "<u4").tolist())


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", decoded: bool = True) -> DataFrame:
    """``id_column``, ``ids`` (packed little-endian u32), ``spans`` (packed little-endian u32 begin, end of each inner
    piece in the UTF-8 source) and, if asked for, ``decoded`` (the library's decoding of the ids)."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        model = piece_model(model_path)
        for batch in cut(batches, MOST_BYTES):
            packed, spans, texts = [], [], []
            for text in utf8(batch.column(1)):
                ids, span = model.encode(text)
                packed.append(ids)
                spans.append(span.astype("<u4").tobytes())
                if decoded:
                    texts.append(model.decode(ids))
            columns = [batch.column(0), pa.array(packed, pa.binary()), pa.array(spans, pa.binary())]
            names = [id_column, "ids", "spans"]
            if decoded:
                columns, names = [*columns, pa.array(texts, pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)
        model.words.clear()  # the worker may wait for long with them
        give_back()

    schema = f"`{id_column}` {kind}, ids binary, spans binary" + ", decoded string" * decoded
    return docs.select(id_column, text_column).mapInArrow(run, schema)
