"""SentencePiece encoding and decoding (operator 1).

An Aho-Corasick automaton over the vocabulary's pieces reads the text once. At each
position its output links name the pieces that end there, and each relaxes the best
score of that position from the best score of its start (Viterbi). A character that no
piece covers costs the least piece score less 10, and is written as byte pieces.

A space becomes U+2581 and one stands before the text. If no piece holds U+2581 after
another character, the best segmentation is that of the parts that begin at U+2581, so
each distinct part is segmented once (see `chunks`).

Defined results: null and empty texts have no ids and decode to the empty text; a text
that holds U+2581 itself decodes with a space in its place, and round_trip says so; ties
keep the piece that starts first (the longest); a null id comes back null; repeated rows are
all kept; further columns pass through untouched. A very long text costs its task about a
hundred bytes a character of its longest part without a space; nothing is cut.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkCache
from .textkit import KEPT, extended, released, tune

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_PART = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[i : i + n]
            i += n


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id."""
    out = []
    with open(path, "rb") as f:
        for number, body in _fields(f.read()):
            if number == 1:
                p = dict(_fields(body))
                out.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
    return out


class Pieces:
    def __init__(self, model: list[tuple[str, float, int]]):
        import ahocorasick

        self.pieces = [p for p, _, _ in model]
        usable = [(i, p, s) for i, (p, s, k) in enumerate(model) if k in (NORMAL, USER) and p]
        scores = [s for _, _, s in usable] or [0.0]
        self.unknown_score = min(scores) - 10.0
        self.automaton = ahocorasick.Automaton()
        for i, p, s in usable:
            self.automaton.add_word(p, (len(p), s if model[i][2] == NORMAL else len(p) * max(scores) - 0.1, i))
        self.automaton.make_automaton()
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(model) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next((i for i, m in enumerate(model) if m[2] == UNKNOWN), 0)
        self.silent = {i for i, m in enumerate(model) if m[2] in (CONTROL, UNKNOWN)}
        self.parts = all(SPACE not in p.lstrip(SPACE) for _, p, _ in usable)
        self.cache = ChunkCache(lambda chunks: [self.viterbi(c) for c in chunks], 200_000)

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation of `text`, in which spaces are already U+2581."""
        n = len(text)
        low = float("-inf")
        best, back, piece = [0.0] + [low] * n, [0] * (n + 1), [-1] * (n + 1)
        seen = 0  # positions up to here are final
        for end, (size, score, i) in self.automaton.iter(text):
            end += 1
            while seen < end - 1:  # positions passed by without a piece that ends there
                seen += 1
                if piece[seen] < 0 or best[seen] < best[seen - 1] + self.unknown_score:
                    if best[seen - 1] + self.unknown_score > best[seen]:
                        best[seen], back[seen], piece[seen] = best[seen - 1] + self.unknown_score, seen - 1, -1
            value = best[end - size] + score
            if value > best[end]:
                best[end], back[end], piece[end] = value, end - size, i
        while seen < n:
            seen += 1
            if best[seen - 1] + self.unknown_score > best[seen]:
                best[seen], back[seen], piece[seen] = best[seen - 1] + self.unknown_score, seen - 1, -1
        out: list[int] = []
        while n:
            if piece[n] >= 0:
                out.append(piece[n])
            else:
                out += [self.bytes.get(b, self.unknown) for b in reversed(text[back[n] : n].encode())]
            n = back[n]
        return out[::-1]

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.parts:
            return [SPACE + text.replace(" ", SPACE)]
        parts = text.split(" ")
        if "" not in parts:
            return [SPACE + p for p in parts] if SPACE not in text else _PART.split(SPACE + text.replace(" ", SPACE))
        return _PART.split(SPACE + text.replace(" ", SPACE))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the pointer of each text's."""
        chunks: list[str] = []
        ends = [0]
        for t in texts:
            chunks += self.chunks(t)
            ends.append(len(chunks))
        ids, count = self.cache.ids(chunks)
        return ids, np.concatenate([[0], np.cumsum(count)])[ends]

    @functools.cached_property
    def _surface(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes that each id stands for: flat, start, count."""
        each = [b"" if i in self.silent else bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        n = np.array([len(x) for x in each], np.int64)
        return np.frombuffer(b"".join(each), np.uint8), np.cumsum(n) - n, n

    def decode(self, ids: np.ndarray, ptr: np.ndarray) -> list[bytes]:
        """The texts' bytes; the space before the text goes."""
        from .textkit import ragged

        flat, start, count = self._surface
        n = count[ids]
        body = flat[ragged(start[ids], n)].tobytes()
        at = np.concatenate([[0], np.cumsum(n)])[ptr].tolist()
        return [body[a + (b > a) : b] for a, b in pairwise(at)]


@functools.lru_cache(2)
def load(path: str) -> Pieces:
    return Pieces(read_model(path))


KEPT[__name__] = load.cache_clear


def encode_pieces(docs: DataFrame, model_path: str, *, text_col: str = "text", ids_col: str = "piece_ids", check: bool = True, keep_model: bool = True) -> DataFrame:
    """`docs` and, for each text, its piece ids, and whether they decode to the text again.

    Map-only: no shuffle, memory bounded by an Arrow batch and the chunk cache. Without `keep_model` a task frees the model
    and its cache at its end: where Python workers outnumber tasks, waiting ones would each hold a copy.
    """
    tune(docs.sparkSession)
    names = [c for c in docs.columns]
    if ids_col in names or "round_trip" in names:
        docs = docs.drop(ids_col, "round_trip")
        names = [c for c in names if c not in (ids_col, "round_trip")]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_path)
        for b in batches:
            for a in range(0, max(b.num_rows, 1), 128):
                part = b.slice(a, 128)
                texts = [x or "" for x in part.column(at).to_pylist()]
                ids, ptr = pieces.encode(texts)
                good = [d == t.encode() for d, t in zip(pieces.decode(ids, ptr), texts, strict=True)] if check else [None] * len(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(ids, pa.int32())), pa.array(good, pa.bool_())], [*names, ids_col, "round_trip"])
        if not keep_model:
            load.cache_clear()

    schema = extended(docs.select(*names).schema, f"{ids_col} array<int>, round_trip boolean")
    return docs.select(*names).mapInArrow(released(run), schema)


def piece_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_pieces, n_bytes_pieces, ids_crc32, round_trip): one row a document, digested where it is encoded."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_path)
        is_byte = np.zeros(len(pieces.pieces), bool)
        is_byte[list(pieces.byte_of)] = True
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            for a in range(0, len(texts), 128):
                part = texts[a : a + 128]
                ids, ptr = pieces.encode(part)
                good = [d == t.encode() for d, t in zip(pieces.decode(ids, ptr), part, strict=True)]
                little = ids.astype("<u4")
                fallback = np.concatenate([[0], np.cumsum(is_byte[ids])])[ptr]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, 128), pa.array(np.diff(ptr)), pa.array(np.diff(fallback)), pa.array([zlib.crc32(little[s:e]) for s, e in pairwise(ptr.tolist())], pa.int64()), pa.array(good, pa.bool_())],
                    ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean")
