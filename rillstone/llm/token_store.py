"""Token ids in wavelet-matrix shards (operator 7).

Each shard is one file: a header, the documents' ids and offsets, and the tokens as a
wavelet matrix, one bit-plane for each bit of the largest id, most significant first.
At each plane the tokens stand stably parted by the bits above it, so `rank` on the
planes leads from any position to the same token in the next plane. A file answers
`access`, `rank`, `select`, `count` and `occurrences` without unpacking the tokens.

Files are written by Spark's own committer (a lost executor's half-written files are
never seen) to any store Spark can write, and read back as binary files.

Defined results: null texts are empty texts; an empty text has only the end id; a null
doc_id sorts first and comes back null; repeated rows are all kept; further columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import gc
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import WordCache
from .storage import fresh, keep
from .textkit import raw, tune

MAGIC = b"RWM1"
_HEAD = struct.Struct("<4sIIQIB3x")  # magic, partition, shard, tokens, documents, planes
_STEP = 512  # bits between two entries of a rank directory
NO_ID = -(1 << 63)


class WaveletMatrix:
    """Succinct sequence of unsigned integers; see the module's docstring."""

    def __init__(self, n: int, zeros: np.ndarray, planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def build(cls, values: np.ndarray) -> WaveletMatrix:
        n, depth = len(values), max(1, int(values.max(initial=0)).bit_length())
        cur = values.astype(np.uint16 if depth <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for k in range(depth - 1, -1, -1):
            bit = ((cur >> k) & 1).astype(bool)
            packed = np.packbits(bit)
            planes.append(packed)
            ones = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), _STEP // 8), dtype=np.uint32) if n else np.zeros(0, np.uint32)
            ranks.append(np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32) if n else ones)
            zeros.append(n - int(np.count_nonzero(bit)))
            if k:
                cur = np.concatenate([cur.take(np.flatnonzero(~bit)), cur.take(np.flatnonzero(bit))])
        return cls(n, np.array(zeros, np.uint64), planes, ranks)

    def to_bytes(self) -> bytes:
        return self.zeros.tobytes() + b"".join(x.tobytes() for x in (*self.ranks, *self.planes))

    @classmethod
    def from_bytes(cls, data, at: int, n: int, depth: int) -> WaveletMatrix:
        steps, width = -(-n // _STEP), -(-n // 8)
        zeros = np.frombuffer(data, np.uint64, depth, at)
        at += 8 * depth
        ranks = [np.frombuffer(data, np.uint32, steps, at + 4 * steps * k) for k in range(depth)]
        at += 4 * steps * depth
        return cls(n, zeros, [np.frombuffer(data, np.uint8, width, at + width * k) for k in range(depth)], ranks)

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 3] >> (7 - (i & 7))) & 1

    def _rank1(self, k: int, i: int) -> int:
        """Ones in plane k before position i."""
        if i >= self.n:
            return self.n - int(self.zeros[k])
        block = i // _STEP
        total, a = int(self.ranks[k][block]), block * (_STEP // 8)
        total += int(np.bitwise_count(self.planes[k][a : i >> 3]).sum(dtype=np.int64))
        return total + (int(self.planes[k][i >> 3]) >> (8 - (i & 7))).bit_count()

    def _select(self, k: int, bit: int, j: int) -> int:
        """Position of the j-th (from 0) `bit` in plane k."""
        lo, hi = 0, self.n
        while hi - lo > 1:
            mid = (lo + hi) // 2
            ones = self._rank1(k, mid)
            lo, hi = (mid, hi) if (ones if bit else mid - ones) <= j else (lo, mid)
        return lo

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(len(self.planes)):
            bit, ones = self._bit(k, i), self._rank1(k, i)
            value = value << 1 | bit
            i = int(self.zeros[k]) + ones if bit else i - ones
        return value

    def _range(self, symbol: int, i: int, j: int) -> tuple[int, int]:
        for k in range(len(self.planes)):
            a, b = self._rank1(k, i), self._rank1(k, j)
            z = int(self.zeros[k])
            i, j = (z + a, z + b) if symbol >> (len(self.planes) - 1 - k) & 1 else (i - a, j - b)
        return i, j

    def rank(self, symbol: int, i: int) -> int:
        """How often `symbol` stands before position i."""
        if symbol >> len(self.planes):
            return 0
        a, b = self._range(symbol, 0, min(i, self.n))
        return b - a

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, j: int) -> int:
        """Position of the j-th (from 0) occurrence of `symbol`."""
        if not 0 <= j < self.count(symbol):
            raise IndexError(j)
        i = self._range(symbol, 0, self.n)[0] + j
        for k in range(len(self.planes) - 1, -1, -1):
            bit = symbol >> (len(self.planes) - 1 - k) & 1
            i = self._select(k, bit, i - int(self.zeros[k]) if bit else i)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, j) for j in range(self.count(symbol))]

    def decode(self) -> np.ndarray:
        """All values in order: the partings undone from the last plane to the first."""
        cur = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n).view(bool)
            out = np.empty_like(cur)
            z = int(self.zeros[k])
            out[np.flatnonzero(~bit)] = cur[:z]
            out[np.flatnonzero(bit)] = cur[z:] | cur.dtype.type(1 << (len(self.planes) - 1 - k))
            cur = out
        return cur


class Shard:
    """One file: its documents and their tokens."""

    def __init__(self, data):
        magic, self.partition, self.number, n, docs, depth = _HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.doc_ids = np.frombuffer(data, np.int64, docs, _HEAD.size)
        self.ptr = np.frombuffer(data, np.int64, docs + 1, _HEAD.size + 8 * docs)
        self.matrix = WaveletMatrix.from_bytes(data, _HEAD.size + 16 * docs + 8, n, depth)

    @staticmethod
    def pack(partition: int, number: int, doc_ids: list[int], counts: list[int], tokens: np.ndarray) -> bytes:
        m = WaveletMatrix.build(tokens)
        ptr = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))]).astype(np.int64)
        return _HEAD.pack(MAGIC, partition, number, m.n, len(doc_ids), len(m.planes)) + np.array(doc_ids, np.int64).tobytes() + ptr.tobytes() + m.to_bytes()


#: A space after white space and before more of it, or before the end: there a chunk could begin inside one pre-token.
_ODD = re.compile(rb"[\t-\r\x1c-\x20](?: [\t-\r\x1c-\x20]| \Z)")
_ODD_TEXT = re.compile(r"\s \s|\s \Z")
#: Bytes that begin a character of white space beyond ASCII.
_WIDE = re.compile(rb"[\xC2\xE1-\xE3]")
#: Characters whose classes are the same in every version of Unicode, so that pre-tokens can be cut here.
_SETTLED = re.compile(r"[\t\n\r -~\u00A1-\u024F]*")
_L, _N = r"A-Za-z\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F", r"0-9\u00B2\u00B3\u00B9\u00BC-\u00BE"
#: The public byte-level pattern of pre-tokens for such characters, with chunks parted by NUL.
_PRE_TOKEN = re.compile(rf"\0|'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s\0{_L}{_N}]+|\s+(?![^\s\0])|\s+")


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b != 173]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(own)))}


def _known_form(path: str) -> bool:
    """Whether the file is byte-level BPE as :func:`byte_bpe` cuts it: no normalizer, the public pattern, no space added."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    model, cut = d["model"], d.get("pre_tokenizer") or {}
    plain = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    return plain and model.get("type") == "BPE" and not d.get("normalizer") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not d.get("truncation")


@functools.lru_cache(2)
def byte_bpe(path: str, limit: int = 200_000) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Encoder of a column of texts by the tokenizers library: all ids, and how many each text has.

    A chunk is a word and what follows it up to the next space. New chunks are cut into
    pre-tokens here and each distinct one (of the last `limit`) is merged by the library's model;
    chunks with other characters, and texts with added tokens, are encoded by the library
    whole, as is every text if the file is of another form than that.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if not _known_form(path):

        def plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            found = [e.ids for e in tokenizer.encode_batch_fast([x or "" for x in column.to_pylist()], add_special_tokens=False)]
            return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64)

        return plain
    added = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
    letters, merge = _byte_letters(), tokenizer.model.tokenize
    known: dict[str, tuple[int, ...]] = {}

    def merged(pre_token: str) -> tuple[int, ...]:
        if len(known) >= limit:
            known.clear()
        form = pre_token if pre_token.isascii() else pre_token.encode().decode("latin-1")
        known[pre_token] = ids = tuple([x.id for x in merge(form.translate(letters))])
        return ids

    def encode_chunks(chunks: list[str]) -> list[list[int]]:
        whole = [not _SETTLED.fullmatch(c) or any(x in c for x in added) for c in chunks]
        out: list[list[int]] = []
        ids: list[int] = []
        for x in _PRE_TOKEN.findall("\0".join([*("" if w else c for c, w in zip(chunks, whole, strict=True)), ""])):
            if x == "\0":
                out.append(ids)
                ids = []
            else:
                ids += known.get(x) or merged(x)
        rest = [i for i, w in enumerate(whole) if w]
        for i, e in zip(rest, tokenizer.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    cache = WordCache(encode_chunks)
    marks = [x.encode() for x in added]

    def odd(text: bytes) -> bool:
        return any(x in text for x in marks) or bool(_ODD.search(text)) or bool(_WIDE.search(text) and _ODD_TEXT.search(text.decode()))

    def encode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, off = raw(column)
        body = data.tobytes()
        whole = np.array([odd(body[a:b]) for a, b in pairwise(off.tolist())], bool)
        return cache.ids(data, off, whole)

    return encode


def write_files(df: DataFrame, content: str, path: str) -> None:
    """One file of raw bytes a row (and a final newline, which the formats here allow for)."""
    df.select(F.col(content).cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_token_shards(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = 2, shard_tokens: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode `docs` in ascending id order and write the shards under `path`.

    Documents are dealt by ranges of ids; a shard is a run of whole documents of about
    `shard_tokens` tokens. Memory a task: one shard, or one document that is longer.
    """
    tune(docs.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # lists of ids by the hundred thousand, without cycles: walking them is all a collection would do
        try:
            yield from shards(batches)
        finally:
            gc.enable()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer_path)
        part, number = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        counts: list[int] = []
        pieces: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            body = Shard.pack(part, number, ids, counts, np.concatenate(pieces))
            number, held = number + 1, 0
            ids.clear(), counts.clear(), pieces.clear()
            return pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], ["content"])

        for b in batches:
            keys = [NO_ID if x is None else x for x in b.column(0).to_pylist()]
            for a in range(0, b.num_rows, 64):
                flat, n = encode(b.column(1).slice(a, 64))
                ends = np.cumsum(n)
                flat = np.insert(flat, ends, end_id)
                ptr = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
                for k in range(len(n)):
                    ids.append(keys[a + k])
                    counts.append(int(n[k]) + 1)
                    pieces.append(flat[ptr[k] : ptr[k + 1]])
                    held += int(n[k]) + 1
                    if held >= shard_tokens:
                        yield flush()
        if ids:
            yield flush()

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    write_files(ordered.mapInArrow(build, "content binary"), "content", path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the shards under `path`."""
    tune(spark)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body in b.column(0):
                s = Shard(body.as_buffer())
                values, ptr = s.matrix.decode().astype("<u4"), s.ptr
                crc = [zlib.crc32(values[a:e]) for a, e in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]
                n = len(s.doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, s.partition, np.int32)), pa.array(np.full(n, s.number, np.int32)), pa.array(s.doc_ids, mask=s.doc_ids == NO_ID), pa.array(ptr[:-1]), pa.array(np.diff(ptr)), pa.array(crc, pa.int64())],
                    ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    found = keep(read_files(spark, path).select("content").mapInArrow(digest, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long"), "token-digest")
    # One number a partition comes to the driver; shards add up within their partition.
    shards = found.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    totals = shards.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    bases = spark.createDataFrame(list(zip([r["part"] for r in totals], accumulate([0] + [r["n"] for r in totals]))), "part int, first long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = shards.withColumn("before", before).join(F.broadcast(bases), "part").select("part", "shard", (F.col("first") + F.col("before")).alias("base"))
    return found.join(starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_store(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write the shards to the shared folder, read them back and return the digest."""
    path = fresh(docs.sparkSession, "tokens")
    write_token_shards(docs, path, tokenizer_path, **options)
    return read_token_shards(docs.sparkSession, path)
