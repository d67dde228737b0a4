"""Token ids in binary files of patched frame-of-reference blocks.

Documents are dealt in ranges of their key, so that files in order of (part,
number) hold them in ascending order. Each task tokenizes its texts, adds an end
id to each document and packs the ids into frames, each of which Spark's own
text writer commits as one file (a frame and a line feed): a task that runs
again on another executor replaces its files, and no task writes past Spark.

A frame, little-endian:

    8 bytes  ``WMTOKEN1``
    header   part, number, ids per block, documents, ids, blocks (u64 each)
    keys     of documents (i64), then a byte each that is 1 for a null key
    lengths  of documents in ids (u64)
    index    where each block starts, from the first block on (u64), and the end of the last
    blocks   least id (u32), bits (u8), exceptions (u8), the ids less the least
             one at that many bits, then places (u8) and whole differences (u32)
             of the exceptions, the ids that need more bits

The bits of a block are those that a percentile of its differences needs; of
the percentiles in ``_PERCENTILES`` the one with the fewest bytes is chosen. The
index lets a reader take any block alone (:func:`ids_at`).

The tokenizer cuts texts into pieces, drops white space and never looks across
it; so each different piece of a task is encoded once and its ids are put
together. Texts of ASCII and Latin-1 letters are cut up as the tokenizer would,
and its model encodes the pieces; of other texts the words between ASCII white
space go through the whole tokenizer. That the result equals that of whole texts
is tested.

Nulls, empty and very long texts, ties, repeats: a null or empty text has the
end id only; null keys come first; rows of equal key are ordered by a hash of
their text, and equal rows each have their ids; a frame holds whole documents,
so a document longer than ``frame_ids`` makes a longer frame; an empty table
gives no files and an empty table; columns with other names are not read.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wiremill.llm.common import checked, small_batches, table
from wiremill.session import shared_dir, written

MAGIC, BLOCK = b"WMTOKEN1", 128
_HEAD = 6
_PERCENTILES = (0.5, 0.75, 0.9, 0.95, 1.0)
_ROWS = 1 << 11
_CACHED_IDS = 1 << 21


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that non-negative integers below 2^32 need."""
    return np.frexp(x.astype(np.float64))[1]


def pack(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Blocks of ids (u32), and where each starts, with the end of the last."""
    blocks, sizes = [], []
    padded = np.concatenate([ids, np.full(-len(ids) % BLOCK, ids[-1] if len(ids) else 0, np.uint32)]).reshape(-1, BLOCK)
    at = [min(BLOCK, int(np.ceil(p * BLOCK))) - 1 for p in _PERCENTILES]
    for lo in range(0, len(padded), _ROWS):
        rows = padded[lo : lo + _ROWS]
        least = rows.min(axis=1)
        over = rows - least[:, None]
        needs = _bits(over)
        choices = np.sort(needs, axis=1)[:, at]
        cost = np.stack([choices[:, k] * (BLOCK // 8) + 5 * (needs > choices[:, k : k + 1]).sum(axis=1) for k in range(len(at))], axis=1)
        width = choices[np.arange(len(rows)), cost.argmin(axis=1)]
        spread = np.unpackbits(np.ascontiguousarray(over, "<u4").view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2, bitorder="little")
        of, places = np.nonzero(needs > width[:, None])
        exceptions = np.bincount(of, minlength=len(rows))
        after = 6 + width.astype(np.int64) * (BLOCK // 8)  # where a block's exceptions begin
        size = after + 5 * exceptions
        first = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint8)
        for w in np.unique(width):
            mine = np.flatnonzero(width == w)
            parts = [least[mine].astype("<u4").view(np.uint8).reshape(-1, 4), np.full((len(mine), 1), w, np.uint8), exceptions[mine, None].astype(np.uint8)]
            parts.append(np.packbits(spread[mine][:, :, :w].reshape(len(mine), -1), axis=1, bitorder="little"))
            whole = np.concatenate(parts, axis=1)
            out[first[mine, None] + np.arange(whole.shape[1])] = whole
        if len(of):
            nth = np.arange(len(of)) - (np.cumsum(exceptions) - exceptions)[of]
            start = (first + after)[of]
            out[start + nth] = places
            out[(start + exceptions[of] + 4 * nth)[:, None] + np.arange(4)] = over[of, places].astype("<u4").view(np.uint8).reshape(-1, 4)
        blocks.append(out.tobytes())
        sizes.append(size)
    return b"".join(blocks), np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, np.int64), *sizes]))]).astype(np.uint64)


def unpack(body: bytes, starts: np.ndarray, n_ids: int) -> np.ndarray:
    """The first ``n_ids`` ids of blocks that start at ``starts`` in ``body``."""
    raw = np.frombuffer(body, np.uint8)
    starts = starts.astype(np.int64)
    out = np.empty((len(starts), BLOCK), np.uint32)
    least = raw[starts[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    width, exceptions = raw[starts + 4], raw[starts + 5].astype(np.int64)
    for w in np.unique(width):
        for mine in np.array_split(np.flatnonzero(width == w), max(1, int((width == w).sum()) // _ROWS)):
            packed = raw[starts[mine, None] + 6 + np.arange(int(w) * BLOCK // 8)]
            spread = np.zeros((len(mine), BLOCK, 32), np.uint8)
            spread[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(mine), BLOCK, w)
            out[mine] = np.packbits(spread, axis=2, bitorder="little").view("<u4")[:, :, 0]
    of = np.repeat(np.arange(len(starts)), exceptions)
    if len(of):
        nth = np.arange(len(of)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        first = starts + 6 + width.astype(np.int64) * (BLOCK // 8)
        places = raw[first[of] + nth]
        values = (first + exceptions)[of] + 4 * nth
        out[of, places] = raw[values[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    return (out + least[:, None]).reshape(-1)[:n_ids]


def frame(part: int, number: int, keys: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    body, index = pack(ids)
    head = np.array([part, number, BLOCK, len(keys), len(ids), len(index) - 1], "<u8")
    known = np.array([k or 0 for k in keys], "<i8")
    return b"".join([MAGIC, head.tobytes(), known.tobytes(), bytes(k is None for k in keys), lengths.astype("<u8").tobytes(), index.astype("<u8").tobytes(), body])


class Frame:
    """A frame's directory; blocks are unpacked on demand."""

    def __init__(self, data: bytes) -> None:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of token ids")
        at = len(MAGIC)
        self.part, self.number, block, docs, self.n_ids, blocks = map(int, np.frombuffer(data, "<u8", _HEAD, at))
        if block != BLOCK:
            raise ValueError(f"blocks of {block} ids")
        at += 8 * _HEAD
        nulls = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.keys = [None if null else k for k, null in zip(np.frombuffer(data, "<i8", docs, at).tolist(), nulls.tolist(), strict=True)]
        self.lengths = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
        at += 17 * docs
        self.index = np.frombuffer(data, "<u8", blocks + 1, at)
        self._body = memoryview(data)[at + 8 * (blocks + 1) :]

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from ``start`` to before ``end``, from the blocks that hold them."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        if end <= start:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK, -(-end // BLOCK)
        return unpack(self._body, self.index[first:last], end - first * BLOCK)[start - first * BLOCK :]


#: How the tokenizer of ``word_bpe_49k.json`` cuts up lower-case words, for letters and signs that it leaves as they are; and the characters that stand for the bytes of UTF-8 in its model.
_SIMPLE = re.compile("[\\t-\\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\\t-\\r a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_NORMALIZERS, _PRE_TOKENIZERS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]


def _cuts_up_alike(spec: str) -> bool:
    """Whether a tokenizer is of the kind that ``_PIECES`` stands for."""
    parts = json.loads(spec)
    steps = lambda name, key: [x["type"] for x in (parts.get(name) or {}).get(key, [])]
    if steps("normalizer", "normalizers") != _NORMALIZERS or steps("pre_tokenizer", "pretokenizers") != _PRE_TOKENIZERS:
        return False
    pattern = parts["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex", "")
    return pattern == "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" and all("<|" in t["content"] for t in parts["added_tokens"])


class _Known(dict):
    """Numbers of pieces (str) and words (bytes); the ids of each stand in ``ids``, as many as ``sizes`` says."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self._tokenizer, self._model = tokenizer, tokenizer.model
        self.ids, self.sizes = array("I"), array("q")

    def __missing__(self, part: str | bytes) -> int:
        if isinstance(part, bytes):
            found = self._tokenizer.encode(part.decode("utf-8", "replace"), add_special_tokens=False).ids
        else:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_CHARS)
            found = [t.id for t in self._model.tokenize(shown)]
        self.ids.extend(found)
        self.sizes.append(len(found))
        self[part] = n = len(self)
        return n


class WordEncoder:
    """Ids of texts by a tokenizer that drops ASCII white space; each different piece is encoded once while the cache lasts."""

    def __init__(self, spec: str) -> None:
        self._tokenizer = Tokenizer.from_str(spec)
        self._alike = _cuts_up_alike(spec)
        self._known = _Known(self._tokenizer)

    def _parts(self, text: bytes) -> list[str] | list[bytes]:
        if self._alike:
            spelt = text.decode("utf-8", "replace")
            if _SIMPLE.fullmatch(spelt) and "<|" not in spelt:
                return _PIECES.findall(spelt.lower())
        return text.split()

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with ``end`` appended, and how many each has."""
        if len(self._known.ids) > _CACHED_IDS:
            self._known = _Known(self._tokenizer)
        known = self._known
        parts = [self._parts(text) for text in texts]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        n = np.fromiter(map(known.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        sizes, pool = np.array(known.sizes, np.int64), np.array(known.ids, np.uint32)
        size = sizes[n]
        lengths = np.bincount(np.repeat(np.arange(len(texts)), counts), size, minlength=len(texts)).astype(np.int64) + 1
        out = np.full(int(lengths.sum()), end, np.uint32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(lengths) - 1] = False
        places = np.repeat((np.cumsum(sizes) - sizes)[n] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out[inner] = pool[places]
        return out, lengths


def write_tokens(docs: DataFrame, tokenizer_file: str, path: str, end: int = 2, text: str = "text", key: str = "doc_id", frame_ids: int = 1 << 22) -> None:
    """Write the ids of ``docs`` (an integer ``key``) to ``path``, in order of the key over all files; cases as of the module."""
    small_batches(docs)
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_file).read_text(encoding="utf-8"))  # the driver reads it; executors need no copy
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    order = [F.col("k").asc_nulls_first(), F.col("h")]
    dealt = rows.withColumn("h", F.xxhash64("t")).repartitionByRange(*order).sortWithinPartitions(*order).select("k", "t")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(spec.value)
        part, number = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([frame(part, number, keys, np.concatenate(lengths), np.concatenate(ids))], pa.binary())], ["frame"])

        held = 0
        for batch in batches:
            found, sizes = encoder.encode([t.as_py() for t in batch.column("t")], end)
            ends = np.cumsum(sizes)
            done, names = 0, batch.column("k").to_pylist()
            while done < len(names):  # documents up to the one that fills the frame
                before = int(ends[done - 1]) if done else 0
                upto = min(len(names), int(np.searchsorted(ends, before + frame_ids - held)) + 1)
                keys += names[done:upto]
                lengths.append(sizes[done:upto])
                ids.append(found[before : int(ends[upto - 1])])
                held += len(ids[-1])
                done = upto
                if held >= frame_ids:
                    yield out()
                    keys, lengths, ids, held, number = [], [], [], 0, number + 1
        if keys:
            yield out()

    packed = dealt.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    packed.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``part, number, doc_id, first, ids`` of each document in the files: its place among the ids of its file, and its ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in (c.as_buffer() for batch in batches for c in batch.column(0)):
            found = Frame(bytes(data))
            ends = np.cumsum(found.lengths)
            for lo in range(0, len(found.keys), 1000):
                hi = min(lo + 1000, len(found.keys))
                first = int(ends[lo - 1]) if lo else 0
                ids = found.ids(first, int(ends[hi - 1]))
                offsets = np.concatenate([[0], ends[lo:hi] - first]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(hi - lo, found.part, np.int64)),
                        pa.array(np.full(hi - lo, found.number, np.int64)),
                        pa.array(found.keys[lo:hi], pa.int64()),
                        pa.array(first + offsets[:-1].astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int64))),
                    ],
                    ["part", "number", "doc_id", "first", "ids"],
                )

    return files(spark, path).mapInArrow(read, "part bigint, number bigint, doc_id bigint, first bigint, ids array<bigint>")


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """``part, number, doc_id, first, n_tokens, ids_crc32`` of each document in the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in (c.as_buffer() for batch in batches for c in batch.column(0)):
            found = Frame(bytes(data))
            ends = np.cumsum(found.lengths)
            crcs, step = [], 1 << 20
            held, base = found.ids(0, step).astype("<u4"), 0
            for first, last in zip((ends - found.lengths).tolist(), ends.tolist(), strict=True):
                if last > base + len(held):
                    base, held = first, found.ids(first, max(last, first + step)).astype("<u4")
                crcs.append(zlib.crc32(held[first - base : last - base].tobytes()))
            n = len(found.keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, found.part, np.int64)), pa.array(np.full(n, found.number, np.int64)), pa.array(found.keys, pa.int64()), pa.array(ends - found.lengths), pa.array(found.lengths), pa.array(crcs, pa.int64())],
                ["part", "number", "doc_id", "first", "n_tokens", "ids_crc32"],
            )

    return files(spark, path).mapInArrow(read, "part bigint, number bigint, doc_id bigint, first bigint, n_tokens bigint, ids_crc32 bigint")


def with_starts(rows: DataFrame) -> DataFrame:
    """``rows`` of documents (a written table with ``part, number, first, n_tokens``) with ``start``, the ids of all documents before.

    Files are added up per part by Spark; the driver holds a number per part,
    of which there are as many as the shuffle had partitions.
    """
    sizes = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("size"))
    totals = sorted((r["part"], r["size"]) for r in sizes.groupBy("part").agg(F.sum("size").alias("size")).collect())
    before, starts = 0, []
    for part, size in totals:
        starts.append((part, before))
        before += size
    parts = rows.sparkSession.createDataFrame(starts, "part bigint, `at` bigint")
    earlier = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    within = sizes.withColumn("inner", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    offsets = written(within.join(F.broadcast(parts), "part").select("part", "number", (F.col("at") + F.col("inner")).alias("at")), "file-starts")
    return rows.join(checked(offsets), ["part", "number"]).withColumn("start", F.col("at") + F.col("first")).drop("at")


def op11_token_files(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None) -> DataFrame:
    """Write all documents' ids (end id 2) to the shared folder and return what the files say of each document; cases as of the module."""
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path("word_bpe_49k.json")
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), str(tokenizer_file), path)
    found = with_starts(written(document_digests(spark, path), "token-documents"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")
