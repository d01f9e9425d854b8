"""Token-ID output: Arrow stream files of equal-length sequences and masks.

Documents are dealt out by ranges of (doc_id, hash of the text) and sorted, each range writes Arrow stream files of at most ``FILE_IDS`` ids, whole documents each: batches of
``ROWS`` fixed-size lists of ``length`` ids (unsigned 16 bits, or 32 for larger vocabularies) and of a mask, a bit for each id, that is 0 where the
last sequence is padded. The ids of a file's documents follow each other without gaps, so sequence i of a mapped
file starts at a known address. Beside it lies a stream of the documents' places (doc_id, start, n_tokens).

Files go to the shared folder by ``pyarrow.fs``; every attempt of a task writes under its own name, and only the names that
the finished job reports are ever read, so a lost executor leaves no half file in use. What the driver gathers is one
row for each file. Reading goes through a file batch by batch, and holds one.

Tokenizing: parts of a text are encoded one by one, since no token crosses a white space; texts of plain Latin letters are
parted as the tokenizer itself does after lower-casing. Each distinct part of a batch that isn't in the worker's
memory goes through the library, all of them in one call with the end-of-text token as a fence. Long parts aren't remembered. Texts with a
special token's own string are encoded whole.

Defined cases: a null text is empty, and a document without ids has its end id alone; documents with a null doc_id come first;
rows that repeat a doc_id follow each other by their texts' hashes, in every run; an empty table writes no files.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import bounded_batches, shared_dir

LENGTH, ROWS, FILE_IDS = 1024, 256, 1 << 28
#: Entries of a worker's memory, and the longest part that is remembered: at most 150 MB or so.
CACHE, CACHED_LENGTH = 700_000, 48
_PART = re.compile("[^ \n]+")
#: In texts of these characters alone, the tokenizer's own parts: letters, single digits, other characters in a row.
_PLAIN = re.compile("[\x20-\x26\x28-\x7e\nÀ-ÖØ-öø-ÿ]*")
_FINE = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^ \na-zß-öø-ÿ0-9]+")


class PartTokenizer:
    """Encodes as ``Tokenizer.encode`` does without special tokens, remembering the parts of texts."""

    def __init__(self, path: str, fence: str = "<|endoftext|>"):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.fence = fence
        self.added = [x.content for x in self.t.get_added_tokens_decoder().values()]
        self.fence_id = self.t.token_to_id(fence)
        self.wide = self.t.get_vocab_size() > 1 << 16
        self.kind = np.uint32 if self.wide else np.uint16
        self.cache: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            ids = np.array(self.t.encode_batch_fast([self.fence.join(some)], add_special_tokens=False)[0].ids, self.kind)
            fences = np.flatnonzero(ids == self.fence_id)
            width = ids.itemsize
            begins, stops = [0, *((fences + 1) * width).tolist()], [*(fences * width).tolist(), len(ids) * width]
            data = ids.tobytes()
            self.cache.update(zip(some, [data[a:b] for a, b in zip(begins, stops)]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes of ``kind``."""
        whole = {i for i, t in enumerate(texts) if any(x in t for x in self.added)}
        split = [[] if i in whole else _FINE.findall(t.lower()) if _PLAIN.fullmatch(t) else _PART.findall(t) for i, t in enumerate(texts)]
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        new = [p for p in set().union(*split) if p not in cache]
        self._learn(new)
        out = [b"".join(map(cache.__getitem__, parts)) for parts in split]
        for p in new:
            if len(p) > CACHED_LENGTH:
                del cache[p]
        for i, b in zip(sorted(whole), self._library([texts[i] for i in sorted(whole)])):
            out[i] = b
        return out


_tokenizers: dict[str, PartTokenizer] = {}


def tokenizer_of(path: str) -> PartTokenizer:
    """One for each worker process, so that what it remembers outlives a task."""
    if path not in _tokenizers:
        _tokenizers[path] = PartTokenizer(path)
    return _tokenizers[path]


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _schemas(length: int, kind: pa.DataType) -> tuple[pa.Schema, pa.Schema]:
    return (
        pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))], {"length": str(length)}),
        pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]),
    )


class _Writer:
    """Collects ids and writes full batches; the last one is padded."""

    def __init__(self, fs: pa.fs.FileSystem, path: str, length: int, kind: type):
        self.sequences, self.places = _schemas(length, pa.from_numpy_dtype(kind))
        self.length, self.kind, self.n, self.left = length, kind, 0, b""
        self.files = [fs.open_output_stream(f"{path}.ids.arrows"), fs.open_output_stream(f"{path}.docs.arrows")]
        self.ids, self.docs = (pa.ipc.new_stream(f, s) for f, s in zip(self.files, (self.sequences, self.places)))

    def _put(self, flat: np.ndarray, valid: int) -> None:
        mask = np.arange(len(flat)) < valid
        self.ids.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.sequences))

    def add(self, doc_ids: list, encoded: list[bytes]) -> None:
        width = np.dtype(self.kind).itemsize
        counts = np.array([len(b) // width for b in encoded], np.int64)
        starts = self.n + np.cumsum(counts) - counts
        self.docs.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(counts)], schema=self.places))
        self.n += int(counts.sum())
        data = b"".join([self.left, *encoded])
        step = self.length * ROWS * width
        full = len(data) // step * step
        for at in range(0, full, step):
            self._put(np.frombuffer(data, self.kind, step // width, at), step // width)
        self.left = data[full:]

    def close(self) -> int:
        if self.left:
            flat = np.frombuffer(self.left, self.kind)
            rows = -(-len(flat) // self.length)
            self._put(np.concatenate([flat, np.zeros(rows * self.length - len(flat), self.kind)]), len(flat))
        for x in (self.ids, self.docs, *self.files):
            x.close()
        return self.n


def write_tokens(docs: DataFrame, tokenizer: str, out: str | None = None, end_id: int | None = 2, length: int = LENGTH, files: int | None = None) -> list[tuple[int, str, int]]:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order, in ``files`` ranges; (number, path without suffix, ids) of each file, in order."""
    spark = docs.sparkSession
    bounded_batches(spark)
    base = out or shared_dir(spark, "tokens")
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    dealt = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, writer, path, k = tokenizer_of(tokenizer), None, "", 0
        part = TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id], tok.kind).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                if writer is None:
                    fs, root = _open(base)
                    fs.create_dir(root, recursive=True)
                    path = f"part-{part:06d}-{k:06d}-{uuid.uuid4().hex}"
                    writer = _Writer(fs, f"{root}/{path}", length, tok.kind)
                some = batch.slice(at, 500)
                writer.add(some.column("doc_id").to_pylist(), [b + end for b in tok.encode([t or "" for t in some.column("text").to_pylist()])])
                if writer.n >= FILE_IDS:
                    yield pa.record_batch({"part": pa.array([part], pa.int32()), "k": pa.array([k], pa.int32()), "path": [f"{base}/{path}"], "n": pa.array([writer.close()], pa.int64())})
                    writer, k = None, k + 1
        if writer is not None:
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "k": pa.array([k], pa.int32()), "path": [f"{base}/{path}"], "n": pa.array([writer.close()], pa.int64())})

    done = sorted(map(tuple, dealt.mapInArrow(write, "part int, k int, path string, n long").collect()))  # one row for each file
    return [(i, path, ids) for i, (_, _, path, ids) in enumerate(done)]


def _input(fs: pa.fs.FileSystem, path: str) -> pa.NativeFile:
    return pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)


class TokenFile:
    """Random access to the sequences of one file. A local file is mapped: ids and masks are views of it."""

    def __init__(self, path: str):
        fs, root = _open(path)
        with _input(fs, f"{root}.ids.arrows") as f:
            reader = pa.ipc.open_stream(f)
            self.length = int(reader.schema.metadata[b"length"])
            self.batches = list(reader)
        self.rows = sum(b.num_rows for b in self.batches)

    def _at(self, i: int, column: int) -> pa.Array:
        """All batches but the last have the first one's number of rows."""
        if not 0 <= i < self.rows:
            raise IndexError(i)
        batch, row = divmod(i, self.batches[0].num_rows)
        return self.batches[batch].column(column).values.slice(row * self.length, self.length)

    def ids(self, i: int) -> np.ndarray:
        return self._at(i, 0).to_numpy()

    def mask(self, i: int) -> pa.BooleanArray:
        """Bits of the mapped file; as a numpy array they would be a copy."""
        return self._at(i, 1)


def read_tokens(spark, written: list[tuple[int, str, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the documents of ``write_tokens``'s files, read back from them; no files, no rows."""
    starts = np.concatenate([[0], np.cumsum([n for _, _, n in written])]).tolist()
    rows = [(p, int(s)) for (_, p, _), s in zip(written, starts)]
    files = spark.createDataFrame(rows, "path string, first long").repartition(max(1, len(rows)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _documents(path, first)

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _valid(reader: pa.RecordBatchReader) -> Iterator[memoryview]:
    """Each batch's ids without padding, as bytes of little-endian unsigned 32-bit integers."""
    for b in reader:
        ids, mask = b.column(0).flatten().to_numpy(), b.column(1).flatten()
        n = mask.true_count  # the padding is at the end
        yield memoryview(ids[:n].astype("<u4")).cast("B")


def _documents(path: str, first: int) -> Iterator[pa.RecordBatch]:
    fs, root = _open(path)
    with _input(fs, f"{root}.ids.arrows") as ids, _input(fs, f"{root}.docs.arrows") as docs:
        blocks, block, at = _valid(pa.ipc.open_stream(ids)), memoryview(b""), 0
        for b in pa.ipc.open_stream(docs):
            n, sums = b.column("n_tokens").to_numpy(), []
            for left in (n * 4).tolist():
                crc = 0
                while left:
                    if at == len(block):
                        block, at = next(blocks), 0
                    k = min(left, len(block) - at)
                    crc = zlib.crc32(block[at : at + k], crc)
                    left, at = left - k, at + k
                sums.append(crc)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "start": pa.array(b.column("start").to_numpy() + first), "n_tokens": pa.array(n), "ids_crc32": pa.array(sums, pa.int64())})
