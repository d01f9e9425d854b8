"""Growing JSON-lines files: what is complete, what is new since a cursor, and copying of trees to a raw store."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.sources.jsonl import CHATS, LARGEST, SOURCES, object_key

CURSOR = "path string, offset long"


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel, size, content) of the ``*.jsonl`` files under ``root``; a root that is missing has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "path string, rel string, size long, content binary")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root)
    return found.select("path", object_key(root).alias("rel"), F.col("length").alias("size"), "content")


def _complete(path: str, rel: str, start: int, body: bytes) -> Iterator[pa.RecordBatch]:
    end = body.rfind(b"\n") + 1
    if end:
        yield pa.record_batch([[path], [rel], [body[:end]], [start], [start + end]], names=["path", "rel", "content", "start", "offset"])


def grown(found: DataFrame, cursor: DataFrame | None, most: int = LARGEST, ranged: bool | None = None) -> DataFrame:
    """Files whose size is not their cursor's offset: (path, rel, content, start, offset).

    ``content`` is the complete lines from ``start`` on, which is the old offset or, if the file shrank, 0; ``offset`` is just after the last of them. At most ``most`` bytes are taken, the rest
    waits for the next call, as does a last line without its end; a file without a new complete line gives no row, nor does one whose next line is longer than ``most``.
    Of files on a file system of the executors' own only these bytes are read (``ranged``, else told by the path); others come whole through Spark's reader.
    """
    known = cursor if cursor is not None else found.sparkSession.createDataFrame([], CURSOR)
    moved = found.join(known.select("path", F.col("offset").alias("old")), "path", "left").withColumn("old", F.coalesce("old", F.lit(0)))
    start = F.when(F.col("old") <= F.col("size"), F.col("old")).otherwise(0).cast("long").alias("start")
    due = moved.where(F.col("size") != F.col("old"))
    here = F.col("path").startswith("file:") if ranged is None else F.lit(ranged)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, rel, size, start in zip(*(c.to_pylist() for c in b.columns)):
                with open("/" + path.removeprefix("file:").lstrip("/"), "rb") as f:
                    f.seek(start)
                    yield from _complete(path, rel, start, f.read(min(size - start, most)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # an object at a time
                path, rel, start, body = (b.column(c)[i].as_py() for c in range(4))
                yield from _complete(path, rel, start, body or b"")

    kind = "path string, rel string, content binary, start long, offset long"
    parts = []
    if ranged is not False:
        parts.append(due.where(here).select("path", "rel", "size", start).mapInArrow(read, kind))
    if ranged is not True:
        parts.append(due.where(~here).select("path", "rel", start, F.substring("content", start.cast("int") + 1, F.lit(most)).alias("content")).mapInArrow(cut, kind))
    return reduce(DataFrame.unionByName, parts)


def whole(found: DataFrame, upto: DataFrame) -> DataFrame:
    """The files of ``upto`` (path, offset) from their beginning to their offset: (path, rel, content)."""
    return found.join(upto.select("path", "offset"), "path").select("path", "rel", F.substring(F.col("content"), F.lit(1), F.col("offset").cast("int")).alias("content"))


@dataclass(frozen=True)
class Tree:
    """A local folder that holds a source's files."""

    source: str
    root: str


def chat_tree(source: str, root: str) -> Tree:
    """A chat export's folder; its source is one path segment and not a session source's name."""
    if source in ("", ".", "..") or "/" in source or "\\" in source:
        raise ValueError(f"chat source {source!r} must be a single path segment")
    if source in SOURCES and source not in CHATS:
        raise ValueError(f"chat source {source!r} names a session source")
    return Tree(source, root)


def local_objects(trees: list[Tree], host: str) -> list[tuple[str, str, int]]:
    """(key, path, size) of this machine's files, keys ``<host>/<source>/<relative path>``.

    In a chat's folder, top folders named like a chat source belong to that one and are passed over. Of grok's logs only ``updates.jsonl``
    goes. Missing roots are empty; a root that is no folder is an error.
    """
    if not host or "/" in host or "\\" in host:
        raise ValueError(f"invalid host {host!r}")
    chats = {t.source for t in trees} - (set(SOURCES) - set(CHATS)) | set(CHATS)
    out = []
    for t in trees:
        if not t.root or not os.path.exists(t.root):
            continue
        if not os.path.isdir(t.root):
            raise NotADirectoryError(t.root)
        for folder, below, names in os.walk(t.root):
            if t.source in chats and os.path.samefile(folder, t.root):
                below[:] = [d for d in below if d not in chats]
            below.sort()
            for n in sorted(names):
                if n.lower().endswith(".jsonl") and (t.source != "grok" or n == "updates.jsonl"):
                    path = os.path.join(folder, n)
                    rel = os.path.relpath(path, t.root).replace(os.sep, "/")
                    out.append((f"{host}/{t.source}/{rel}", path, os.path.getsize(path)))
    return out


def upload(spark: SparkSession, trees: list[Tree], host: str, target: str) -> dict[str, int]:
    """Copy files whose size in ``target`` differs, exactly as many bytes as were listed: scanned, uploaded, skipped.

    The target is listed once. The files are this machine's, so the driver copies them.
    """
    jvm, conf, target = spark._jvm, spark._jsc.hadoopConfiguration(), target.rstrip("/")
    objects = local_objects(trees, host)
    paths = {key: path for key, path, _ in objects}
    there = listing(spark, f"{target}/{host}", target)
    todo = differences(spark.createDataFrame([(k, n) for k, _, n in objects], "key string, size long"), there).orderBy("key").collect()  # this machine's files
    for key, size in todo:
        to = jvm.org.apache.hadoop.fs.Path(f"{target}/{key}")
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(jvm.java.io.FileInputStream(paths[key]), to.getFileSystem(conf).create(to, True), size, True)
    return {"scanned": len(objects), "uploaded": len(todo), "skipped": len(objects) - len(todo)}


def listing(spark: SparkSession, root: str, base: str) -> DataFrame:
    """(key, size) of the files under ``root``, named from ``base`` on; their content isn't read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "key string, size long")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(object_key(base).alias("key"), F.col("length").alias("size"))


def differences(here: DataFrame, there: DataFrame) -> DataFrame:
    """The (key, size) of ``here`` that ``there`` doesn't have."""
    return here.join(there, ["key", "size"], "left_anti")
