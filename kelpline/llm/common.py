"""Helpers shared by the training-data operators: words, shared folders, row digests."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions.batches import bounded_batches  # noqa: F401, for the operators

#: Everything but digits, ASCII letters of either case and non-ASCII characters separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same words in Python's re, for text whose A-Z are lower-cased already.
WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(c, UPPER, LOWER)


def fold(c: Column) -> Column:
    """A coarser key than ascii_lower: words equal under that are equal here. Free of context, so folding a text folds its words."""
    return F.lower(F.replace(c, F.lit("\u03a3"), F.lit("\u03c3")))


def raw_words(text: Column) -> Column:
    """Words of a text in their own case; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def own_words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; in a text of ASCII alone a faster function does that."""
    return raw_words(F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(ascii_lower(text)))


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text's content; null stays null."""
    return F.unhex(F.md5(text.cast("binary")))


def row_key(docs: DataFrame, text: str = "text") -> Column:
    """``text_key`` for left joins: null texts get a key of eight bytes, by their other columns, that equals no text's and doesn't gather them in one task."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema if f.name != text and f.dataType.typeName() not in ("map", "variant")]
    return F.coalesce(text_key(F.col(text)), F.unhex(F.lpad(F.hex(F.xxhash64(*plain, F.lit(0))), 16, "0")))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that all executors share (spark.checkpoint.dir).

    Only where that setting is missing and Spark runs in one process, as in local tests, a folder of this machine is used; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "kelpline-shared")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in files that survive executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that ``df`` does not have, whatever case rules hold."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        c = f"__{n}"
        while c.lower() in have:
            c += "_"
        have.add(c.lower())
        out.append(c)
    return out
