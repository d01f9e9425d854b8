"""Moving a store of the older layout (one row a file path) into the present tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions.text import chunk_id
from kelpline.sources.jsonl import COLUMNS
from kelpline.sources.store import Store

#: The older layout's text columns and where they go.
RENAMED = {"forward_content": "text", "harness": "source", "host": "host", "session_id": "container_id", "project_name": "project", "role": "author_id", "file_hash": "content_hash"}


def _parts(path: Column) -> Column:
    return F.split(path, "/")


def _plain(path: Column) -> Column:
    """The shorter path of the same message; null for paths that are not ``host/harness/session/message/turn``."""
    p = _parts(path)
    return F.when((F.size(p) == 5) & (F.get(p, F.lit(3)) == "message"), F.concat_ws("/", p[0], p[1], p[2], F.get(p, F.lit(4))))


def identity(path: Column, old_id: Column) -> tuple[Column, Column]:
    """(message id, kind) of an older row: five segments name their kind in the fourth, all else are messages."""
    p, path = _parts(path), F.coalesce(path, F.lit(""))
    id = F.when(path == "", old_id).otherwise(F.coalesce(_plain(path), path))
    return id, F.when((path != "") & (F.size(p) == 5), F.get(p, F.lit(3))).otherwise("message")


def converted(rows: DataFrame, messages: DataFrame, chunk: bool) -> DataFrame:
    """Older rows in the present columns, without those whose path has a ``/message/`` twin among ``messages``.

    Null texts become empty and null numbers 0; a missing column is an error of Spark's.
    """
    twins = messages.select(_plain(F.col("file_path")).alias("file_path")).where("file_path IS NOT NULL").distinct()
    left = rows.join(twins, "file_path", "left_anti")
    id, kind = identity(F.col("file_path"), F.coalesce("id", F.lit("")))
    texts = {new: F.coalesce(F.col(old), F.lit("")) for old, new in RENAMED.items()}
    fixed = {"container_kind": F.lit("agent_session"), **{c: F.lit("") for c in ("container_title", "author_name", "reply_to", "attrs")}}
    number = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("timestamp", "chunk_count", *(["chunk_index"] if chunk else []))}
    all = texts | fixed | number | {"message_id": id, "kind": kind}
    out = left.select(*[c.alias(n) for n, c in all.items()], *(["vector"] if chunk else []))
    if not chunk:
        return out.withColumn("id", F.col("message_id")).select(*COLUMNS)
    return out.withColumn("id", chunk_id(F.col("message_id"), F.col("chunk_index")))


def migrate(store: Store, messages: DataFrame, chunks: DataFrame) -> dict[str, int]:
    """Upsert both older tables, messages first and with their deduplication state; rows expected of each.

    Each table is one version, and the ``migration`` table names those that are done: a run that was cut short starts at the table
    that was not. Two rows that map to one id are an error, found before anything is written; so is a table that holds fewer rows than expected afterwards.
    """
    done = store.read("migration")
    state = {r.name: r for r in done.where("expected IS NOT NULL").collect()} if done is not None else {}  # two rows at most
    out = {}
    for name, rows in (("messages", messages), ("chunks", chunks)):
        if name in state:
            out[name] = state[name].expected
            continue
        new = converted(rows, messages, name == "chunks")
        n, distinct = new.agg(F.count("*"), F.count_distinct("id")).first()
        if distinct < n:
            raise ValueError(f"migrated {name} have {distinct} ids, expected {n}: readable ids collided")
        store.upsert(name, new)
        if name == "messages":
            store.upsert("dedup", new.select(F.concat("id", F.lit("|unit")).alias("dedup_key"), "content_hash").where("content_hash <> ''"), "dedup_key")
        if (held := store.read(name).count()) < n:
            raise ValueError(f"{name} holds {held} rows, expected {n} or more")
        store.upsert("migration", store.spark.createDataFrame([(name, n)], "name string, expected long"), "name")
        out[name] = n
    return out


def migrate_store(store: Store, older: Store) -> dict[str, int]:
    """``migrate`` from a store that may still be written: its tables are read at the versions of the first run, which later runs keep to."""
    done = store.read("migration")
    pins = {r.name: r.version for r in done.where("name LIKE 'older/%'").collect()} if done is not None else {}
    if not pins:
        pins = {f"older/{t}": older.version(t).n for t in ("messages", "chunks")}
        store.upsert("migration", store.spark.createDataFrame([(k, None, n) for k, n in pins.items()], "name string, expected long, version int"), "name")
    tables = [older.read(t, pins[f"older/{t}"]) for t in ("messages", "chunks")]
    if any(t is None for t in tables):
        raise LookupError(f"the older store no longer has the versions {pins}")
    return migrate(store, *tables)
