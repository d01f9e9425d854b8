"""Command line: ``python -m kelpline COMMAND``; the stores file is $KELPLINE_STORES or ~/.config/kelpline/stores."""

from __future__ import annotations

import argparse
import json
import os
import re
import socket
import sys
import time
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from kelpline import federation as Fed
from kelpline.engine import Engine

UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}
DURATION = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)")
RFC3339 = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)")


def parse_time(text: str, now: float) -> int:
    """Unix seconds, an RFC 3339 time, or a duration before ``now`` such as 24h or 1h30m."""
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    if RFC3339.fullmatch(text):
        return int(datetime.fromisoformat(text).timestamp() // 1)
    parts = DURATION.findall(text)
    if parts and "".join(n + u for n, u in parts) == text:
        return int(now - sum(float(n) * UNITS[u] for n, u in parts))
    raise ValueError(f"{text!r} is not unix seconds, RFC3339, or a duration")


def clip(text: str, n: int) -> str:
    line = " ".join(text.split())
    return line[:n] + "…" if len(line) > n else line


def minute(ts: int) -> str:
    return time.strftime("%Y-%m-%d %H:%M", time.gmtime(ts)) if ts and ts > 0 else ""


def hit_digest(rows: list[dict], full: bool) -> str:
    """Each hit's place, the ids to go on from, and its text, cut to 500 characters unless ``full``."""
    out = [f"{len(rows)} hits"]
    for i, r in enumerate(rows, 1):
        kind = r["kind"] if r["kind"] != "message" else ""
        head = [f"{i}.", r.get("store"), f"{r['host']}/{r['source']}", f"container={r['container_title'] or r['container_id']}", f"author={r['author_name'] or r['author_id']}"]
        head += [r["project"] and f"project={r['project']}", minute(r["timestamp"]), kind and f"kind={kind}"]
        ids = [r.get("store") and f"store={r['store']}", f"container_id={r['container_id']}", f"ts={r['timestamp']}", f"id={r['id']}"]
        out.append("\n".join(["", " ".join(filter(None, head)), " ".join(filter(None, ids)), r["text"] if full else clip(r["text"], 500)]))
    return "\n".join(out)


def session_digest(rows: list[dict]) -> str:
    out = [f"{len(rows)} sessions"]
    for i, r in enumerate(rows, 1):
        head = [f"{i}.", r.get("store"), f"{r['host']}/{r['source']}", f"container={r['container_id']}", f"{minute(r['first_ts'])} → {minute(r['last_ts'])}", f"messages={r['messages']}"]
        ids = [r.get("store") and f"store={r['store']}", f"container_id={r['container_id']}", f"first_ts={r['first_ts']}"]
        out.append("\n".join(["", " ".join(filter(None, head)), " ".join(filter(None, ids)), clip(r["first_prompt"], 300)]))
    return "\n".join(out)


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kelpline")
    p.add_argument("--stores", default=os.environ.get("KELPLINE_STORES", str(Path.home() / ".config/kelpline/stores")))
    p.add_argument("--slots", type=int, default=2, help="searches at a time; 0: any number")
    p.add_argument("--deadline", type=float, default=30.0, help="seconds for a search and the wait before it")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("init", help="write the stores file")
    c.add_argument("pairs", nargs="+", metavar="NAME=ROOT")
    c.add_argument("--embedder", default="none")
    sub.add_parser("stores", help="list the stores")
    c = sub.add_parser("poll", help="index raw objects under a root, again and again")
    c.add_argument("root")
    c.add_argument("--store", default="")
    c.add_argument("--interval", type=float, default=30.0)
    c.add_argument("--rounds", type=int, default=0)
    for name in ("sync", "watch"):
        c = sub.add_parser(name, help="read what local files have grown by")
        c.add_argument("root")
        c.add_argument("source")
        c.add_argument("--store", default="")
        c.add_argument("--host", default=socket.gethostname())
        c.add_argument("--poll", type=float, default=3.0)
        c.add_argument("--dry-run", action="store_true")
        c.add_argument("--limit", type=int, default=0)
    for name, limit in (("query", 8), ("container", 50), ("sessions", None)):
        c = sub.add_parser(name)
        c.add_argument("--store", default="")
        c.add_argument("--source", default="")
        c.add_argument("--json", action="store_true")
        if limit:
            c.add_argument("--limit", type=int, default=limit)
        if name == "query":
            c.add_argument("text", nargs="+")
            c.add_argument("--embed", action=argparse.BooleanOptionalAction, default=True)
            for f in ("container", "project", "kind"):
                c.add_argument(f"--{f}", default="")
        else:
            c.add_argument("--host", default="")
        if name == "container":
            c.add_argument("id")
            c.add_argument("--after-ts", type=int, default=0)
            c.add_argument("--after-id", default="")
            c.add_argument("--include", default="")
        if name == "sessions":
            c.add_argument("--project", default="")
            c.add_argument("--since", default="24h")
            c.add_argument("--until", default="")
    c = sub.add_parser("maintain", help="one-off maintenance; 2 is returned if ids stand more than once")
    c.add_argument("--store", default="")
    for f in ("optimize", "audit-duplicates", "fragment-counts"):
        c.add_argument(f"--{f}", action="store_true")
    index = c.add_mutually_exclusive_group()
    for f in ("create-vector-index", "drop-vector-index"):
        index.add_argument(f"--{f}", action="store_true")
    c.add_argument("--delete-host", default="")
    return p


def emit(found: tuple[DataFrame, dict[str, str]], as_json: bool, key: str, digest) -> None:
    df, errors = found
    for name, e in errors.items():
        print(f"store {name}: {e}", file=sys.stderr)
    rows = [r.asDict(recursive=True) for r in df.collect()]  # what is printed
    print(json.dumps({key: rows}, ensure_ascii=False) if as_json else digest(rows))


def maintain(engine: Engine, a: argparse.Namespace) -> int:
    if a.delete_host:
        print(f"deleted={engine.delete_host(a.delete_host)}")
    if a.optimize:
        engine.optimize()
    if a.create_vector_index:
        engine.create_vector_index()
    if a.drop_vector_index:
        engine.drop_vector_index()
    if a.fragment_counts:
        print(json.dumps(engine.fragment_counts()))
    if a.audit_duplicates:
        twice = [f"{r.table}:{r.id}" for r in engine.audit_duplicates().orderBy("table", "id").toLocalIterator()]
        print("\n".join(twice) if twice else "no duplicates")
        return 2 if twice else 0
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments().parse_args(argv)
    path = Path(a.stores)
    if a.command == "init":
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(Fed.store_lines(a.pairs, a.embedder))
        print(f"wrote {path}")
        return 0
    stores = Fed.read_stores(path.read_text(), str(path)) if path.exists() else []
    if a.command == "stores":
        print("\n".join(f"{s.name} {s.root} {s.embedder}" for s in stores))
        return 0
    chosen = Fed.pick(stores, a.store)
    if not chosen:
        raise SystemExit("no stores: run init first")
    if a.command in ("sync", "watch", "poll", "maintain") and len(chosen) != 1:
        raise SystemExit(f"{a.command} works on one store: pass --store NAME")
    spark = spark or SparkSession.builder.appName("kelpline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "maintain":
        return maintain(chosen[0].open(spark), a)
    if a.command == "poll":
        chosen[0].open(spark).run(a.root, a.interval, a.rounds)
        return 0
    if a.command in ("sync", "watch"):
        engine = chosen[0].open(spark)
        while True:
            n = engine.sync(a.root, a.source, a.host, dry_run=a.dry_run, limit=a.limit)
            print(" ".join(f"{k}={v}" for k, v in n.items()))
            if a.command == "sync":
                return 0
            time.sleep(a.poll)
    fed = Fed.Federation(spark, chosen, Fed.Admission(spark, a.slots, a.deadline))
    if a.command == "query":
        filters = {"container_id": a.container, "project": a.project, "source": a.source, "kind": a.kind}
        emit(fed.search(" ".join(a.text), a.limit, embed=a.embed, **filters), a.json, "results", lambda r: hit_digest(r, False))
    elif a.command == "container":
        emit(fed.walk(a.id, after_ts=a.after_ts, after_id=a.after_id, include=a.include, limit=a.limit, host=a.host, source=a.source), a.json, "results", lambda r: hit_digest(r, True))
    else:
        now = time.time()
        until = parse_time(a.until, now) if a.until else 0
        emit(fed.sessions(parse_time(a.since, now), until, host=a.host, source=a.source, project=a.project), a.json, "sessions", session_digest)
    return 0


if __name__ == "__main__":
    sys.exit(main())
