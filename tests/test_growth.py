"""Files that grow: parsed from their new lines and the state before them, or whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kelpline.engine import Engine
from kelpline.operators import contextual as U
from kelpline.sources import jsonl, local, resume

T = "2024-01-01T00:00:%02dZ"


def _pi(rng, i):
    text = rng.choice(["please mend the boat now", "short", "what is the tide today", "the boat is mended again"])
    return rng.choice([
        {"type": "session", "id": f"s{i % 3}", "cwd": rng.choice(["/x/boat", "/x/pier", ""])},
        {"type": rng.choice(["title", "title_change"]), "id": f"t{i}", "title": f"Title {i % 4}", "timestamp": 100 + i},
        *4 * [{"type": "message", "id": rng.choice([f"m{i}", ""]), "timestamp": 100 + i, "message": {"role": rng.choice(["user", "assistant"]), "content": text}}],
        {"type": "message", "id": f"d{i}", "message": {"role": "toolResult", "toolName": "todo", "details": {"phases": [i]}}},
    ])


def _claude(rng, i):
    return rng.choice([
        {"type": "summary", "summary": f"Boat work {i % 3}"},
        {"type": "user", "uuid": f"u{i}", "timestamp": T % (i % 60), "message": {"role": "user", "content": f"please mend boat {i}"}} | rng.choice([{}, {}, {"cwd": "/x/boat"}, {"cwd": ""}]),
        {"type": "assistant", "uuid": f"a{i}", "message": {"role": "assistant", "content": [{"type": "text", "text": "mending it now"}, {"type": "tool_use", "id": f"k{i % 5}", "name": "Task"}, {"type": "tool_use", "id": f"b{i}", "name": "Bash", "input": {"command": "ls"}}]}},
        {"type": "user", "uuid": f"r{i}", "timestamp": T % (i % 60), "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": f"k{rng.randrange(6)}", "content": f"done {i}"}]}},
    ])


def _codex(rng, i):
    return rng.choice([
        {"type": "session_meta", "timestamp": T % 1, "payload": {"id": f"c{i % 2}", "cwd": "/x/y"}},
        *4 * [{"type": "response_item", "timestamp": T % (i % 60), "payload": {"type": "message", "role": rng.choice(["user", "assistant"]), "id": rng.choice([f"i{i % 6}", ""]), "content": [{"text": f"hello there {i % 4}"}]}}],
    ])


def _files(seed):
    """Lines of one file of each source and kind of opening."""
    rng = random.Random(seed)
    makers = {"pi": _pi, "claude": _claude, "codex": _codex}
    files = {f"h/{s}/%2Fx%2Fsea/f{k}/updates.jsonl": [json.dumps(make(rng, i)) for i in range(rng.randrange(4, 24))] for s, make in makers.items() for k in range(4)}
    again = json.dumps({"type": "message", "id": "q", "timestamp": 5, "message": {"role": "user", "content": 'Summarize the relationship with "Bo" now'}})
    files["h/pi/a/b/restates.jsonl"] = [json.dumps({"type": "title", "id": "t", "title": "x"}), again, json.dumps(_pi(rng, 1)), json.dumps(_pi(rng, 2))]
    files["h/pi/a/b/odd.jsonl"] = ["not json", "", "[1]", "é" * 3, *[json.dumps(_pi(rng, i)) for i in range(8)]]
    return files, rng


def _frame(spark, objects):
    return spark.createDataFrame([(k, bytearray("".join(x + "\n" for x in v).encode())) for k, v in objects.items()], "key string, content binary")


COLUMNS = ("id", "text", "source", "container_id", "project", "author_id", "author_name", "kind", "timestamp", "key", "at", "sub", "line_no")
SOURCES = ["pi", "claude", "codex"]
UNIT = ("key", "id", "container_title", "header", "body", "content_hash")


@pytest.mark.parametrize("seed", [2])
def test_new_lines_give_what_a_whole_parse_does(spark, seed):
    files, rng = _files(seed)
    cuts = {k: sorted({rng.randrange(len(v) + 1) for _ in range(1)} | {len(v)}) for k, v in files.items()}
    before, seen, at = None, set(), dict.fromkeys(files, 0)
    for step in range(max(map(len, cuts.values()))):
        to = {k: c[min(step, len(c) - 1)] for k, c in cuts.items()}
        grown = {k: files[k][at[k] : to[k]] for k in files if to[k] > at[k] or step == 0}
        objects = resume.continued(_frame(spark, grown), before).persist()
        found = resume.rows(objects, SOURCES).persist()
        whole = jsonl.parse(_frame(spark, {k: files[k][: to[k]] for k in grown}), sources=SOURCES).persist()
        want = {tuple(r) for r in whole.select(*COLUMNS).collect()}
        skipped = {r.key for r in resume.restating(objects, found).where("skip").collect()}
        got = [tuple(r) for r in found.select(*COLUMNS).collect() if r.key not in skipped]
        assert len(got) == len(set(got)) and set(got) == want - seen
        after = resume.state(objects, found).collect()
        assert sum(r.lines for r in after) == sum(to[k] for k in grown)
        kept = {r.key: r for r in (before.collect() if before is not None else [])} | {r.key: r for r in after}
        before = spark.createDataFrame(list(kept.values()), f"key string, {resume.STATE}")
        seen, at = seen | want, to
        if step == 0:
            continue
        retitled = {r.key for r in found.where("kind = 'title'").collect()}  # whose earlier units change too
        plain = lambda df: {tuple(r) for r in df.select(*UNIT).collect() if r.key not in retitled}
        ids = {(r[9], r[0]) for r in got}
        assert plain(resume.units(objects, found)) == {u for u in plain(U.units(whole)) if u[:2] in ids}
    assert len(seen) > 60


def test_sync_reads_only_what_is_new(spark, tmp_path):
    files = {k: v for k, v in _files(7)[0].items() if "/claude/" in k}
    e = Engine(spark, f"file://{tmp_path}/st")
    for part in (0.6, 1.0):
        for k, v in files.items():
            path = tmp_path / "in" / k.split("/", 2)[2]
            path.parent.mkdir(parents=True, exist_ok=True)
            body = "".join(x + "\n" for x in v).encode()
            path.write_bytes(body[: int(len(body) * part)])
        e.sync(f"file://{tmp_path}/in", "claude", "h")
    # files of one name share their ids, so their rows are told apart by hash
    want = {(r.id, r.content_hash) for r in U.units(jsonl.parse(_frame(spark, files), sources=["claude"])).collect()}
    have = {(r.dedup_key.removesuffix("|unit"), r.content_hash) for r in e.store.read("dedup").collect()}
    assert {i for i, _ in want} == {i for i, _ in have} == {r.id for r in e.store.read("messages").collect()}
    assert {r.lines for r in e.store.read("progress").collect()} == {len(v) for v in files.values()}


def test_what_is_read_of_a_grown_file(spark, tmp_path):
    path = tmp_path / "in" / "f.jsonl"
    path.parent.mkdir()
    path.write_bytes(b"x" * 50_000 + b"\nnew line\npart")
    found = local.files(spark, f"file://{tmp_path}/in")
    cursor = spark.createDataFrame([(found.first().path, 50_001)], local.CURSOR)
    (r,) = local.grown(found, cursor).collect()
    assert bytes(r.content) == b"new line\n" and (r.start, r.offset) == (50_001, 50_010)
    plan = local.grown(found, cursor)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("FileScan binaryFile")[1].split("Location")[0]  # only the listing
    (whole,) = local.grown(found, cursor, ranged=False).collect()
    assert whole == r
    path.write_bytes(b"short\n")  # it has shrunk
    (r,) = local.grown(local.files(spark, f"file://{tmp_path}/in"), cursor).collect()
    assert bytes(r.content) == b"short\n" and (r.start, r.offset) == (0, 6)
    assert local.grown(local.files(spark, f"file://{tmp_path}/in"), None, most=3).count() == 0
