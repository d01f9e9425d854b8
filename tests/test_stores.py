import json
import random
import threading
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kelpline import __main__ as cli
from kelpline import federation as Fed
from kelpline.engine import Engine
from kelpline.operators import quantised as Q
from kelpline.operators import search as S
from kelpline.operators.contextual import hashed_vectors
from kelpline.sources import local
from kelpline.sources.migrate import converted, migrate, migrate_store
from kelpline.sources.store import Conflict, Store

ROW = "id string, text string, source string, container_id string, host string, timestamp long"


def _fill(spark, root, name):
    e = Engine(spark, root, hashed_vectors(8), 8)
    e.ingest(spark.createDataFrame([(f"{name}{i}", f"tide tables of {name} {i}", "crm", f"c{i}", "h", 100 + i) for i in range(3)], ROW))
    return e


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stores")
    for n in ("a", "b"):
        _fill(spark, f"file://{root}/{n}", n)
    return [Fed.Named(n, f"file://{root}/{n}", "hashed:8") for n in ("a", "b", "gone")]


def test_stores_file():
    assert Fed.read_stores("# c\n\n a r none \n") == [Fed.Named("a", "r", "none")]
    with pytest.raises(ValueError, match="f:2: want"):
        Fed.read_stores("a r none\nb r", "f")
    assert Fed.store_lines(["a=x", "b=y=z"]) == "a x none\nb y=z none\n"
    for bad in ([], ["a"], ["=x"], ["a="], ["a=x y"], ["a=x", "a=y"]):
        with pytest.raises(ValueError):
            Fed.store_lines(bad)
    with pytest.raises(LookupError, match="configured: a"):
        Fed.pick([Fed.Named("a", "r")], "z")


def test_federated_calls_report_the_store_that_fails(spark, stores):
    fed = Fed.Federation(spark, stores)
    hits, errors = fed.search("tide", limit=3)
    assert [r.store for r in hits.collect()] == ["a", "b", "a"] and list(errors) == ["gone"]
    page, _ = fed.walk("c1")
    assert [(r.store, r.id) for r in page.collect()] == [("a", "a1"), ("b", "b1")]
    listed, errors = fed.sessions(1)
    assert [r.store for r in listed.collect()] == ["a"] * 3 + ["b"] * 3 and list(errors) == ["gone"]
    with pytest.raises(RuntimeError, match="every store"):
        Fed.Federation(spark, stores[2:]).search("tide")


def test_admission(spark):
    one = Fed.Admission(spark, 1, 0.3)
    assert one.run(lambda: 5) == 5 and Fed.Admission(spark, 0).run(lambda: 6) == 6
    with pytest.raises(KeyError):
        one.run(lambda: {}["x"])
    go = threading.Event()
    with pytest.raises(TimeoutError, match="longer"):
        one.run(go.wait)
    with pytest.raises(TimeoutError, match="slot"):  # the late search holds its slot
        one.run(lambda: 1)
    go.set()
    time.sleep(0.2)
    assert one.run(lambda: 7) == 7


def test_command_line(spark, stores, tmp_path, capsys):
    f = tmp_path / "cfg" / "stores"
    run = lambda *a: cli.main(["--stores", str(f), *a], spark)
    assert run("init", *[f"{s.name}={s.root}" for s in stores], "--embedder", "hashed:8") == 0 and run("stores") == 0
    capsys.readouterr()
    assert run("query", "tide", "--limit", "2", "--json") == 0
    out = capsys.readouterr()
    assert [r["store"] for r in json.loads(out.out)["results"]] == ["a", "b"] and "store gone" in out.err
    run("container", "c2", "--store", "b")
    assert "1. b h/crm container=c2" in capsys.readouterr().out
    run("sessions", "--since", "1", "--store", "a")
    assert capsys.readouterr().out.startswith("3 sessions")
    assert run("maintain", "--store", "a", "--audit-duplicates", "--fragment-counts") == 0
    with pytest.raises(SystemExit):
        run("maintain", "--optimize")


def test_times():
    assert cli.parse_time("12", 0) == 12 and cli.parse_time("1970-01-01T01:00:00+01:00", 0) == 0 and cli.parse_time("1h30m", 9000) == 3600
    for bad in ("", "1d", "h", "2024-01-01"):
        with pytest.raises(ValueError):
            cli.parse_time(bad, 0)


def _line(i):
    return json.dumps({"type": "message", "id": f"m{i}", "timestamp": 5, "message": {"role": "user", "content": f"message number {i}"}}) + "\n"


def test_sync_reads_what_is_complete(spark, tmp_path):
    path = tmp_path / "in" / "s" / "f.jsonl"
    path.parent.mkdir(parents=True)
    e = Engine(spark, f"file://{tmp_path}/st", hashed_vectors(4), 4)
    sync = lambda **k: e.sync(f"file://{tmp_path}/in", "pi", "h", **k)
    path.write_text(_line(1) + _line(2)[:20])
    assert sync(dry_run=True) == {"files": 1, "accepted": 0} and sync() == {"files": 1, "accepted": 1}
    assert e.store.read("cursor").first().offset == len(_line(1))
    path.write_text(_line(1) + _line(2))
    tail = local.grown(local.files(spark, f"file://{tmp_path}/in"), e.store.read("cursor")).first().content
    assert bytes(tail).decode() == _line(2)
    assert sync() == {"files": 1, "accepted": 1} and sync() == {"files": 0, "accepted": 0}
    path.write_text(_line(3))  # shorter than the cursor
    assert sync() == {"files": 1, "accepted": 1}
    assert {r.id for r in e.store.read("messages").collect()} == {f"h/pi/f/m{i}" for i in (1, 2, 3)}
    assert local.files(spark, f"file://{tmp_path}/none").count() == 0


def test_upload(spark, tmp_path):
    for p in ("tg/a.jsonl", "tg/x/b.jsonl", "tg/deep/x/c.jsonl", "grok/s/updates.jsonl", "grok/s/chat.jsonl", "grok/n.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    trees = [local.chat_tree("telegram", f"{tmp_path}/tg"), local.Tree("grok", f"{tmp_path}/grok"), local.Tree("pi", f"{tmp_path}/none")]
    assert [k for k, _, _ in local.local_objects(trees, "h")] == ["h/telegram/a.jsonl", "h/telegram/deep/x/c.jsonl", "h/grok/s/updates.jsonl"]
    assert local.upload(spark, trees, "h", f"file://{tmp_path}/raw") == {"scanned": 3, "uploaded": 3, "skipped": 0}
    (tmp_path / "tg/a.jsonl").write_text("longer than before")
    assert local.upload(spark, trees, "h", f"file://{tmp_path}/raw") == {"scanned": 3, "uploaded": 1, "skipped": 2}
    assert (tmp_path / "raw/h/telegram/a.jsonl").read_text() == "longer than before"
    for bad in ("", "..", "a/b", "pi"):
        with pytest.raises(ValueError):
            local.chat_tree(bad, "d")


OLD = "id string, forward_content string, project_name string, file_path string, file_hash string, session_id string, host string, harness string, role string, timestamp long, chunk_count long, chunk_index long, vector array<float>"


def _old(spark, rows):
    return spark.createDataFrame([(i, f"text of {p}", None, p, f"x{i}", "s", "h", "pi", "user", 5, 1, 0, [1.0]) for i, p in rows], OLD)


def test_migration(spark, tmp_path):
    old = _old(spark, [("1", "h/pi/s/t1"), ("2", "h/pi/s/message/t1"), ("3", "h/pi/s/title/t2"), ("4", ""), ("5", None), ("6", "h/pi/s/t3")])
    got = {r.id: (r.kind, r.text) for r in converted(old, old, False).collect()}
    assert got == {"h/pi/s/t1": ("message", "text of h/pi/s/message/t1"), "h/pi/s/title/t2": ("title", "text of h/pi/s/title/t2"), "4": ("message", "text of "), "5": ("message", "text of None"), "h/pi/s/t3": ("message", "text of h/pi/s/t3")}
    store = Store(spark, f"file://{tmp_path}/m")
    assert migrate(store, old, old) == {"messages": 5, "chunks": 5} == migrate(store, old, old)
    assert store.read("chunks").where("id = 'h/pi/s/t1#0' AND message_id = 'h/pi/s/t1'").count() == 1 and store.read("dedup").count() == 5
    with pytest.raises(ValueError, match="collided"):
        migrate(Store(spark, f"file://{tmp_path}/n"), _old(spark, [("1", "h/a/b"), ("2", "h/a/b")]), old)


def test_migration_keeps_to_the_versions_it_began_with(spark, tmp_path):
    older, store = Store(spark, f"file://{tmp_path}/old"), Store(spark, f"file://{tmp_path}/new")
    for t in ("messages", "chunks"):
        older.write(t, _old(spark, [("1", "h/pi/s/t1")]), "file_path")
    first = older.version("messages").n
    assert migrate_store(store, older) == {"messages": 1, "chunks": 1}
    older.upsert("messages", _old(spark, [("2", "h/pi/s/t2")]), "file_path")
    assert migrate_store(store, older) == {"messages": 1, "chunks": 1} and store.read("messages").count() == 1
    assert store.read("migration").where("name = 'older/messages'").first().version == first
    store.drop("migration")
    assert migrate_store(store, older)["messages"] == 2


def test_quantised_search_finds_what_brute_force_does(spark):
    rng = np.random.default_rng(3)
    points = (rng.normal(size=(20, 1, 32)) * 2 + rng.normal(size=(20, 100, 32))).reshape(-1, 32).astype(np.float32)
    rows = spark.createDataFrame([(i, p.tolist(), i % 50) for i, p in enumerate(points)] + [(-1, None, 0), (-2, [1.0], 0)], "id long, vector array<float>, label int")
    book = Q.train(rows, 32, lists=8, parts=8, codes=64)
    index = Q.encode(rows, book).cache()
    assert index.count() == 2002 and index.where("codes IS NULL").count() == 2
    found = 0
    for q in points[::400] + 0.1:
        true = np.argsort(((points - q) ** 2).sum(1))[:10]
        found += len({int(i) for i in true} & {r.id for r in Q.search(index, book, q.tolist(), 10, probes=4, refine=8).collect()})
    assert found >= 45  # of 50: a recall of 0.9
    some = index.where("label = 7")  # 40 rows: the lists probed hold too few
    exact = sorted(range(7, 2000, 50), key=lambda i: (((points[i].astype(float) - points[0]) ** 2).sum(), i))
    assert [r.id for r in Q.search(some, book, points[0].tolist(), 40, probes=1).collect()] == exact
    with pytest.raises(ValueError):
        Q.train(rows.where("vector IS NULL"), 32, parts=8)
    assert Q.encode(rows.limit(0), book).count() == 0 and index.select(F.octet_length("codes")).first()[0] == 8


def test_quantised_search_is_exact_within_its_lists(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).cache()
    book = Q.train(rows, 64, lists=4, parts=16, codes=64)
    index = Q.encode(rows, book).cache()
    for q in rows.where("id % 400 = 0").collect():
        exact = [r.id for r in S.vector_search(rows, q.vector, 10).collect()]
        assert [r.id for r in Q.search(index, book, q.vector, 10, probes=4, refine=1).collect()] == exact
    index.unpersist()
    rows.unpersist()


def test_bounds_spare_most_rows_of_clustered_vectors(spark, tmp_path):
    rng = np.random.default_rng(11)
    points = (rng.normal(size=(40, 1, 32)) * 4 + rng.normal(size=(40, 250, 32))).reshape(-1, 32).astype(np.float32)
    points[50:70] = points[50]  # copies are told apart by id
    rows = spark.createDataFrame([(i, p.tolist(), i % 100) for i, p in enumerate(points)] + [(-1, None, 0), (-2, [float("nan")] * 32, 0)], "id long, vector array<float>, label int")
    book = Q.train(rows, 32, lists=40, parts=16, codes=32)
    Q.encode(rows, book).repartitionByRange(4, "list", "radius").sortWithinPartitions("list", "radius").write.parquet(str(tmp_path / "i"))
    index, ranked = spark.read.parquet(str(tmp_path / "i")), []
    book = book.measured(index)
    assert book.measures[:, 0].sum() == 10_000
    for q in [points[50], *(points[[700, 3333, 9001]] + 0.2), np.zeros(32, np.float32)]:
        d = np.sqrt(((points - q).astype(np.float64) ** 2).sum(1))
        exact = np.lexsort((np.arange(len(d)), d))
        assert [r.id for r in Q.search(index, book, q.tolist(), 10, probes=0).collect()] == exact[:10].tolist()
        ranked.append(Q.candidates(index, book, q.tolist(), 10, probes=0).count())
        some = [i for i in exact if i % 100 == 7][:60]  # a filter: the near lists hold too few
        assert [r.id for r in Q.search(index.where("label = 7"), book, q.tolist(), 60, probes=0).collect()] == some
    assert max(ranked[:4]) < 0.2 * len(points), ranked
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = Q.candidates(index, book, points[700].tolist(), 10, probes=0)._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(radius" in plan.split("PushedFilters")[1]  # row groups are skipped by it


def test_an_index_gives_what_a_scan_does(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/i", hashed_vectors(4), 4)
    rows = [("a", "the tide, the TIDE"), ("b", "a tide of boats"), ("c", "boats"), ("d", "no match")]
    e.ingest(spark.createDataFrame([(i, t, "crm", f"c{i}", "h" if i < "c" else "g", 5) for i, t in rows], ROW))
    found = lambda **k: [(r.id, round(r.score, 9)) for r in e.search("tide boats tide", **k).collect()]
    scanned, narrowed = found(), found(host="g")
    assert len(scanned) == 3 and [i for i, _ in narrowed] == ["c"]
    assert e.optimize(2) and not e.optimize(2, threshold=20)
    assert e.store.version("index_stats") and found() == scanned and found(host="g") == narrowed
    e.ingest(spark.createDataFrame([("z", "tide", "crm", "cz", "h", 6), ("b", "no more of it", "crm", "cb", "h", 7)], ROW))  # after the index
    late = found()
    e.store.drop("index_stats", "postings")
    assert sorted(i for i, _ in late) == ["a", "c", "z"] and late == found()
    assert e.optimize(2, prune=True) and found() == late and e.store.prune("chunks") == 0


@pytest.mark.parametrize("rare", [3, 10**6])
def test_blocks_give_the_best_of_all_postings(spark, tmp_path, rare, monkeypatch):
    from kelpline.operators import postings as I

    monkeypatch.setattr(I, "FIRST", 4)
    rng, words = random.Random(rare), [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.choice([3, 3, 20, 300]))) for _ in range(1500)]
    texts[:40] = ["w0 w1"] * 40  # ties
    rows = spark.createDataFrame([*enumerate(texts), (1500, None), (1501, "")], "id long, text string")
    n, total = I.stats(rows).first()
    I.build(rows, blocks=I.shares(n)).write.parquet(f"{tmp_path}/p")
    postings = spark.read.parquet(f"{tmp_path}/p")
    I.peaks(postings, rare).write.parquet(f"{tmp_path}/k")
    peaks, skipped = spark.read.parquet(f"{tmp_path}/k"), 0
    dfs = {r.term: r.df for r in postings.groupBy("term").agg(F.count("*").alias("df")).collect()}
    assert {r.term: r.df for r in peaks.groupBy("term").agg(F.sum("n").alias("df")).collect()} == dfs
    for query, k, even in [("w0", 10, False), ("w0 w1", 45, False), ("w3 w59 w3", 10, True), ("w40 w50", 2000, False), ("none w20", 5, True), ("none", 5, False), ("", 5, False)]:
        keep = rows.where("id % 2 = 0").select("id") if even else None
        full = I.bm25(postings, n, total / n, query).where("id % 2 = 0" if even else "true").orderBy(F.desc("score"), "id").limit(k)
        want = [(r.id, round(r.score, 9)) for r in full.collect()]
        found = I.top(postings, peaks, n, total / n, query, k, keep, direct=0)
        assert [(r.id, round(r.score, 9)) for r in found.hits.collect()] == want, query
        assert found.read <= found.blocks
        skipped += found.read < found.blocks
        assert [(r.id, round(r.score, 9)) for r in I.top(postings, peaks, n, total / n, query, k, keep).hits.collect()] == want
    assert skipped >= 2


def test_blocks_of_a_store_with_later_chunks(spark, tmp_path, monkeypatch):
    from kelpline.operators import postings as I

    monkeypatch.setattr(I, "DIRECT", 0)
    monkeypatch.setattr(I, "RARE", 2)
    e = Engine(spark, f"file://{tmp_path}/b", hashed_vectors(4), 4)
    put = lambda rows: e.ingest(spark.createDataFrame([(i, t, "crm", f"c{i}", "h", 5) for i, t in rows], ROW))
    put([("a", "the tide, the TIDE"), ("b", "a tide of boats"), ("c", "boats"), ("d", "no match"), ("e", "lone tide")])
    e.build_index()
    put([("z", "tide and new boats"), ("b", "no boat of it"), ("e", "lone"), ("y", "lone new")])
    found = lambda q: [(r.id, round(r.score, 9)) for r in e.search(q, embed=False).collect()]
    asked = ["tide boats", "new", "lone tide", "of", "unheard"]
    late = [found(q) for q in asked]
    e.store.drop("index_stats", "postings", "peaks")
    assert late == [found(q) for q in asked] and [i for i, _ in late[1]] == ["y", "z"]


def test_an_index_of_empty_and_null_texts(spark):
    from kelpline.operators import postings as I

    rows = spark.createDataFrame([("a", None), ("b", "")], "id string, text string")
    assert I.build(rows).count() == 0 and tuple(I.stats(rows).first()) == (2, 0) and tuple(I.stats(rows.limit(0)).first()) == (0, 0)
    assert I.bm25(I.build(rows), 2, 0.0, "x").count() == 0


def test_two_writers_of_one_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/w")
    rows = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "id string, v string")
    assert store.write("t", rows("a")) == 1
    old = store.version("t")
    assert store.upsert("t", rows("b")) == 2
    with pytest.raises(Conflict):
        store.write("t", rows("c"), after=old)
    commit, stolen = store._commit, []

    def late(table, v):
        if not stolen:
            stolen.append(commit(table, type(v)(v.n, v.base, (*v.deltas[:-1], store._put("t", rows("d"))), v.key)))
        return commit(table, v)

    store._commit = late
    assert store.upsert("t", rows("e")) == 4 and stolen == [3]
    assert {r.id for r in store.read("t").collect()} == {"a", "b", "d", "e"}


def test_an_upsert_writes_its_own_rows_only(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/w")
    store.write("t", spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit(0).alias("v")))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "w/t").rglob("*.parquet")}
    for i in range(1, 21):
        store.upsert("t", spark.createDataFrame([("7", i), (f"new{i}", i), (f"new{i}", i)], "id string, v int"))
    assert {p: p.stat().st_mtime_ns for p in before} == before and len(store.version("t").deltas) <= 8
    got = {r.id: r.v for r in store.read("t").collect()}
    assert len(got) == 1020 == store.read("t").count() and got["7"] == 20 and got["new3"] == 3 and got["8"] == 0
    assert store.read("t", 2).count() == 1001 and store.read("t", 99) is None and store.since("t", 1).count() == 21
    store.optimize("t", 2, "id")
    assert store.version("t").deltas == () and store.read("t").count() == 1020 and store.since("t", 1) is None
    assert store.prune("t") == 21 and store.read("t", 1) is None and store.read("t").count() == 1020
    store.drop("t", "none")
    assert store.read("t") is None


def test_upserts_are_merged_by_tiers(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/w")
    put = lambda i: store.upsert("t", spark.createDataFrame([(f"{i}-{j}", i) for j in range(10)] + [("same", i), ("same", i)], "id string, v int").coalesce(1))
    at = [put(i) for i in range(1, 41)]
    written = sum(pq.read_metadata(p).num_rows for p in (tmp_path / "w/t").rglob("*.parquet"))
    assert written <= 2 * 40 * 11 and store.version("t").counts == (8, 8, 8, 8, 1, 1, 1, 1, 1, 1, 1)
    assert store.read("t").count() == 401 and store.read("t").where("id = 'same'").collect() == [("same", 40)]
    for n in (at[0], at[5], at[20], at[38]):  # at least what came after, as it is now
        rows = {r.id: r.v for r in store.since("t", n).collect()}
        assert {f"{i}-{j}" for i in range(n + 1, 41) for j in range(10)} <= set(rows) and rows["same"] == 40
    assert store.since("t", at[39]).count() == 0


def test_vector_index_is_built_used_and_dropped(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/v", hashed_vectors(8), 8)
    rows = [(f"i{i}", f"boat {i % 7} tide {i}", "crm", f"c{i % 5}", "h", i + 1) for i in range(200)]
    e.ingest(spark.createDataFrame(rows, ROW))
    found = lambda **k: [(r.id, round(r.score, 6)) for r in e.search("boat 3", embed=True, limit=9, **k).collect()]
    exact, few = found(), found(container_id="c1")
    e.create_vector_index(codes=16)
    assert found() == exact == found(exact=True) and found(container_id="c1") == few
    e.create_vector_index()
    assert len(e._only("vector_index").parts) == 8
    e.ingest(spark.createDataFrame([("late", "boat 3", "crm", "c9", "h", 999)], ROW))
    own = hashed_vectors(8)(['CRM notes on "c9"\nboat 3'])[0]
    near = lambda: {r.id for r in e.search(vector=own).collect()}
    assert "late" in near() and "late" in {r.id for r in e.search("boat 3").collect()} and found() == found(exact=True)
    assert e.optimize(2) and found() == found(exact=True)
    e.drop_vector_index()
    e.drop_vector_index()
    assert e._only("vector_index") is None and "late" in near()
    e.warm()


def test_english_words_are_found_by_their_stems(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/v", hashed_vectors(8), 8, english=True)
    rows = [("a", "the ships were sailing", "crm", "c1", "h", 1), ("b", "a sailor of the shipment", "crm", "c2", "h", 2), ("c", "of the and", "crm", "c3", "h", 3)]
    e.ingest(spark.createDataFrame(rows, ROW))
    found = lambda q: [(r.id, round(r.score, 6)) for r in e.search(q, embed=False).collect()]
    scan = found("The sails of a ship"), found("of the")
    assert [i for i, _ in scan[0]] == ["a"] and scan[1] == []
    e.build_index()
    assert (found("The sails of a ship"), found("of the")) == scan
    asked = spark.createDataFrame([("q", "The sails of a ship", None)], "query_id string, text string, vector array<float>")
    assert [(r.id, round(r.score, 6)) for r in e.search_many(asked).collect()] == scan[0]
    e.ingest(spark.createDataFrame([("late", "shipping sails", "crm", "c9", "h", 9)], ROW))
    assert {i for i, _ in found("ship")} == {"a", "late"}
    plain = Engine(spark, f"file://{tmp_path}/v", None, 8)  # does not use that index
    assert [r.id for r in plain.search("ship", embed=False).collect()] == [] and {r.id for r in plain.search("of", embed=False).collect()} >= {"b", "c"}


def test_callers_of_this_host():
    assert Fed.from_this_host("127.0.0.1:80") and Fed.from_this_host("[::1]:80") and Fed.from_this_host("nowhere") and Fed.from_this_host("8.8.8.8")
    assert not Fed.from_this_host("192.0.2.77:80")


def test_a_limit_of_a_sync_leaves_cut_files(spark, tmp_path):
    for name, ids in (("a", (1, 2)), ("b", (3, 4))):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{name}.jsonl").write_text("".join(map(_line, ids)))
    e = Engine(spark, f"file://{tmp_path}/st", hashed_vectors(4), 4)
    sync = lambda n: e.sync(f"file://{tmp_path}/in", "pi", "h", limit=n)["accepted"]
    assert sync(3) == 3 and {r.path.rsplit("/", 1)[1] for r in e.store.read("cursor").collect()} == {"a.jsonl"}
    assert sync(3) == 1 and e.store.read("cursor").count() == 2 and e.store.read("messages").count() == 4
