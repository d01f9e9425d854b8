"""Class model, filter audit and resampling against plain definitions."""

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import permutations
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.llm import class_model, filter_audit, oracles, queries, resample
from kelpline.llm.common import WORD_RE

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "one", "one", " \n\t ", "É é ÉCOLE École", "A B C d#", "x y " * 300, "red green blue " * 40, "RED Green " * 60, "a" * 70_000 + " b", "long word " * 9_000]


def docs_of(spark, texts, extra=()):
    rows = [(i, t, f"s{i % 2}" if i % 3 else None) for i, t in enumerate(texts)] + list(extra)
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def rows_of(df, *cols):
    return sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))


def same_as_sql(got, sql, **tables):
    c = duckdb.connect()
    for name, t in tables.items():
        c.register(name, t.toPandas().convert_dtypes())
    cols = sorted(got.columns)
    assert rows_of(got, *cols) == sorted(map(repr, c.sql(f"select {', '.join(cols)} from ({sql})").fetchall()))


def test_audit_edges_against_sql(spark):
    docs = docs_of(spark, TEXTS, [(None, "one", "s1"), (5, "one", "s1"), (5, "one", "s1"), (3, "one", "s0")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (2, 1, 0), (None, 1, 1), (6, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit_filters(docs.withColumn("n_words", F.lit("x")).withColumn("mask", F.lit(1)), labels)
    assert got.count() == 600 * 3  # s0, s1 and the rows without a source
    same_as_sql(got, oracles.filter_audit(), documents=docs, labels=labels)
    assert filter_audit.audit_filters(docs.limit(0), labels).count() == 0
    assert filter_audit.audit_filters(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_word_counts_with_colliding_hashes(spark, monkeypatch):
    rng = random.Random(3)
    texts = [*TEXTS, *[" ".join(rng.choices("a b ab ba abc É éa longer-than-eight-bytes longer-than-eight-bytez".split(), k=rng.randrange(80))) + "\x0b\x85" for _ in range(300)]]
    want = [(len(w := (t or "").encode().split()), len(set(w)), sum("A" <= c <= "Z" for c in t or ""), sum(c in "#$%&*|" for c in t or ""), len(t or "")) for t in texts]
    data = np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8)
    bounds = np.cumsum([0] + [len((t or "").encode()) for t in texts])
    count = lambda: list(zip(*[filter_audit.scan(data, bounds)[c].tolist() for c in filter_audit.COUNTS]))
    assert count() == want
    monkeypatch.setattr(filter_audit, "_power_tables", lambda n: (np.zeros(n, np.uint64), np.zeros(n, np.uint64)))  # all words share one hash
    assert count() == want
    monkeypatch.undo()
    monkeypatch.setattr(filter_audit, "BLOCK", 64)
    got = filter_audit.count_texts(docs_of(spark, texts)).orderBy("doc_id").select(*filter_audit.COUNTS).collect()
    assert [tuple(r) for r in got] == want


def test_audit_of_other_filters_by_definition(spark):
    rng = random.Random(5)
    rows = [(i, "p%d" % (i % 2), rng.randrange(8)) for i in range(200)]
    labels = [(i, i % 3 == 0, i % 5 == 0) for i in range(150)]
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(spark.createDataFrame(rows, "doc_id long, part string, mask int"), spark.createDataFrame([(i, int(a), int(b)) for i, a, b in labels], "doc_id long, quality int, toxic int"), "XYZ").collect()}
    assert len(got) == 2 * 6 * 3
    whole = Counter()
    for part in ("p0", "p1"):
        for order in permutations("XYZ"):
            left = {i: m for i, p, m in rows if p == part}
            for step, f in enumerate(order, 1):
                bit = 1 << "XYZ".index(f)
                gone = [i for i, m in left.items() if m & bit]
                r = got[part, "".join(order), step]
                assert r.removed == len(gone) and r.redundant == sum(bool(m & bit) for _, p, m in rows if p == part) - len(gone)
                assert r.unique_fails == sum(m == bit for _, p, m in rows if p == part)
                assert r.good_lost == sum(labels[i][1] for i in gone if i < 150) and r.toxic_lost == sum(labels[i][2] for i in gone if i < 150)
                whole[part, f] += len(gone)
                left = {i: m for i, m in left.items() if not m & bit}
                assert r.kept == len(left)
    assert all(r.shapley == whole[p, o[s - 1]] for (p, o, s), r in got.items())


def plain_words(text):
    import re

    return re.findall(WORD_RE, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_resample(docs, target, n, buckets, percent, least):
    grams = lambda t: [" ".join(w[i : i + k]) for k in range(1, n + 1) for w in [plain_words(t)] for i in range(len(w) - k + 1)]
    of = lambda t: [zlib.crc32(g.encode()) % buckets for g in grams(t)]
    s, t = Counter(b for _, x in docs for b in of(x)), Counter(b for x in target for b in of(x))
    total, wanted = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in range(buckets)}
    out = []
    for i, x in docs:
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in of(x))
        out.append((i, len(of(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(x))))
    may = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    drawn = {id(r): k for k, r in enumerate(may[: len(may) * percent // 100], 1)}
    return sorted(map(repr, [(*r[:4], drawn.get(id(r))) for r in out]))


@pytest.mark.parametrize("n, size", [(1, 1 << 16), (3, 1 << 16), (3, 5), (2, 1)])
def test_resampling_against_plain_definitions(spark, monkeypatch, n, size):
    monkeypatch.setattr(resample, "CHUNK", size)
    monkeypatch.setattr(resample.chunks, "__defaults__", (size,))
    rng = random.Random(n)
    some = "red Green blue É1 x-y , . moss été 日本".split()
    texts = [*[t for t in TEXTS if size > 5 or len(t or "") < 3_000], *[" ".join(rng.choices(some, k=rng.randrange(60))) for _ in range(200)]]
    docs = docs_of(spark, texts, [(None, "red green " * 20, "s"), (7, "red green " * 20, "s"), (7, "blue " * 30, "s")])
    target = spark.createDataFrame([(1, "red green blue moss"), (2, None), (3, "")], "item_id long, text string")
    got = resample.resample(docs.withColumn("weight", F.lit("x")).withColumn("__row", F.lit(2)), target, n=n, buckets=50, seed=7, percent=30, min_words=5)
    assert "__row" in got.columns and "text" not in got.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(got, "doc_id", "n_features", "weight", "score", "rank") == plain_resample(rows, ["red green blue moss", None, ""], n, 50, 30, 5)


def test_resampling_edges(spark):
    docs, target = docs_of(spark, TEXTS), spark.createDataFrame([(1, "red one")], "item_id long, text string")
    assert resample.resample(docs.limit(0), target).count() == 0
    assert resample.resample(docs, target.limit(0), min_words=1).where("rank is not null").count() == sum(bool(plain_words(t)) for t in TEXTS) * 10 // 100
    same_as_sql(resample.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank"), oracles.resample(), documents=docs, benchmark=target)


def plain_scores(rows, classes, learned):
    """Scores by definition, from the classes that the operator has learned."""
    toks = [(t or "").encode().lower().split() + [b""] for _, t in rows]
    count = Counter(w for ws, l in zip(toks, learned) if l for w in ws)
    known, distinct = sum(count.values()), len(count)
    base = [sum(math.log10((count[w] + 1) / (known + distinct + 1)) for w in ws) for ws in toks]
    if not count:
        return base, [0.0] * len(toks), count, None
    n1, n2 = sum(c == 1 for c in count.values()), sum(c == 2 for c in count.values())
    d = n1 / (n1 + 2 * n2) if n1 else 0.5
    of, kinds = Counter(), Counter()
    for w, c in count.items():
        of[classes[w]] += c
        kinds[classes[w]] += 1
    end, unk = classes[b""], "unknown"
    moves = Counter()
    for ws, l in zip(toks, learned):
        for a, b in zip([b"", *ws], ws):
            if l:
                moves[classes[a], classes[b]] += 1
                if count[a] == 1:
                    moves[unk, classes[b]] += 1

    def p(before, word):
        ctx = classes[before] if count[before] else unk
        after = {c: moves[ctx, c] for c in of}
        total, several = sum(after.values()), sum(x > 0 for x in after.values())
        move = lambda c: (after[c] + several * of[c] / known) / (total + several) if total else of[c] / known
        if not count[word]:
            return sum(move(c) * d * kinds[c] / of[c] for c in of if c != end)
        return move(classes[word]) * (1.0 if word == b"" else (count[word] - d) / of[classes[word]])

    return base, [sum(math.log10(p(a, b)) for a, b in zip([b"", *ws], ws)) for ws in toks], count, p


def class_texts():
    rng = random.Random(4)
    subject, verb, thing = [f"s{i}a" for i in range(30)], [f"v{i}o" for i in range(30)], [f"t{i}e" for i in range(30)]
    return [*TEXTS, *[" ".join(w for _ in range(rng.randrange(12)) for w in (rng.choice(subject), rng.choice(verb), rng.choice(thing))) for _ in range(120)]]


@pytest.mark.parametrize("batch, piece", [(3_000_000, 1 << 20), (400, 50)])
def test_class_model_by_definition(spark, monkeypatch, batch, piece):
    monkeypatch.setattr(class_model.pieces_of, "__defaults__", (piece,))
    docs = docs_of(spark, [t for t in class_texts() if len(t or "") < 5_000], [(None, "s1a v1o new", "s"), (1, "s1a v1o t1e", "s"), (1, "s1a v1o t1e", "s")]).coalesce(2)
    monkeypatch.setattr(class_model, "BATCH", batch)
    learn = class_model.learned_from(F.col("doc_id"))
    encoded, _ = class_model.encode(docs, learn)
    classes = {bytes(r.word): r.cls for r in class_model.cluster(encoded, 6, 3).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    learned = [zlib.crc32(str("" if i is None else i).encode()) % 7 != 2 for i, _ in rows]
    base, score, count, p = plain_scores(rows, classes, learned)
    got = class_model.score_texts(docs.withColumn("score", F.lit("x")).withColumn("rest", F.lit(1)), learn, classes=6, rounds=3).orderBy("doc_id", "n_tokens", "text").collect()
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, len((rows[k][1] or "").encode().split()), rows[k][1] or ""))
    for k, r in zip(order, got, strict=True):
        ws = (rows[k][1] or "").encode().lower().split() + [b""]
        assert (r.doc_id, r.learned, r.n_tokens, r.n_known, r.train_tokens) == (rows[k][0], learned[k], len(ws), sum(count[w] > 0 for w in ws), sum(count.values()))
        assert r.base_score == pytest.approx(base[k], abs=1e-8) and r.score == pytest.approx(score[k], abs=1e-8)
    for before in (b"", b"s1a", b"never"):  # all known words and one unknown
        assert sum(p(before, w) for w in [*count, b"never"]) == pytest.approx(1)


def test_exchange_raises_the_likelihood_and_finds_classes(spark):
    docs = docs_of(spark, class_texts()[len(TEXTS) :])
    encoded, _ = class_model.encode(docs, F.lit(True))
    toks = [(r.text or "").encode().lower().split() + [b""] for r in docs.collect()]

    def likelihood(classes):
        pairs, before = Counter(), Counter()
        for ws in toks:
            for a, b in zip([b"", *ws], ws):
                pairs[class_model.context_of(a), classes[b]] += 1
                before[classes[b]] += 1
        return sum(n * math.log(n) for n in pairs.values()) - sum(n * math.log(n) for n in before.values())

    found = [likelihood({bytes(r.word): r.cls for r in class_model.cluster(encoded, 4, k).collect()}) for k in (0, 1, 4)]
    assert found[0] < found[1] <= found[2]
    classes = {bytes(r.word): r.cls for r in class_model.cluster(encoded, 4, 4).collect()}
    kinds = [Counter(w[:1] for w, c in classes.items() if c == k) for k in range(4)]  # one kind may take two of the four classes
    assert sum(max(k.values(), default=0) for k in kinds) >= 0.9 * (len(classes) - 1)


def test_class_model_edges(spark):
    docs = docs_of(spark, TEXTS)
    assert class_model.score_texts(docs.limit(0), F.lit(True)).count() == 0
    none = class_model.score_texts(docs, F.lit(False)).collect()
    assert len(none) == len(TEXTS) and all(r.score == r.base_score == r.n_known == r.train_tokens == 0 for r in none)


def test_class_model_beats_unigrams_on_held_out_texts(spark):
    rows = queries.queries()["op11_class_model"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > 0.9 * rows[1]


def test_statistics_against_sql(spark):
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    for name in ("op12_filter_audit", "op13_resample"):
        df = queries.queries()[name](spark, SF)
        cols = sorted(df.columns)
        assert rows_of(df, *cols) == sorted(map(repr, c.sql(f"select {', '.join(cols)} from ({queries.oracle_sql()[name]})").fetchall()))
