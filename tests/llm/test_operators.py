import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kelpline.llm import components, decontaminate, license_texts, licenses, line_dedup, ngram_join, oracles, pieces, quality, queries, token_files, toxicity, transport_stream, url_filter

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "red green blue amber violet teal olive mauve coral ochre slate ivory pearl rust sand moss".split()
TEXTS = [None, "", "one", "one", " \n\n", "É é ÉCOLE École", "the mit license holds", "a" * 30_000, "x y " * 5_000]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOC)


def rows_of(df, *cols):
    return sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(f"select {', '.join(cols)} from ({queries.oracle_sql()[name]})").fetchall()
    assert rows_of(df, *cols) == sorted(map(repr, want))


@pytest.mark.parametrize("name, arg", [("decontaminate", None), ("line_dedup", None), ("licenses", None)])
def test_edge_texts_against_sql(spark, name, arg):
    texts = [*TEXTS, "red green blue " * 9, "Red, GREEN blue\nred", *["shared line\nown %d" % i for i in range(12)], "MIT License mit license", "licensed under the apache license version 2 0"]
    docs = docs_of(spark, texts)
    bench = spark.createDataFrame([(1, "red green blue red green blue red green blue red green"), (1, "one"), (2, "École"), (3, None), (None, "one"), (4, "...")], "item_id long, text string")
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    c.register("benchmark", bench.toPandas().astype({"item_id": "Int64"}))
    if name == "decontaminate":
        got = decontaminate.decontaminate(docs.withColumn("pos", F.lit(1)).withColumn("__key", F.lit(2)), bench).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
        sql = oracles.decontaminate()
    elif name == "licenses":
        got, sql = licenses.scan_licenses(docs.withColumn("score", F.lit("x"))).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"), oracles.licenses()
    else:
        got = line_dedup.split_lines(docs.withColumn("line", F.lit(1))).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
        sql = oracles.line_dedup()
    cols = sorted(got.columns)
    assert rows_of(got, *cols) == sorted(map(repr, c.sql(f"select {', '.join(cols)} from ({sql})").fetchall()))


def test_notices_spread_over_a_block_are_found_at_every_offset(spark):
    words = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files".split()
    texts = []
    for width in (34, 40, 52, 64):
        gaps = [(width - len(words)) * i // (len(words) - 1) for i in range(len(words))]
        for before in range(64):
            notice = ["pad"] * width
            for i, w in enumerate(words):
                notice[i + gaps[i]] = w
            texts.append(" ".join(["red"] * before + notice + ["blue"] * 40))
    far = " ".join(w + " pad pad pad" for w in words)  # 0.9 of its words never share a block
    got = licenses.scan_licenses(docs_of(spark, [*texts, far])).select("doc_id", "labels", "score").orderBy("doc_id").collect()
    assert [(r.labels, r.score) for r in got] == [("mit", 1.0)] * len(texts) + [("", 0.0)]


def test_whole_licences_are_found_spread_and_without_their_opening(spark):
    texts, want = [], []
    for (label, text), (_, n, _) in zip(license_texts.TEXTS, licenses.TEMPLATES[-len(license_texts.TEXTS) :]):
        words = licenses._words(text)
        assert len(words) == n
        spread = [x for i, w in enumerate(words) for x in ((w, "pad") if i % 3 == 0 else (w,))]
        late = words[len(words) // 20 :]  # without its first words
        for body in (words, spread, late):
            texts.append(" ".join(["red"] * 50 + body + ["blue"] * 300))
            want.append(label)
    texts.append(" ".join(w + " pad" * 3 for w in licenses._words(license_texts.TEXTS[0][1])))  # no block holds it
    want.append("")
    texts.append("permission software notice " * 20_000)  # many prefix tokens in one text
    want.append("")
    got = licenses.scan_licenses(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [r.labels if w not in r.labels.split(",") else w for r, w in zip(got, want)] == want


def test_empty_tables(spark):
    docs, bench = docs_of(spark, ["a b"]).limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = [
        decontaminate.decontaminate(docs, bench), decontaminate.keep_clean(docs, bench), line_dedup.dedup_lines(docs), ngram_join.join_near(docs), ngram_join.keep_one(docs), licenses.scan_licenses(docs),
        toxicity.score_toxicity(docs, toxicity.fit(docs, labels)), quality.classify(docs, labels), pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model")),
        transport_stream.read_media(transport_stream.store_media(docs)), url_filter.filter_urls(docs, url="text"),
    ]
    assert [d.count() for d in out] == [0] * len(out)
    assert token_files.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json")) == []
    assert not decontaminate.decontaminate(docs_of(spark, ["a"]), bench.limit(0)).first().contaminated


def test_clean_rows_and_columns_stay(spark):
    docs = docs_of(spark, [None, "", "red green", "keep me"])
    bench = spark.createDataFrame([(1, "red green")], "item_id long, text string")
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and rows_of(kept, "doc_id") == ["(0,)", "(1,)", "(3,)"]
    out = line_dedup.dedup_lines(docs_of(spark, ["Hi \nx%d" % i for i in range(10)]))
    assert out.columns == docs.columns and {(r.text, r.n_chars) for r in out.collect()} == {(f"x{i}", 2) for i in range(10)}


def brute_classes(texts, threshold=0.8):
    sets = []
    for t in texts:
        w = ngram_join.words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else None)
    parent, links = list(range(len(texts))), Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        same = (texts[i] or "") == (texts[j] or "")
        if same or (a and b and len(a & b) >= threshold * len(a | b)):
            links[i] += 1
            links[j] += 1
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return [(i, root(i), links[i]) for i in range(len(texts))]


def near_texts(seed=3, n=60):
    rng = random.Random(seed)
    base = [rng.choices(WORDS, k=rng.randrange(3, 120)) for _ in range(8)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append(" ".join(w) if rng.random() < 0.8 else ", ".join(w).upper())
    return [*out, *TEXTS]


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    texts = near_texts()
    want = brute_classes(texts)
    got = ngram_join.join_near(docs_of(spark, texts))
    assert rows_of(got, "doc_id", "class_id", "n_links") == sorted(map(repr, want))
    monkeypatch.setattr(ngram_join, "BLOCK", 5)  # crowded nodes and several blocks, the same result
    assert rows_of(ngram_join.join_near(docs_of(spark, texts)), "doc_id", "class_id", "n_links") == sorted(map(repr, want))
    kept = ngram_join.keep_one(docs_of(spark, texts).unionByName(docs_of(spark, texts)))
    assert rows_of(kept, "doc_id") == sorted(repr((c,)) for c in {c for _, c, _ in want})


def test_prefixes_are_shortened_to_the_recall():
    assert ngram_join.floor_length(0.8, 32, 0.5) > ngram_join.floor_length(0.8, 32, 0.999999) >= 1
    for trees in (32, 36, 40, 64):
        floor, spared = ngram_join.floor_length(0.8, trees, 1 - 1e-7, 8), ngram_join.spared_trees(0.8, trees, 1 - 1e-7, 8)
        missed = (1 - 0.8**8) ** (2 * spared) * (1 - 0.8**floor) ** (trees - 2 * spared)  # both texts of a pair spare other trees
        assert missed <= 1e-7 and 2 * spared < trees


def test_matched_prefixes_of_sorted_labels():
    rng = random.Random(4)
    for _ in range(50):
        rows = sorted(bytes([rng.randrange(2), *rng.choices([0, 0, 1], k=8)]) for _ in range(rng.randrange(1, 60)))
        common = lambda a, b: next((n for n in range(4) if a[2 * n + 1 : 2 * n + 3] != b[2 * n + 1 : 2 * n + 3]), 4) if a[0] == b[0] else 0
        want = [i for i, x in enumerate(rows) if i in (0, len(rows) - 1) or max(common(rows[i - 1], x), common(x, rows[i + 1])) >= 3]
        whole = pa.record_batch({"label": pa.array(rows, pa.binary()), "id": pa.array(range(len(rows)), pa.int64())})
        parts, at = [], 0
        while at < len(rows):
            n = rng.randrange(0, 9)
            parts.append(whole.slice(at, n))
            at += n
        assert [i for b in ngram_join._matched(3, 4)(iter(parts)) for i in b.column("id").to_pylist()] == want


def test_near_duplicates_of_a_whole_table(spark):
    """All pairs of sf0.01's different texts, by an index of their shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets, holders = {}, {}
    for i, t in rows:
        w = ngram_join.words_of(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
        for x in sets[i]:
            holders.setdefault(x, []).append(i)
    both = Counter(p for ids in holders.values() if len(ids) > 1 for p in combinations(sorted(ids), 2))
    links = Counter(i for (a, b), n in both.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) for i in (a, b))
    empty = Counter(t or "" for i, t in rows if not sets[i])
    got = {r.doc_id: r.n_links for r in ngram_join.join_near(docs).collect()}
    assert got == {i: links[i] if sets[i] else empty[t or ""] - 1 for i, t in rows} and sum(links.values()) > 50


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 45), (60, 60), (7, 3)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 1 for i in range(1, 31)} | {40: 40, 45: 40, 50: 40}


def test_toxicity_patterns_and_held_out_accuracy(spark):
    g = toxicity.Grammar()
    e = lambda t: {p for p, x in g.evidence(t).items() if x}
    assert e("What a moron.") == {"plain"} and e("You are a moron") == {"targeted"} and e("It is not stupid") == {"negated"}
    assert e("She said that the idiot left") == {"reported"} and e("I will hurt you") == {"threat"} and e("Fire will burn wood. You too") == set()
    assert g.score(None) == g.score("") == g.score("a fine day") == 0 and g.score("you moron. you idiot. scum!") > 0.5
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_toxicity(docs.withColumn("score", F.lit("old")), toxicity.fit(docs, labels)).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    n, right = scored.agg(F.count("*"), F.count_if(F.col("predicted") == F.col("toxic"))).first()
    assert right / n > 0.95


def test_quality_against_plain_kneser_ney(spark):
    texts = ["the cat sat on the mat", "a cat and a dog", "the dog sat", "on a mat a cat", "das Haus am See"] * 3
    model = quality.Model(*quality.train(docs_of(spark, texts).select("text")))
    n = quality.ORDER
    pad = ["\1" * (n - 1) + t for t in texts]
    grams = {k: Counter(p[i - k + 1 : i + 1] for p in pad for i in range(n - 1, len(p))) for k in range(1, n + 1)}
    count = {n: grams[n]} | {k: Counter(g[1:] for g in grams[k + 1]) for k in range(1, n)}

    def discount(k, c):
        of = Counter(count[k].values())
        n1, n2, n3, n4 = (max(1, of[i]) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3][min(c, 3) - 1]
        return min(min(c, 3) - 0.05, max(0.1, d))

    def p(g):
        if not g:
            return 1 / (len(count[1]) + 1)
        k, lower = len(g), p(g[1:])
        own = {x: c for x, c in count[k].items() if x[:-1] == g[:-1]}
        z = sum(own.values())
        if not z:
            return lower
        c = own.get(g, 0)
        return (c - discount(k, c) if c else 0) / z + sum(discount(k, x) for x in own.values()) / z * lower

    for t in ["the cat", "dog mat", "zebra", "am"]:
        q = "\1" * (n - 1) + t
        want = sum(np.log(p(q[i - n + 1 : i + 1])) for i in range(n - 1, len(q)))
        assert model.log_probability([None, t, ""])[1] == pytest.approx(want, rel=1e-4)
    docs = docs_of(spark, [*texts, "%%% ### $$$ &&&" * 5, None])
    labels = spark.createDataFrame([(i, 1) for i in range(len(texts))], "doc_id long, quality int")
    keep = {r.doc_id: r.keep for r in quality.classify(docs, labels).collect()}
    assert not keep[len(texts)] and not keep[len(texts) + 1] and sum(keep.values()) >= len(texts) - 1


def test_quality_tells_fifth_characters_by_four_before(spark):
    seen, mixed = quality.Model(*quality.train(docs_of(spark, ["abcde", "xbcdf"] * 20).select("text"))).log_probability(["abcde", "abcdf"])
    assert seen > mixed + 1  # after bcd alone, e and f are as likely


def test_url_rules(spark):
    urls = ["http://A.Example.org/es/1?x", "https://example.org/en/12#t", "https://example.org/fr", "http://badorg/x", "http://x.com/de/", "http://x.com/it", "http://spam-farm.example.net/", None, "nothing", "http://org", "http://x.org?y/"]
    out = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame([(u,) for u in urls], "url string").coalesce(1)).collect()]
    assert out[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and out[1][2:] == ("example.org/en/1", "block") and out[2][2:] == ("org/", "allow")
    assert out[3][2:] == (None, "allow") and out[4][2:] == ("com/de/", "block") and out[5][2:] == (None, "allow") and out[6][3] == "block"
    assert out[7] == out[8] == ("", "", None, "allow") and out[9][2:] == (None, "allow") and out[10] == ("x.org", "", None, "allow")


def test_url_rules_fit_hosts_with_new_lines(spark):
    urls = ["http://x\n.example.org/es/1", "http://a\nb.org/", "http://\n.x.it/", "http://a\n.spam-farm.it", "http://ex\nample.org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict").orderBy("page_id").collect()
    assert [r.rule for r in got] == ["example.org/es/", "org/", None, None, "org/"]
    assert [r.verdict for r in got] == ["block", "allow", "allow", "block", "allow"]
    c = duckdb.connect()
    c.register("pages", pages.toPandas())
    assert [tuple(r) for r in got] == c.sql(f"select page_id, host, path, rule, verdict from ({oracles.url_filter()}) order by page_id").fetchall()


def test_digest_collisions_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: len(s))
    url_filter.DigestArray.write(f"{tmp_path}/t", [("aa", 1), ("bb", 0), ("c", 1)])
    assert url_filter.DigestArray(f"{tmp_path}/t").find(["bb", "aa", "zz", "c", ""]).tolist() == [0, 1, -1, 1, -1]


def test_token_files_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*TEXTS, "<|endoftext|> a", "<|startoftext|>x", "It's 12 naïve cafés!", "á  b", *near_texts(5)]
    docs = docs_of(spark, texts)
    written = token_files.write_tokens(docs, path, files=3, length=16)
    want, start = [], 0
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows_of(token_files.read_tokens(spark, written), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(map(repr, want))
    flat = [i for x in texts for i in (*t.encode(x or "", add_special_tokens=False).ids, 2)]
    for _, file, n in written:
        f = token_files.TokenFile(file)
        got = [f.ids(i) for i in range(f.rows)]
        assert f.rows == -(-n // 16) and sum(f.mask(i).true_count for i in range(f.rows)) == n and not got[0].flags.owndata
        assert np.concatenate(got)[:n].tolist() == flat[:n]
        flat = flat[n:]
    with pytest.raises(IndexError):
        f.ids(f.rows)
    assert not flat and token_files.read_tokens(spark, []).count() == 0


def test_token_files_are_bounded_and_ties_have_an_order(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"word {i} of it" for i in range(40)]
    docs = spark.createDataFrame([(5, t, "x") for t in texts] + [(None, "first", "x")], "doc_id long, text string, length string")
    rows = lambda: [(r.doc_id, r.start, r.ids_crc32) for r in token_files.read_tokens(spark, token_files.write_tokens(docs, path, files=2, length=8)).orderBy("start").collect()]
    once = rows()
    assert len(once) == 41 and once[0][:2] == (None, 0) and rows() == once
    docs = docs.repartition(7)
    assert rows() == once
    monkeypatch.setattr(token_files, "FILE_IDS", 1)
    docs = spark.createDataFrame([(i, "a b", "x") for i in range(1200)], "doc_id long, text string, length string")
    written = token_files.write_tokens(docs, path, files=1)
    assert len(written) == 3 and token_files.read_tokens(spark, written).agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == sum(n for _, _, n in written)


def test_words_of_plain_texts_are_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, t, rng = token_files.PartTokenizer(path), Tokenizer.from_file(path), random.Random(6)
    some = "The the ÉCOLE é3 4a5 ...x! ¿ ' it's ß Ö 日本 \t \n x" .split(" ")
    texts = ["".join(rng.choices([*some, " ", " "], k=rng.randrange(30))) for _ in range(1500)] + ["a" * 5000, "é" * 50]
    for _ in range(2):  # the second time from memory
        got = tok.encode(texts)
        assert [np.frombuffer(b, tok.kind).tolist() for b in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert max(map(len, tok.cache)) <= token_files.CACHED_LENGTH and len(tok.cache) <= token_files.CACHE


def test_pieces_equal_the_library(spark):
    m = pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(1)
    some = [m.text[i] for i in rng.sample(sorted(m.text), 3000)]
    texts = [*[t or "" for t in TEXTS], *[" " * k for k in range(40)], "▁ ▁a", "a\n b\n", "<s> <0x41>", "日本 ☃😀", *["".join(rng.choices(some, k=rng.randrange(1, 9))) for _ in range(2000)], *["".join(rng.choices("ae t\n1é▁x", k=30)) for _ in range(2000)]]
    assert [np.frombuffer(m.encode(t), "<u4").tolist() for t in texts] == m.library.encode(texts, add_bos=True, add_eos=True)
    out = pieces.encode_pieces(docs_of(spark, ["ab c", None]).withColumn("ids", F.lit(1)), public_tokenizers.path("piece_bpe_32k.model")).orderBy("doc_id").collect()
    assert out[0].decoded == "ab c" and out[1].decoded == "" and out[1].n_tokens == 2
    assert out[0].ids_sha256 == hashlib.sha256(np.array(m.library.encode("ab c", add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest()


def test_streams_round_trip_and_catch_damage(spark):
    rng = random.Random(2)
    for n in [0, 1, 63, 64, 65, 170, 190, 16_384, 16_400, 50_000]:
        payload, size = transport_stream.pad("é" * (n // 2) + "a" * (n % 2))
        assert size == n and len(payload) % 64 == 0 and transport_stream.demux(transport_stream.mux(payload)).payload == payload
    m = transport_stream.mux(rng.randbytes(64 * 600))
    s = transport_stream.demux(m)
    assert s.stamps == [i * 16_384 * 90_000 // 8_000 for i in range(3)] and len(s.points) == 3
    # a cut end, a lost and a repeated packet, a table with a wrong sum, nothing at all, no association table, a part of a packet
    for bad in (m[:-188], m[: 188 * 9] + m[188 * 10 :], m + m[-188:], m[:12] + b"\7" + m[13:], b"", m[188:], m[:-1]):
        with pytest.raises(ValueError):
            transport_stream.demux(bad)
    out = transport_stream.read_media(transport_stream.store_media(docs_of(spark, ["a", "a", None]))).orderBy("doc_id").collect()
    assert out[0].media_sha256 == out[1].media_sha256 and out[2].n_bytes == 0 and out[2].payload_bytes == 64
    assert out[0].payload_sha256 == hashlib.sha256(b"a" + b"\0" * 63).hexdigest()


def test_pipeline_stages(spark):
    """Each stage against plain definitions on its own input."""
    docs, want = spark.read.parquet(f"{SF}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas().sort_values("doc_id")
        out = stage(spark, docs, SF)
        docs = spark.createDataFrame(out.toPandas(), out.schema)
        after = docs.toPandas().sort_values("doc_id")
        ids, kept = before.doc_id.tolist(), set(after.doc_id)
        if name == "toxicity":
            texts = dict(zip(ids, before.text))
            assert all(texts[i] == t for i, t in zip(after.doc_id, after.text))
        if name == "line_dedup":
            assert kept == set(ids)
            cut = [(t or "").split("\n") for t in before.text]
            key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))
            shared = Counter(k for lines in cut for k in {key(x) for x in lines})
            assert after.text.tolist() == ["\n".join(x for x in lines if not key(x) or shared[key(x)] < 10) for lines in cut]
        if name == "near_duplicates":
            want = {ids[c] for _, c, _ in brute_classes(before.text.tolist())}
            assert kept == want
        if name == "decontaminate":
            bench = [ngram_join.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            windows = {tuple(w[i : i + min(10, len(w))]) for w in bench for i in range(len(w) - min(10, len(w)) + 1)}
            words = {i: ngram_join.words_of(t) for i, t in zip(ids, before.text)}
            assert kept == {i for i, w in words.items() if not any(tuple(w[j : j + n]) in windows for n in {len(x) for x in windows} for j in range(len(w) - n + 1))}
        if name == "encode":
            lib = pieces.model(public_tokenizers.path(corpus_pipeline.PIECE_MODEL)).library
            assert after.n_tokens.tolist() == [len(x) for x in lib.encode(after.text.tolist(), add_bos=True, add_eos=True)]
        else:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert pa.__version__ and want


def test_the_toxicity_stage_by_the_labels(spark):
    """A floor only. Measured on these thousand documents: 33 of 51 toxic ones found, no clean one of 348 lost; so few labels teach the grammar too little (README)."""
    sf = SF.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").toxic
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, sf).select("doc_id").collect()}
    toxic, clean = ([i for i in labels.index if labels[i] == v] for v in (1, 0))
    found, lost = sum(i not in kept for i in toxic), sum(i not in kept for i in clean)
    assert found > 0.5 * len(toxic) and lost <= 0.05 * len(clean), (found, len(toxic), lost, len(clean))


def test_the_sql_finds_a_notice_at_every_offset(spark):
    label, _, words = min(license_texts_by_length(), key=lambda t: t[1])
    step = 52 // (len(words) - 1)
    spread = " ".join(w + " filler" * (step - 1) for w in words)
    docs = docs_of(spark, ["pad " * n + spread + " tail" * 90 for n in range(0, 70, 5)])
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(docs).collect()}
    duck = duckdb.connect()
    duck.register("documents", docs.toPandas())
    want = dict(duck.sql(f"SELECT doc_id, labels FROM ({oracles.licenses()})").fetchall())
    assert got == want and all(label in v.split(",") for v in got.values())


def license_texts_by_length():
    return [t for t in licenses.TEMPLATES if len(t[2]) > 1]


def test_a_passage_repeated_in_a_long_text(spark):
    passage = "red green blue amber violet teal olive mauve coral ochre slate ivory"
    texts = [" ".join([f"{passage} x{i % 7}" for i in range(8_000)]), passage + " " + passage, "pearl " * 100_000]
    bench = spark.createDataFrame([("a", passage), ("b", passage), ("c", "pearl " * 12)], "item_id string, text string")
    windows = {tuple(w[i : i + 10]) for w in (passage.split(), ["pearl"] * 12) for i in range(3)}
    got = decontaminate.decontaminate(docs_of(spark, texts), bench).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        w = t.split()
        hit = np.zeros(len(w), bool)
        for i in range(len(w) - 9):
            if tuple(w[i : i + 10]) in windows:
                hit[i : i + 10] = True
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), int(hit.sum()), ["c"] if "pearl" in t else ["a", "b"])


def test_a_large_benchmark_is_probed_in_passes_or_by_a_shuffle(spark, monkeypatch):
    docs = docs_of(spark, [*TEXTS, *["red green blue amber violet teal %d olive" % i for i in range(9)]])
    bench = spark.createDataFrame([(i, "green blue amber violet teal %d" % i) for i in range(6)] + [(9, "one")], "item_id long, text string")
    rows = lambda: rows_of(decontaminate.decontaminate(docs, bench), "doc_id", "n_words", "n_hit", "items")
    want = rows()
    assert sum("['" in r for r in want) == 8
    monkeypatch.setattr(decontaminate, "BLOCK_KEYS", 4)
    assert rows() == want
    monkeypatch.setattr(decontaminate, "PASSES", 1)
    assert rows() == want


def plain_evidence(g, text):
    """Toxicity by definition: each symbol is judged by its distance to the ones before it."""
    out = dict.fromkeys(toxicity.PATTERNS, 0.0)
    for clause in toxicity._CLAUSE.split((text or "").translate(toxicity._LOWER)):
        words = ngram_join.words_of(clause)
        kind = ["I" if g.weight(w) else toxicity._CLASSES.get(w, "-") for w in words]
        last = lambda i, c: max([j for j in range(i) if kind[j] == c], default=-99)
        best, meant = {}, -99
        for i, (s, w) in enumerate(zip(kind, words)):
            reported, denied = last(i, "R") >= 0, i - last(i, "N") <= 3
            if s == "I":
                p = "reported" if reported else "negated" if denied else "targeted" if i - last(i, "T") <= 4 else "plain"
                best[p] = max(best.get(p, 0.0), g.factors[p] * g.weight(w))
            if s == "H" and not reported and not denied and i - last(i, "W") <= 3:
                meant = i
            if s == "T" and i - meant <= 3:
                best["threat"], meant = max(best.get("threat", 0.0), g.factors["threat"] * toxicity.HARM_WEIGHT), -99
        for p, x in best.items():
            out[p] += x
    return out


def test_toxicity_against_plain_definitions(spark):
    rng = random.Random(8)
    g = toxicity.Grammar(weights={"moron": 3.0, "scum": 2.0}, stems={"idio": 1.5}, factors={"plain": 1.0, "targeted": 1.3, "negated": 0.2, "reported": 0.5, "threat": 1.4}, threshold=3.0)
    some = ["moron", "scum", "Idiots", "kill", "will", "you", "not", "said", "a", "b", "c", ".", "\n"]
    texts = [*TEXTS, *[" ".join(rng.choices(some, k=rng.randrange(1, 40))) for _ in range(3000)]]
    got = toxicity.score_toxicity(docs_of(spark, texts).withColumn("v", F.lit(1)), g).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        want = plain_evidence(g, t)
        assert r.matches == {p: x for p, x in want.items() if x} and r.score == 1 - 2 ** (-sum(want.values()) / 3)


def test_toxicity_learns_from_repeated_ids_once(spark):
    docs = docs_of(spark, ["you moron"] * 6 + ["a fine day"] * 6)
    labels = spark.createDataFrame([(i, int(i < 6)) for i in range(12)] * 5, "doc_id long, toxic int")
    train = toxicity._training(docs.unionByName(docs), labels, 100)
    n = docs.where(~toxicity.held_out(F.col("doc_id"))).count()
    assert train.count() == n and train.where("toxic <> (text = 'you moron')").count() == 0


def test_streams_with_null_packets_and_cut_at_a_packet(spark):
    payload = random.Random(3).randbytes(64 * 700)
    m = transport_stream.mux(payload)
    null = b"\x47\x1f\xff\x10" + b"\xff" * 184
    padded = null + m[: 188 * 5] + null * 2 + m[188 * 5 :] + null
    got, plain = transport_stream.demux(padded), transport_stream.demux(m)
    assert got.payload == payload and got.stamps == plain.stamps and got.packets == plain.packets + 4
    assert [padded[188 * i : 188 * i + 188] for i in got.points] == [m[188 * i : 188 * i + 188] for i in plain.points]
    with pytest.raises(ValueError, match="cut end"):
        transport_stream.demux(m[: 188 * plain.points[2]])  # before the third elementary packet


def test_rows_that_repeat_an_id_are_documents_of_their_own(spark):
    docs = spark.createDataFrame([(7, "shared\nown %d" % i) for i in range(10)] + [(8, "alone")], "doc_id long, text string")
    got = line_dedup.split_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    cols = sorted(got.columns)
    assert rows_of(got, *cols) == sorted(map(repr, c.sql(f"select {', '.join(cols)} from ({oracles.line_dedup()})").fetchall())) and got.agg(F.sum("n_dropped")).first()[0] == 10


def test_rules_are_shipped_once(spark):
    pages = spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")
    url_filter.filter_urls(pages).collect()
    before = len(spark.sparkContext.listFiles)
    assert url_filter.filter_urls(pages).first().rule == "org/" and len(spark.sparkContext.listFiles) == before


def test_quality_bounds_come_from_texts_left_out(spark):
    """The classifier's bound and verdict from its own perplexities, by definition."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs.withColumn("keep", F.lit("old")), labels, quantile=0.9).select("doc_id", "lang", "perplexity", "max_perplexity", "keep").collect()
    left = {r.doc_id for r in labels.where("quality = 1").where(quality._left_out()).collect()}
    by_lang = {}
    for r in rows:
        if r.doc_id in left and r.perplexity is not None:
            by_lang.setdefault(r.lang, []).append(r.perplexity)
    assert len(by_lang) == 4
    for r in rows:
        own = sorted(by_lang[r.lang])
        assert own[max(0, int(np.ceil(0.9 * len(own))) - 2)] <= r.max_perplexity <= own[min(len(own) - 1, int(np.ceil(0.9 * len(own))))]
        assert r.keep == (r.perplexity is not None and r.perplexity <= r.max_perplexity)


def test_long_parts_are_not_remembered():
    m = pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    text = "日本" * 5_000 + " word " + "x" * 4_000
    assert np.frombuffer(m.encode(text), "<u4").tolist() == m.library.encode(text, add_bos=True, add_eos=True)
    assert list(m.after_mark) == ["word"] and not m.plain
    ngram_join._hashed.clear()
    ngram_join.Signer(4).sign(["long" * 50 + " word"])
    assert list(ngram_join._hashed) == ["word"]


def test_a_large_model_is_read_once_for_a_batch(spark, monkeypatch):
    """Far above what a task may keep: as many shards as it takes, each group within the bound, and the same scores."""
    rng = random.Random(11)
    texts = ["".join(rng.choices("abcdefghijklmnop é", k=200)) for _ in range(40)]
    held = quality.Model(*quality.train(docs_of(spark, texts).select("text")))
    monkeypatch.setattr(quality, "KEEP_BYTES", 60_000)
    model = quality.Model(*quality.train(docs_of(spark, texts).select("text")))
    assert held.groups == 1 and model.shards > quality.SHARDS and model.groups > 40
    asked = [*texts[:5], "never seen", None, "", "a" * 50]
    got, want = model.log_probability(asked), held.log_probability(asked)
    assert model.loads == model.groups and model.log_probability([None, ""]) == [None, None] and model.loads == model.groups
    assert [x is None for x in got] == [x is None for x in want] and np.allclose([x for x in got if x is not None], [x for x in want if x is not None])
    size = lambda t: t.keys.nbytes + t.values.nbytes + t.used.nbytes
    assert max(sum(map(size, model._load(i).values())) for i in range(model.groups)) <= 2 * quality.KEEP_BYTES  # tables of a few rows have room for sixteen
