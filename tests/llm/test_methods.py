"""Operators against brute force, round trips, held-out accuracy."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import graph, hilbert, kneser, langid, mixing, neardup, pieces, sketch, urlfilter, vectext, warc
from sparkloom.llm.common import table


def word_runs(text, width):
    words, now = [], ""
    for c in text.lower() + " ":
        if c.isalnum():
            now += c
        elif now:
            words.append(now)
            now = ""
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


# near duplicates


def test_minhash_groups_are_those_of_all_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sig, some = neardup.signature_matrix(pa.array([t for _, t in rows]), neardup.WIDTH, neardup.COORDINATES)
    ids = [i for (i, _), ok in zip(rows, some) if ok]
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ids)):
        hits = np.flatnonzero((sig[a] == sig[a + 1 :]).sum(1) >= neardup.MIN_MATCHES)
        for b in hits + a + 1:
            x, y = root(ids[a]), root(ids[b])
            parent[max(x, y)] = min(x, y)
    want = {(i, root(i)) for i in ids if root(i) != i}
    assert {(r.doc_id, r.keep_id) for r in neardup.near_duplicates(docs).collect()} == want
    assert want


def test_copies_and_near_copies_are_found_and_others_stay(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows, planted = [], []
    for i in range(60):
        base = [word() for _ in range(120)]
        rows.append((i, " ".join(base)))
        near = base.copy()
        near[rnd.randrange(120)] = word()
        if i % 3 == 0:
            rows.append((1000 + i, " ".join(near)))
            planted.append((1000 + i, i))
    got = {(r.doc_id, r.keep_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(planted)


def test_hub_of_copies(spark):
    rows = [(i, f"same words in all of these many texts here and number {i % 7}") for i in range(3000)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) >= 3000 - 7


def test_pages_of_shared_parts_cost_as_many_comparisons_as_pages(spark, monkeypatch):
    """Headers and footers that many share, texts of their own between: long lists, few matches."""
    compared, plain = [], neardup._matching

    def counting(pairs, nodes, k, least):
        compared.append(pairs.count())
        return plain(pairs, nodes, k, least)

    monkeypatch.setattr(neardup, "_matching", counting)
    per = {}
    for own, n in ((90, 300), (90, 1200)):
        rnd = random.Random(8)
        word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(7))
        run = lambda m: " ".join(word() for _ in range(m))
        heads, feet = [run(40) for _ in range(4)], [run(40) for _ in range(4)]
        rows = [(i, f"{heads[i % 4]} {run(own)} {feet[i // 4 % 4]}") for i in range(n)]
        nodes = neardup.signatures(spark.createDataFrame(rows, "doc_id long, text string")).select(F.xxhash64("sig").alias("node"), "sig")
        compared.clear()
        got = {r.node: r.root for r in neardup.matched_components(nodes).collect()}
        per[own, n] = sum(compared) / n
        sig = {r.node: np.frombuffer(r.sig, np.uint32) for r in nodes.collect()}
        ids = sorted(sig)
        m = np.stack([sig[i] for i in ids])
        parent = {i: i for i in ids}

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(len(ids)):
            for j in np.flatnonzero((m[i] == m[i + 1 :]).sum(1) >= neardup.MIN_MATCHES) + i + 1:
                x, y = root(ids[i]), root(ids[j])
                parent[max(x, y)] = min(x, y)
        want = {i: root(i) for i in ids}
        assert {i: got.get(i, i) for i in ids} == want
    assert per[90, 1200] < 2 * per[90, 300] + 20, per


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (5, 5), (11, 10), (4, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10} | {100 + i: 100 for i in range(41)}


# fingerprints


def test_sketch_keeps_hashes_below_the_threshold(spark):
    texts = ["one two three four five six seven", "one two three four five six seven eight nine", "ONE, two three four five six seven.", "short"]
    rows = sketch.sketches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scale=1).orderBy("doc_id").collect()
    assert [r.n_shingles for r in rows] == [len(set(word_runs(t, sketch.WIDTH))) for t in texts]
    assert [len(r.sketch) for r in rows] == [r.n_shingles for r in rows] and rows[0].sketch == rows[2].sketch
    assert set(rows[0].sketch) < set(rows[1].sketch)


def test_containment_estimate(spark):
    rnd = random.Random(1)
    words = [str(rnd.random())[2:] for _ in range(20_000)]
    docs = spark.createDataFrame([(0, " ".join(words[:6000])), (1, " ".join(words))], "doc_id long, text string")
    s = sketch.sketches(docs)
    got = {(r.a_id, r.b_id): r.in_b for r in sketch.containment(s, s).collect()}
    assert got[0, 1] == 1.0 and abs(got[1, 0] - 0.3) < 0.05
    merged = sketch.merged(s.withColumn("g", F.lit("x")), "g").first()
    assert merged.sketch == sorted({h for r in s.collect() for h in r.sketch})


# SentencePiece


def test_pieces_are_those_of_the_library(sf_dir):
    sentencepiece = pytest.importorskip("sentencepiece")
    import pyarrow.parquet as pq

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rnd = random.Random(2)
    vocabulary = [sp.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts = pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()
    texts += ["", " ", "   a  b\n\n\tc", "é🙂日本 ▁x", "aaaa" * 60, "\x00\x01", "abab" * 500]
    #: Long stretches: segments that meet, and some that never do.
    texts += ["a" * 5000, "".join(rnd.choice("ab") for _ in range(3000)), "".join(rnd.choice("日本語中文字") for _ in range(2000)), "".join(rnd.choice(vocabulary).strip() for _ in range(2000)), "0123456789" * 300]
    texts += ["".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    texts += ["".join(chr(rnd.choice([rnd.randint(1, 127), rnd.randint(128, 0x2FFF), rnd.randint(0x4E00, 0x9FFF)])) for _ in range(30)) for _ in range(500)]
    encoder = pieces.Encoder(pieces.compiled())
    for _ in range(2):  # from the machine, then from memory
        ids, starts = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == sp.encode(texts)
    assert [t.replace("▁", " ") for t in encoder.decode(ids, starts)] == [t.replace("▁", " ") for t in texts]


def unigram_model(path, scores):
    """A model file of the given pieces and scores, with byte fallback."""
    import struct

    def field(number, value):
        if isinstance(value, int):
            return bytes([number << 3 & 127 | (128 if number > 15 else 0), *([number >> 4] if number > 15 else []), value])
        if isinstance(value, float):
            return bytes([number << 3 | 5]) + struct.pack("<f", value)
        n, size = len(value), b""
        while n > 127:
            size, n = size + bytes([n & 127 | 128]), n >> 7
        return bytes([number << 3 | 2]) + size + bytes([n]) + value

    pieces_ = [("<unk>", 0.0, 2), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), *((p, s, 1) for p, s in scores.items())]
    raw = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, kind)) for p, s, kind in pieces_)
    raw += field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    path.write_bytes(raw)


def test_unigram_pieces_are_the_shortest_path(tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    rnd = random.Random(9)
    scores = {"▁": -3.0, "a": -4.0, "b": -4.25, "c": -5.5, "ab": -4.5, "ba": -6.0, "abc": -9.75, "▁a": -3.5, "cab": -7.0, "bab": -6.5, "日本": -5.0, "xy": -4.0}
    unigram_model(tmp_path / "u.model", scores)
    sp = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "u.model"))
    encoder = pieces.Encoder(pieces.compiled(str(tmp_path / "u.model")))
    texts = ["", "abc", "x", "xy", "日本x本", "a b  c", "é"] + ["".join(rnd.choice("aaabbbccc xy日本é") for _ in range(rnd.randint(1, 40))) for _ in range(2000)]
    texts += ["".join(rnd.choice("abc") for _ in range(n)) for n in (300, 1000, 5000)] + ["abcab" * 400]
    ids, starts = encoder.encode(pa.array(texts))
    cost = lambda run: sum(encoder.m.weight[i] if i > 256 else 0 for i in run)
    worst = -encoder.m.weight[-1]

    def best(text):
        """Weight of the shortest path, the slow way."""
        x = ("▁" + text.replace(" ", "▁")) if text else ""
        w = [0] + [1 << 60] * len(x)
        for i in range(len(x)):
            w[i + 1] = min(w[i + 1], w[i] - worst if x[i] not in scores else 1 << 60)
            for p, s in scores.items():
                if x.startswith(p, i):
                    w[i + len(p)] = min(w[i + len(p)], w[i] + round(-s * pieces.UNIT))
        return w[-1]

    for t, a, b in zip(texts, starts, starts[1:]):
        run = ids[a:b].tolist()
        aliens = len(bytes(i - 1 for i in run if 0 < i <= 256).decode())
        assert cost(run) - worst * aliens == best(t)
    assert sum(ids[a:b].tolist() == w for a, b, w in zip(starts, starts[1:], sp.encode(texts))) >= 0.995 * len(texts)
    assert encoder.decode(ids, starts) == texts


def test_stretches_of_one_hash_are_told_apart(monkeypatch):
    encoder = pieces.Encoder(pieces.compiled())
    want = [encoder.encode(pa.array([t]))[0].tolist() for t in ("some words", "other thin")]
    monkeypatch.setattr(pieces.V, "span_hashes", lambda codes, begin, end: np.zeros(len(begin), np.uint64))
    encoder.forget()
    ids, starts = encoder.encode(pa.array(["some words", "other thin"]))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == want


# Kneser-Ney


def brute(texts, order):
    """The model of one language by the textbook; p(symbol | history)."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = chr(kneser.MARK) * (order - 1) + t
        counts[order].update(s[i - order + 1 : i + 1] for i in range(order - 1, len(s)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts = {}
    for k in range(1, order + 1):
        n = Counter(counts[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        d = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i for i in (1, 2, 3)]
        discounts[k] = [min(max(v, 0.1 * i), 0.9 * i) for i, v in zip((1, 2, 3), d)]

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        below, after = p(gram[1:]), {g: c for g, c in counts[k].items() if g[:-1] == gram[:-1]}
        if not after:
            return below
        d = lambda c: discounts[k][min(c, 3) - 1] if c else 0
        total, c = sum(after.values()), after.get(gram, 0)
        return (c - d(c)) / total + sum(map(d, after.values())) / total * below

    return lambda t: -sum(math.log(p((chr(kneser.MARK) * (order - 1) + t)[i : i + order])) for i in range(len(t)))


def test_kneser_ney_is_the_textbook_model(spark):
    train = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "on and on"]
    test = ["the cat", "zzz", "dog on a mat", "", "the the"]
    rows = spark.createDataFrame([("en", t) for t in train], "lang string, text string")
    model = kneser.train(rows)
    score = brute(train, kneser.ORDER)
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(test)], "doc_id long, lang string, text string")
    for sent in (kneser.SENT_ROWS, 0):  # by lookup, and by joins with the shards
        got = {r.doc_id: r.nll__ for r in kneser.scored(docs, model, "text", "lang", sent).collect()}
        for i, t in enumerate(test):
            assert got[i] == pytest.approx(score(t), abs=2e-3)


def test_limits_are_quantiles_of_held_out_texts(spark, tmp_path):
    """Model, limits and decisions against the textbook, on a small table."""
    rnd = random.Random(12)
    words = {"en": ["the", "cat", "sat", "on", "a", "mat"], "de": ["der", "hund", "und", "die", "katze"]}
    rows = [(i, g, " ".join(rnd.choice(words[g]) for _ in range(rnd.randint(3, 12)))) for i in range(120) for g in [rnd.choice(["en", "de"])]]
    rows += [(200, "en", "zqx vvk wwq zzz"), (201, "de", "zqx vvk wwq zzz"), (202, "fr", "zqx"), (203, "en", "")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(90)], "doc_id long, quality int, toxic int")
    held = {r.doc_id for r in docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(kneser.HELD)) == 0).collect()}
    models = {g: brute([t for i, lang, t in rows if lang == g and i < 90 and i not in held], kneser.ORDER) for g in words}
    most, mean = {}, {}
    for g in words:
        mine = [(models[g](t), len(t)) for i, lang, t in rows if lang == g and i < 90 and i in held]
        mean[g] = sum(s for s, _ in mine) / sum(n for _, n in mine)
        scores = sorted((s + kneser.PRIOR * mean[g]) / (n + kneser.PRIOR) for s, n in mine)
        most[g] = scores[math.ceil(kneser.QUANTILE * len(scores)) - 1] + math.log(kneser.MARGIN)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in kneser.op5_quality_classifier(spark, str(tmp_path)).collect()}
    for i, g, t in rows:
        if g == "fr":
            assert i in got and got[i].compared is None
            continue
        s = (models[g](t) + kneser.PRIOR * mean[g]) / (len(t) + kneser.PRIOR)
        if abs(s - most[g]) > 1e-4:
            assert (i in got) == (bool(t) and s < most[g])
        if i in got:
            assert got[i].compared == pytest.approx(math.exp(s), rel=1e-3) and got[i].limit == pytest.approx(math.exp(most[g]), rel=1e-3)
            assert got[i].perplexity == pytest.approx(math.exp(models[g](t) / len(t)), rel=1e-3)
    assert not {200, 201, 203} & set(got)


def test_blocks_of_text_are_scored_as_with_the_whole_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 9 != 0, F.col("lang")).alias("lang"), F.struct(F.lit(1).alias("a b")).alias("odd"))
    model = kneser.train(docs.where("doc_id < 60").select("lang", "text"))
    one = {r.doc_id: (r.n__, r.nll__) for r in kneser.scored(docs, model, "text", "lang").collect()}
    for size in (20_000, kneser.BLOCK):
        two = {r.doc_id: (r.n__, r.nll__) for r in kneser._scored_by_join(docs, model, "text", "lang", size).collect()}
        assert one.keys() == two.keys() and all(one[d][0] == n and (x is None) == (one[d][1] is None) and (x is None or abs(x - one[d][1]) < 0.01) for d, (n, x) in two.items())


def test_perplexity_tells_junk(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    kept = {r.doc_id for r in kneser.keep(docs, labels).select("doc_id").collect()}
    said = {r.doc_id: r for r in labels.collect()}
    good = [d for d, r in said.items() if r.quality == 1 and r.toxic == 0]
    junk = [d for d, r in said.items() if r.quality == 0]
    assert sum(d in kept for d in good) >= 0.97 * len(good) and sum(d in kept for d in junk) <= 0.15 * len(junk)


# language


def test_language_on_texts_that_were_not_fitted(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fitted = langid.fit(docs.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1 and n_chars > 50")
    found = {r.doc_id: r.language for r in langid.identify(rest, labels, model=fitted).collect()}
    truth = {r.doc_id: r.lang for r in rest.select("doc_id", "lang").collect()}
    known = [d for d, g in found.items() if g]
    assert len(known) >= 0.9 * len(truth) and sum(found[d] == truth[d] for d in known) >= 0.97 * len(known)
    foreign = spark.createDataFrame([(1, "пример совсем другого письма и языка " * 20), (2, "xqzjvw kkkppq wzzxj " * 20)], "doc_id long, text string")
    assert {r.language for r in langid.identify(foreign, labels, model=fitted).collect()} == {None}


class Given:
    """A stand-in for a table: keeps the function that mapInArrow would send."""

    def __init__(self, spark):
        self.sparkSession, self.schema = spark, spark.range(0).selectExpr("'' as text").schema

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_language_id_takes_little_memory_for_much_text(spark, monkeypatch):
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghijklmnoprstuvwyz", k=draw.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(draw.choices(words, k=draw.choice([0, 3, 400, 700]))) for _ in range(2400)]
    texts[7] = " ".join(draw.choices(words, k=9000))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    assert batch.nbytes > 4_000_000
    centroids = np.random.default_rng(3).random((6, langid.DIMS)).astype(np.float32)
    model = langid.Model(np.ones(langid.DIMS, np.float32), centroids / np.linalg.norm(centroids, axis=1, keepdims=True), list("aabbcc"), np.ones(41))
    given = Given(spark)
    langid.judged(given, model)
    list(given.run(iter([batch.slice(0, 9)])))  # tables of characters are made once
    tracemalloc.start()
    small = pa.Table.from_batches(given.run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6, peak
    monkeypatch.setattr(langid, "_PART", 10**9)
    whole = pa.Table.from_batches(given.run(iter([batch])))
    assert small.num_rows == len(texts) and small.combine_chunks().equals(whole.combine_chunks())


# mixing


def test_every_prefix_of_the_schedule_has_the_weights(spark):
    rows = [(i, f"s{i % 3}", " ".join(["w"] * (50 + i % 90))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = {"s0": 5.0, "s1": 3.0, "s2": 2.0}
    spans = mixing.mixed(docs, weights=weights, block_tokens=100).select("slot", "source").distinct().orderBy("slot").collect()
    for n in (20, 100, len(spans)):
        seen = Counter(r.source for r in spans[:n])
        for s, w in weights.items():
            assert abs(seen[s] - n * w / 10) <= 3
    full = mixing.mixed(docs, weights={"s0": 1.0}, block_tokens=100).groupBy("slot").agg(F.sum(F.col("tok_to") - F.col("tok_from")).alias("n")).collect()
    assert sum(r.n != 100 for r in full) <= sum(1 for r in full) // 40 + 3


# WARC


def test_record_from_its_frame_only(spark, sf_dir):
    import zstandard

    pages = table(spark, sf_dir, "pages")
    packed = warc.bundles(pages, frame_bytes=20_000, bundle_bytes=200_000).collect()
    want = {r.page_id: (r.url, r.html) for r in pages.collect()}
    seen = 0
    for b in packed:
        table_ = warc.seek_table(b.data)
        assert len(table_) == b.n_frames and len(b.records) == b.n_records
        for r in b.records:
            record_id, page, url, html = warc.parse(warc.read(b.data, r.frame, r.offset, r.length))
            assert record_id == r.record_id and (url, html) == want[page]
            seen += 1
        whole = b"".join(zstandard.ZstdDecompressor().stream_reader(b.data, read_across_frames=True).readall() for _ in range(1))
        assert len(whole) == sum(raw for _, _, raw, _ in table_)
    assert seen == len(want)
    damaged = bytearray(packed[0].data)
    damaged[40] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        warc.read(bytes(damaged), 0, 0, 10)


def test_records_of_different_pages_have_different_ids(spark, tmp_path):
    ids = set()
    for url in ("http://a/1", "http://b/9"):
        packed = warc.bundles(spark.createDataFrame([(1, url, "x"), (1, url, "x")], "page_id long, url string, html string").coalesce(1))
        ids |= {(r.bundle, x.record_id) for r in packed.collect() for x in r.records}
        warc.save(packed, str(tmp_path))
        warc.save(packed, f"file://{tmp_path}")
    assert len({i for _, i in ids}) == 4 and len(list(tmp_path.glob("*.warc.zst"))) == 2
    odd = "http://a/\r\nb%0D"
    assert warc.parse(warc.record("0" * 36, 1, odd, "x"))[2] == odd


# URLs


def test_trie_is_the_longest_cover(spark):
    rnd = random.Random(3)
    hosts, paths = ["a.com", "b.a.com", "c.b.a.com", "com", "d.org"], ["", "x", "x/y", "x/y/z", "q"]
    entries = list({(f"{h}/{p}".rstrip("/"), rnd.choice(["allow", "block"])) for h in hosts for p in paths if rnd.random() < 0.6})
    urls = [f"http://{s}{h}/{p}?q=1" for h in hosts for p in [*paths, "x/yy"] for s in ("", "www.", "user@")] + [None, "x", "http:///y"]

    def brute(url):
        at = urlfilter.parts(url)
        if at is None:
            return "invalid"
        best = None
        for e, v in entries:
            h, _, p = e.partition("/")
            h, p = h.split(".")[::-1], [s for s in p.split("/") if s]
            if at[0][: len(h)] == h and at[1][: len(p)] == p:
                best = max(best or (-1,), (len(h), len(p), v == "allow", v))
        return best[3] if best else "none"

    label = lambda: rnd.choice(["", "a", "b", "c", "com", "org", "d", "A"])
    urls += [f"http://{'.'.join(label() for _ in range(rnd.randint(1, 5)))}/{'/'.join(rnd.choice(['', 'x', 'y', 'z', 'q']) for _ in range(rnd.randint(0, 4)))}" for _ in range(2000)]
    urls += ["http://x..a.com/", "http://..a.com", "http://a.com..", "http://u@v@a.com:80/x", "http://a.com\u2028@b.a.com/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for most in (1 << 20, 0):  # as a trie, and by joins
        got = {r.page_id: r.verdict for r in urlfilter.classify(pages, entries, most=most).collect()}
        assert got == {i: brute(u) for i, u in enumerate(urls)}


# Hilbert


def test_curve_visits_neighbours():
    for n, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        order = grid[np.argsort(hilbert.curve_index(grid, bits))]
        assert sorted(hilbert.curve_index(grid, bits)) == list(range(len(grid)))
        assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_cells_of_many_bytes(spark):
    """Sizes and pieces are multiplied as doubles: a cell of 2 GiB or more isn't an overflow."""
    df = spark.createDataFrame([(3 << 30, 4294967295)], "bytes long, p long")
    assert df.select(F.floor(F.col("bytes").cast("double") * F.col("p") / float(1 << 32))).first()[0] == (3 << 30) - 1


def test_ranks_by_ranges(spark):
    rows = spark.createDataFrame([(None if i % 11 == 0 else (i * 7919) % 500,) for i in range(3000)], "v long")
    values = sorted((r.v for r in rows.collect()), key=lambda v: (v is not None, v))
    want = {v: 64 * values.index(v) // len(values) for v in set(values)}
    got = rows.select("v", hilbert._rank(rows, "v", 6).alias("q")).distinct().collect()
    assert {r.v: r.q for r in got} == want


def test_shards_prune(spark, sf_dir):
    out = hilbert.shards(table(spark, sf_dir, "documents"), shard_bytes=20_000).cache()
    ends = hilbert.manifest(out)
    n = ends.count()
    bounds = {"n_chars": (3000, None), "lang": ("de", "de")}
    left = hilbert.pruned(ends, bounds)
    hit = {r.shard for r in out.where("n_chars >= 3000 and lang = 'de'").select("shard").distinct().collect()}
    assert hit <= {r.shard for r in left.collect()} and left.count() < n


def test_words_and_hashes():
    texts = ["One two-three", "", None, "éa  b1"]
    codes, starts = vectext.code_points(pa.array(texts))
    begin, end, first = vectext.word_spans(codes, starts)
    assert ["".join(map(chr, codes[a:b])) for a, b in zip(begin, end)] == ["One", "two", "three", "éa", "b1"]
    assert first.tolist() == [0, 3, 3, 3, 5]
