"""What the operators miss unless they do the whole job."""

import random

import pytest

from sparkloom.llm import divergence, sketch


def test_word_limits_by_length(spark, tmp_path):
    rnd = random.Random(5)
    common = "the of and to in is that for it as was with be by on".split()
    word = lambda: rnd.choice(common) if rnd.random() < 0.5 else "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows = [(i, "en", " ".join(word() for _ in range(80 if i % 2 else 800))) for i in range(440)]
    #: Half of the common words only: as far from the reference as only a short clean text may be, but long.
    rows.append((1000, "en", " ".join(rnd.choice(common[:9]) if i % 2 else "".join(rnd.choice("abcdefgh") for _ in range(6)) for i in range(800))))
    rows.append((1001, "en", " ".join(word() for _ in range(800))))
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(440)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    trusted = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id < 440")
    refs = divergence.references(trusted)
    most = divergence.length_limits(trusted, refs)
    far = [(r.n_words__, r.word_distance__) for r in divergence.judged(trusted, refs).collect()]
    assert most["max_word"][6] == max(d for n, d in far if n == 80) and most["max_word"][9] == max(d for n, d in far if n == 800)
    assert most["max_word"][20] == most["max_word"][9] < most["max_word"][6] and (most["max_word"][:6] == divergence.MAX_WORD_DISTANCE).all()
    before = {r.doc_id for r in divergence.op2_quality_divergence(spark, str(tmp_path)).collect()}
    after = {r.doc_id for r in divergence.op2_quality_by_length(spark, str(tmp_path)).collect()}
    assert 1000 in before and 1000 not in after and 1001 in after and len(after - {1001}) >= 438


def test_containment_of_short_and_long_texts(spark, tmp_path):
    rnd = random.Random(6)
    words = ["w" + str(rnd.random())[2:] for _ in range(3000)]
    spans = [(i * 40, i * 40 + 7 + i) for i in range(20)] + [(0, 3000), (1000, 2500), (5, 5)]  # the first twenty are short passages
    texts = [words[a:b] for a, b in spans] + [words[40:48], ["lonely", "words"]]
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    shingles = [{tuple(t[i : i + sketch.WIDTH]) for i in range(max(1, len(t) - sketch.WIDTH + 1))} if t else set() for t in texts]
    want = {(a, b): len(shingles[a] & shingles[b]) for a in range(len(texts)) for b in range(len(texts)) if a != b and shingles[a] & shingles[b]}
    for sent in (sketch.SENT, 0):  # by hashes sent to the executors, and by a join
        rows = sketch.searched(spark.read.parquet(f"{tmp_path}/documents.parquet"), sent=sent, every=1).collect()
        exact = {(r.a_id, r.b_id): (r.shared, r.in_b) for r in rows if r.exact}
        assert exact == {k: (n, pytest.approx(n / len(shingles[k[0]]))) for k, n in want.items() if k[0] not in (20, 21)}
        rest = {(r.a_id, r.b_id): r.in_b for r in rows if not r.exact}
        assert rest[21, 20] == 1.0 and abs(rest[20, 21] - 0.5) < 0.15
    assert {(i, 20) for i in range(20)} <= exact.keys()
    some = sketch.searched(spark.read.parquet(f"{tmp_path}/documents.parquet"), every=10).collect()
    assert {r.a_id for r in some} <= {0, 10, 20} and {(r.a_id, r.b_id) for r in some} == {(a, b) for a, b in [*exact, *rest] if a % 10 == 0}


def test_passages_that_documents_hold(spark):
    rnd = random.Random(7)
    words = ["w" + str(rnd.random())[2:] for _ in range(2000)]
    items = [(i, " ".join(words[i * 30 : i * 30 + 5 + i])) for i in range(20)] + [(20, ""), (21, None), (None, words[0]), (22, " ".join(words[60:67]))]
    texts = [" ".join(words[:700]), " ".join(words[35:60]), "x y", None, "", " ".join(words[60:67]), " ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut_ = lambda t: {tuple(t.split()[i : i + sketch.WIDTH]) for i in range(max(1, len(t.split()) - sketch.WIDTH + 1))} if t and t.split() else set()
    want = {}
    for d, t in enumerate(texts):
        for i, item in items:
            n, both = len(cut_(item)), len(cut_(item) & cut_(t))
            if i is not None and both and both / n >= sketch.SHARE:
                want.setdefault(d, []).append((i, both, pytest.approx(both / n)))
    for sent in (sketch.SENT, 0):
        rows = sketch.fingerprints(docs, spark.createDataFrame(items, "item_id long, text string"), sent=sent).collect()
        assert len(rows) == len(texts) and {r.doc_id: [tuple(x) for x in r.held] for r in rows if r.held} == {d: sorted(v) for d, v in want.items()}
        assert {r.doc_id: r.sketch for r in rows} == {r.doc_id: r.sketch for r in sketch.sketches(docs).collect()}
    one = sketch.sketches(docs, scale=1).collect()
    limit = (1 << 63) // sketch.SCALE
    assert all(r.sketch == [h for h in o.sketch if h < limit] for r, o in zip(sorted(rows, key=lambda r: r.doc_id), sorted(one, key=lambda r: r.doc_id)))


def test_overlap_of_merged_sources(spark, tmp_path):
    rnd = random.Random(8)
    words = ["w" + str(rnd.random())[2:] for _ in range(6000)]
    rows = [(i, f"s{i % 3}", " ".join(words[(i % 3) * 1000 + i * 100 : (i % 3) * 1000 + i * 100 + 600])) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {s: {h for r in sketch.sketches(spark.createDataFrame([x for x in rows if x[1] == s], "doc_id long, source string, text string")).collect() for h in r.sketch} for s in ("s0", "s1", "s2")}
    got = {(r.a_id, r.b_id): (r.shared, r.in_b) for r in sketch.op3_source_overlap(spark, str(tmp_path)).collect()}
    assert got == {(a, b): (len(sets[a] & sets[b]), pytest.approx(len(sets[a] & sets[b]) / len(sets[a]))) for a in sets for b in sets if a != b and sets[a] & sets[b]} and got


def test_containment_is_a_query():
    from sparkloom.llm.queries import QUERIES

    assert QUERIES["op3_containment"] is sketch.op3_containment
