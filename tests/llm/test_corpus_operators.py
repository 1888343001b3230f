"""Sharding, embeddings, BPE, SimHash, quality classifier, components, pipeline: brute force and awkward rows."""

import base64
import bisect
import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from tripstar.llm import bpe, components, embeddings, queries, quality, sharding, simhash


# ---- components ----

def test_components_of_random_links(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 420)]
    links += [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3), (3, None)] + [(1, 2)] * 5
    got = {r.node: r.component for r in
           components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    pairs = {frozenset(x) for x in links if None not in x and x[0] != x[1]}
    ids = {i for p in pairs for i in p}
    assert got == brute.components(ids, lambda i, j: frozenset((i, j)) in pairs)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- op5 ----

def shards_of(df, n=24, **kw):
    return sharding.histogram_shards(df, n, **kw).collect()


def check_shards(rows, docs, n):
    by = defaultdict(list)
    for r in rows:
        text = docs[r.doc_id] or ""
        assert (r.size, r.text_crc32) == (len(text.encode()) + 8, zlib.crc32(text.encode()))
        by[r.shard].append(r)
    assert len(rows) == len(docs) and set(by) <= set(range(n))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return [sum(r.size for r in by[k]) for k in range(n)]


def test_shards_of_near_equal_bytes(spark):
    docs = brute.documents(spark, "/root/testdata/sf0.01")
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = check_shards(shards_of(df, 8), docs, 8)
    longest = max(len(t.encode()) for t in docs.values()) + 8
    assert max(sizes) - min(sizes) <= 2 * longest
    # pieces inside a shard don't change the law
    assert check_shards(shards_of(df, 8, piece_rows=20), docs, 8)


def key_order(text, doc_id):
    return xxhash.xxh64(text.encode(), seed=42).intdigest(), doc_id + 2 ** 63


def test_shards_equal_brute_force(spark):
    """Tolerance 0 leaves no choice: rows sorted by (hash, id) and cut at the key nearest to each share of the bytes."""
    docs = {i: t or "" for i, t in brute.documents(spark, "/root/testdata/sf0.01").items()}
    docs |= {10 ** 9 + i: "" for i in range(500)} | {-i: "the same text" for i in range(1, 300)}
    n = 24
    rows = sorted(docs, key=lambda i: key_order(docs[i], i))
    ends = list(itertools.accumulate(len(docs[i].encode()) + 8 for i in rows))
    cuts = []
    for k in range(1, n):
        target = ends[-1] / n * k
        j = bisect.bisect_left(ends, target)
        before = ends[j - 1] if j else 0
        cuts.append(j + 1 if ends[j] - target < target - before else j)     # rows before the shard
    starts = [0, *cuts]
    want = {i: (bisect.bisect_right(starts, pos) - 1, pos - starts[bisect.bisect_right(starts, pos) - 1])
            for pos, i in enumerate(rows)}
    df = brute.frame(spark, list(docs.items())).repartition(5)
    for piece_rows in (1_000_000, 40):
        got = {r.doc_id: (r.shard, r.slot) for r in shards_of(df, n, tolerance=0.0, piece_rows=piece_rows)}
        assert got == want
    # at the query's tolerance every boundary is within it, or at the key nearest to its share
    sizes = check_shards(shards_of(df, n), docs, n)
    share, at = ends[-1] / n, 0
    for k in range(n - 1):
        at += sizes[k]
        nearest = ends[cuts[k] - 1] if cuts[k] else 0
        assert at == nearest or abs(at - share * (k + 1)) <= sharding.TOLERANCE * share


def test_shards_cut_a_group_of_copies_exactly(spark):
    docs = {i: "copy" for i in range(400)} | {1000 + i: f"other {i}" for i in range(100)}
    sizes = check_shards(shards_of(brute.frame(spark, list(docs.items())).repartition(7), 10), docs, 10)
    assert max(sizes) - min(sizes) <= 40


def test_shards_nulls_repeats_extremes_and_empty(spark):
    rows = [(None, "a"), (None, None), (5, "b"), (5, "b"), (2 ** 63 - 1, "c"), (-2 ** 63, "c"), (0, "z" * 50_000)]
    out = shards_of(brute.frame(spark, rows), 3)
    assert sorted(r.size for r in out) == sorted(len(t or "") + 8 for _, t in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shards_of(brute.frame(spark, [])) == []


def test_write_shards(spark, tmp_path):
    df = brute.frame(spark, [(i, f"text {i}" * (i % 9)) for i in range(200)] + [(None, None), (3, "text 3" * 3)])
    for k, piece in enumerate((10, 1_000_000)):
        path = str(tmp_path / str(k))
        assert sharding.write_shards(df, path, 4, piece_rows=piece) == "shard_"
        back = spark.read.parquet(path)
        assert back.drop("shard_").exceptAll(df).count() == 0 and back.count() == 202
        assert sorted(r.shard_ for r in back.select("shard_").distinct().collect()) == [0, 1, 2, 3]


# ---- op6 ----

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, x, "c", 1) for i, v, x in rows],
                                 "vec_id long, embedding array<float>, label int, key string, n int")


def linked(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}


def clustered(seed=0):
    rng, rows, i = np.random.default_rng(seed), [], 0
    for size, noise in ((150, 0.02), (40, 0.05), (10, 0.04), (300, 1.0)):
        centre = rng.standard_normal(32)
        for _ in range(size):
            v = centre + noise * rng.standard_normal(32) if noise < 1 else rng.standard_normal(32)
            rows.append((i, [float(np.float32(x)) for x in v], int(i % 2) if noise < 1 else 0))
            i += 1
    return rows


def test_embeddings_recall_and_soundness(spark, monkeypatch):
    rows = clustered()
    want = brute.near_vectors(rows)
    for window, tile in ((64, 1024), (8, 16)):      # far smaller than the clusters: counts still hold every link
        monkeypatch.setattr(embeddings, "WINDOW", window)
        monkeypatch.setattr(embeddings, "TILE", tile)
        got = linked(vectors(spark, rows).repartition(6))
        assert all(got[i][0] <= want[i][0] for i in want)
        assert sum(g[0] for g in got.values()) >= 0.95 * sum(w[0] for w in want.values())
    monkeypatch.undo()
    assert linked(vectors(spark, rows)) == want


def test_embeddings_recall_in_a_label_of_one_direction(spark, monkeypatch):
    """Isolated pairs at 0.935 among vectors at a mean cosine of 0.8: by passes alone, and by tiles."""
    rng = np.random.default_rng(4)
    common, n, pairs = rng.standard_normal(64), 3000, 200
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(unit(common) * 0.8 ** 0.5 + unit(rng.standard_normal((n, 64))) * 0.2 ** 0.5)
    a = x[:pairs]
    side = rng.standard_normal((pairs, 64))
    side = unit(side - (side * a).sum(axis=1)[:, None] * a)
    # the partner lies as far from the label's mean as its vector does, on average
    b = 0.935 * a + (1 - 0.935 ** 2) ** 0.5 * side
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([x, b]))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for window, tile, least in ((8, 4, 0.97), (64, 1024, 1.0)):
        monkeypatch.setattr(embeddings, "WINDOW", window)
        monkeypatch.setattr(embeddings, "TILE", tile)
        got = linked(frame.repartition(4))
        assert sum(got[i][0] > 0 and got[n + i][1] == got[i][1] for i in range(pairs)) >= least * pairs


def test_embeddings_of_small_labels_come_from_the_passes(spark, monkeypatch):
    """Labels from a pair to some windows, at the real parameters, rows in many partitions: all links, no tiles."""
    rng, rows = np.random.default_rng(9), []
    for label, n in enumerate((2, 60, 65, 66, 200, 500)):
        x = rng.standard_normal((n, 32))
        x[1::2] = x[0::2][:n // 2] + 0.05 * x[1::2]
        rows += [(len(rows) + i, v.tolist(), label) for i, v in enumerate(x)]
    seen = []
    tiles = embeddings._tiles
    monkeypatch.setattr(embeddings, "_tiles", lambda m: seen.append(m) or tiles(m))
    assert linked(vectors(spark, rows).repartition(16)) == brute.near_vectors(rows)
    # the first call is for labels whose pairs are compared whole: none of these
    assert seen[0].count() == 0


def test_embeddings_awkward_rows(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a, 1), (2, a, 1), (3, [2.0, 0.0, -0.0], 1), (4, a, 2), (5, a, None), (6, None, 1), (7, [0.0] * 3, 1),
            (8, [None, 1.0, 0.0], 1), (9, [float("nan"), 0.0, 1.0], 1), (10, [float("inf"), 0.0, 0.0], 1), (11, b, 1),
            (12, [1.0, 0.0], 1), (13, [], 1)]
    assert linked(vectors(spark, rows)) == brute.near_vectors(rows)
    assert linked(vectors(spark, [])) == {}
    many = embeddings.near_duplicates(vectors(spark, [(None, a, 1), (5, b, 1), (5, b, 1), (6, b, 1)])).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in many], key=str) == sorted(
        [(None, 0, None, False), (5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False)], key=str)
    # vectors without an id link too: with each other (no id reached), and with the one that has an id
    near = [1.0, 0.0, 0.01]
    many = embeddings.near_duplicates(vectors(spark, [(None, a, 1), (None, near, 1), (None, b, 1), (9, b, 1), (7, near, 2)]))
    assert sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in many.collect()], key=str) == sorted(
        [(None, 1, None, False), (None, 1, None, False), (None, 1, 9, False), (9, 1, 9, True), (7, 0, 7, True)], key=str)


def test_embeddings_hot_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(400)] + [(500, [1.0, 2.0, 3.001], 1)]
    got = linked(vectors(spark, rows))
    assert set(got.values()) == {(400, 0)}


# ---- op7 ----

BPE_TEXTS = [*brute.AWKWARD, (30, "a" * 3_000), (31, "ab" * 2_000 + "é" * 700), (32, "x0" * 999), (33, "🙂" * 400),
             (34, "<|endoftext|> it's we'll  \n\n  tabs\t\tend "), (35, "\u0000\u0001 ctrl"), (36, "东京 été naïve ₂")]


@pytest.fixture(scope="module")
def tiktoken_ids():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: enc.encode_ordinary(t or "")


def test_bpe_matches_tiktoken_and_round_trips(spark, tiktoken_ids):
    smoke = list(brute.documents(spark).items())
    ranks, pattern = bpe.default_ranks()
    for rows in (BPE_TEXTS, smoke):
        want = {i: (tiktoken_ids(t), (t or "").encode()) for i, t in rows}
        got = {r.doc_id: (r.ids, bytes(r.decoded)) for r in bpe.round_trip(brute.frame(spark, rows)).collect()}
        assert got == want
    two = bpe.decode(bpe.encode(brute.frame(spark, BPE_TEXTS), ranks, pattern, ["doc_id"]), ranks, pattern, ["doc_id"])
    assert {r.doc_id: bytes(r.decoded) for r in two.collect()} == {i: (t or "").encode() for i, t in BPE_TEXTS}
    assert bpe.round_trip(brute.frame(spark, [])).count() == 0
    repeated = bpe.round_trip(brute.frame(spark, [(None, "a b"), (None, None), (1, "a b"), (1, "a b")]))
    assert sorted(bytes(r.decoded) for r in repeated.collect()) == [b"", b"a b", b"a b", b"a b"]


def vocabulary():
    ranks, pattern = bpe.default_ranks()
    return bpe.Vocabulary(bpe.parse_ranks(ranks), pattern)


def test_bpe_long_texts_and_many_long_words_stay_within_memory(tiktoken_ids):
    rng = random.Random(8)
    coder = bpe.Coder(vocabulary())
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400_000))
    words = " ".join(letters[i:i + 240] for i in range(0, 240 * 1_500, 240))       # distinct words of 240 bytes
    long = " ".join(rng.choice(("alpha", "beta", "gamma", "δ", "x9", "\n")) for _ in range(2_500_000))
    ids = coder.encode([words, long, ""])
    assert ids[0].as_py() == tiktoken_ids(words) and ids[1].as_py() == tiktoken_ids(long)
    assert coder.decode(ids) == [words.encode(), long.encode(), b""]
    coder.close()


def test_bpe_full_memory_gives_the_same(tiktoken_ids, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    coder = bpe.Coder(vocabulary())
    for text in ("thing thong theng", "quorble snarfle thing", "quorble blick zzyx"):
        assert coder.encode([text]).to_pylist() == [tiktoken_ids(text)]


def test_bpe_query_digests(spark, tiktoken_ids):
    docs = brute.documents(spark)
    for r in queries.op7_byte_bpe(spark, brute.SMOKE).collect():
        ids = tiktoken_ids(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(docs[r.doc_id] or ""))


# ---- op9 ----

def near(df):
    return {r.doc_id: (f"{r.fp % 2 ** 64:016x}", r.component_id) for r in simhash.near_duplicates(df).collect()}


def test_simhash_matches_brute_force(spark):
    assert near(spark.read.parquet(f"{brute.SMOKE}/documents.parquet")) == brute.simhash(brute.documents(spark))
    assert near(brute.frame(spark, brute.AWKWARD)) == brute.simhash(dict(brute.AWKWARD))
    assert near(brute.frame(spark, [])) == {}


def test_simhash_links_of_crafted_fingerprints(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(12):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    fps = sorted(fps)
    classes = spark.createDataFrame([(f - 2 ** 64 if f >= 2 ** 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    got = sorted(tuple(sorted((r.a, r.b))) for r in simhash.class_links(classes).collect())
    want = sorted((i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3)
    assert got == want      # none lost, none twice


def test_golay_neighbours_share_a_codeword():
    rng = np.random.default_rng(2)
    v = rng.integers(0, 1 << 23, 3000)
    near_v = simhash.codewords(v)
    assert ((near_v >= 0).sum(axis=1) % 5 == 1).all()       # 1, or 1 + 5
    for bit in range(23):
        u = simhash.codewords(v ^ (1 << bit))
        assert (near_v == u[:, :1]).any(axis=1).all()


def test_simhash_dedup_keeps_one_of_each_group(spark):
    rows = [(5, "same words here now"), (3, "same words here now"), (3, "same words here now"), (9, "quite other text is this"),
            (None, "no id"), (7, None), (8, "")]
    docs = brute.frame(spark, rows)
    out = simhash.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(
        [(3, "same words here now"), (9, "quite other text is this"), (None, "no id"), (7, None)], key=str)


# ---- op10 ----

def auc(scores, truth):
    s, t = np.array(scores), np.array(truth)
    pos, neg = s[t == 1], s[t == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op10_quality_classifier(spark, sf)
    assert not any(x in out._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Join"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    assert auc([r.score for r in rows], [r.quality for r in rows]) > 0.98
    good = [r.predicted for r in rows if r.quality == 1]
    assert sum(good) / len(good) > 0.98
    r = out.filter("doc_id = 7").first()
    assert r.held_out == (zlib.crc32(b"7") % 5 == 0) and r.predicted == int(r.score >= 0.3)


def text_statistics(text):
    """The statistics of a text in plain Python, in the order that rules number them."""
    words, lines = re.findall(r"[^ \t\n\x0b\f\r]+", text), text.split("\n")
    n, w = max(len(text), 1), max(len(words), 1)
    of = lambda chars: sum(c in chars for c in text)
    return [math.log1p(len(words)), n / w, sum(unicodedata.category(c) == "Lu" for c in text) / n, of("0123456789") / n,
            of("#$%&*|<>=@^~_+/\\{}[]") / n, of("!?") / w, of(".,;:") / w, len(set(words)) / w, n / len(lines),
            len(set(lines)) / len(lines)]


def test_quality_scores_equal_brute_force(spark):
    """The compiled column against the fitted rules applied one by one to every text."""
    sf = "/root/testdata/sf0.01"
    model = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert model.rules

    def score(text):
        x = text_statistics(text or "")
        z = model.intercept + sum(w for rule, w in model.rules if all(lo < x[i] <= hi for i, lo, hi in rule.bounds))
        return 1 / (1 + math.exp(-z))

    docs = brute.documents(spark, sf)
    got = {r.doc_id: r for r in queries.op10_quality_classifier(spark, sf).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        want = score(text)
        assert abs(got[i].score - want) < 1e-9, i
        assert got[i].predicted == int(want >= 0.3) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    odd = quality.with_score(brute.frame(spark, brute.AWKWARD), model).collect()
    assert all(abs(r["__quality_score"] - score(r.text)) < 1e-9 for r in odd)


def test_quality_never_learns_from_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    assert quality.fit(docs, labels) == quality.fit(docs, flipped)


def test_quality_awkward_rows_and_labels(spark):
    docs = brute.frame(spark, [*brute.AWKWARD, (None, "no id"), (6, "again 6")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    flat = quality.with_score(docs, quality.fit(docs, none)).collect()
    assert len(flat) == len(brute.AWKWARD) + 2 and {r["__quality_score"] for r in flat} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (2, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.accepted(docs, one)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert quality.accepted(brute.frame(spark, []), none).count() == 0
    odd = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 21)], "doc_id long, quality int, toxic int")
    scores = quality.with_score(docs, quality.fit(docs, odd)).collect()
    assert all(0 <= r["__quality_score"] <= 1 and not math.isnan(r["__quality_score"]) for r in scores)


def test_rules_are_the_paths_of_a_tree():
    tree = """DecisionTree depth 2
  If (feature 3 <= 0.5)
   If (feature 1 <= 2.0)
    Predict: 0.0
   Else (feature 1 > 2.0)
    Predict: 1.0
  Else (feature 3 > 0.5)
   If (feature 3 <= 0.75)
    Predict: 1.0
   Else (feature 3 > 0.75)
    Predict: 0.0
"""
    inf = math.inf
    assert [r.bounds for r in quality.paths(tree)] == [
        ((3, -inf, 0.5),), ((1, -inf, 2.0), (3, -inf, 0.5)), ((1, 2.0, inf), (3, -inf, 0.5)),
        ((3, 0.5, inf),), ((3, 0.5, 0.75),), ((3, 0.75, inf),)]


# ---- pipeline ----

def test_pipeline_stages_match_brute_force(spark, tiktoken_ids):
    """Each stage on what the one before kept; the fitted scores and line counts come from the operators' own tests."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scored = {r.doc_id for r in queries.op10_quality_classifier(spark, sf).filter("predicted = 1").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination",
                     "byte-level BPE encoding and decoding"]
    states = [docs]
    for _, stage in corpus_pipeline.STAGES:
        states.append(corpus_pipeline.written(stage(spark, states[-1], sf), "test"))
    assert all(s.columns == docs.columns for s in states[1:5])
    text = [{r.doc_id: r.text for r in s.collect()} for s in states[:5]]
    assert set(text[1]) == scored and set(text[2]) == set(text[1])
    comp = brute.simhash(text[2])
    assert text[3] == {i: t for i, t in text[2].items() if comp[i][1] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = brute.decontamination(text[3], items)
    assert text[4] == {i: t for i, t in text[3].items() if not hit[i][4]}
    last = {r.doc_id: r for r in states[5].collect()}
    assert set(last) == set(text[4]) and all(r.lossless for r in last.values())
    assert all(last[i].ids == tiktoken_ids(text[4][i]) for i in list(last)[:100])
    whole = corpus_pipeline.run(spark, sf)
    digest = lambda rows: hashlib.sha256(str(sorted((r.doc_id, r.ids) for r in rows)).encode()).hexdigest()
    assert digest(whole.collect()) == digest(last.values())
