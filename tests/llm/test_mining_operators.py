"""Licence scans, phrase collocations and hard negatives: SQL, brute force and awkward rows."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from tripstar.checks import compare, duckdb_connection
from tripstar.llm import licenses, negatives, phrases, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_license_scans", "op12_phrase_collocations", "op13_hard_negatives"])
def test_queries_match_sql(spark, name):
    got = compare(spark, SF, name, queries.QUERIES[name], queries.SQL[name], duckdb_connection(SF))
    assert got["status"] == "ok", got


# ---- op11 ----

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate(brute.FOLD))


def places_of(text):
    w = words_of(text)
    return sorted((i, label) for label, p in licenses.PHRASES for i in range(len(w))
                  if w[i:i + len(p.split())] == p.split())


def scanned(spark, rows):
    return {r.doc_id: r for r in licenses.scan(brute.frame(spark, rows)).collect()}


def test_license_phrases_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(licenses, "CHUNK", 64)
    monkeypatch.setattr(licenses, "WINDOW", 50)
    rng = random.Random(5)
    parts = [p for _, p in licenses.PHRASES] + ["under", "the", "mit", "license", "CC BY", "by-nc", "Apache", "2", "é"]
    docs = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(60)] + brute.AWKWARD
    docs = [(i, t) for i, (_, t) in enumerate(docs)] + [(500, "CC BY-NC " * 20_000)]
    got = scanned(spark, docs)
    for i, t in docs:
        assert got[i].n_words == len(words_of(t))
        assert sorted((p.start, p.label) for p in got[i].places) == places_of(t), i


def notice(label):
    return next(t.text for t in licenses.TEMPLATES if t.label == label)


def test_license_notices_survive_changes_and_need_their_keys(spark):
    mit, bsd = notice("mit").split(), notice("bsd")
    rows = [(1, "x = 1\n" + " ".join(mit).upper() + "\nreturn"),
            (2, " ".join(mit[:20] + ["INSERTED"] + mit[20:])),                       # half of it still agrees
            (3, bsd.replace("retain the above copyright notice", "keep this text")),  # a key phrase is missing
            (4, " ".join(sorted(mit))),                                               # its words in another order
            (5, bsd + " " + " ".join(mit)), (6, None), (7, "")]
    found = {i: {(n.label, round(n.share, 2)) for n in r.notices} for i, r in scanned(spark, rows).items()}
    assert found[1] == {("mit", 1.0)} and {x for x, _ in found[2]} == {"mit"} and found[3] == found[4] == set()
    assert found[5] == {("mit", 1.0), ("bsd", 1.0)} and found[6] == found[7] == set()


def test_licenses_of_an_empty_table_and_repeated_rows(spark):
    assert scanned(spark, []) == {}
    out = licenses.scan(brute.frame(spark, [(1, "under the MIT license")] * 3 + [(None, "cc by nc")])).collect()
    assert [len(r.places) for r in out] == [1, 1, 1, 1]


# ---- op12 ----

def collocations_of(rows, least):
    """(lang, phrase) → (a, l, r, n, score) by counting every run of words."""
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(brute.FOLD)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, counts in f.items():
        own = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in own.items():
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                         for q, b in own.items())
            if not inside:
                score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                out[lang, " ".join(p)] = (a, counts[p[:k]], counts[p[k:]], total[lang], score)
    return out


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, "x") for i, (lang, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long, id string")


def mined(spark, rows, least=3):
    return {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score)
            for r in phrases.collocations(corpus(spark, rows), least).collect()}


def test_collocations_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 40)
    monkeypatch.setattr(phrases, "BLOCK", 300)
    monkeypatch.setattr(phrases, "PENDING", 500)
    rng = random.Random(9)
    parts = ["new york", "new york city", "The", "of the", "a, b", "x.y", "São\tPaulo", "hot dog!", "and\nso", "..", "é"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), " ".join(rng.choice(parts) for _ in range(rng.randrange(40))))
            for _ in range(80)]
    rows += [("en", None), ("en", ""), ("fr", " \t "), ("fr", "w" * 500), ("en", "a a a a a a"), ("de", "no stop " * 400)]
    want = collocations_of(rows, 3)
    assert len(want) > 20 and mined(spark, rows) == want
    assert mined(spark, rows, 10 ** 6) == {} and mined(spark, []) == {}


def test_collocation_score_is_exact_beyond_64_bits(spark):
    big = 2 ** 61 + 1
    df = spark.createDataFrame([(big, [big + 5, big], [big + 7, big])], "a long, pre array<long>, suf array<long>")
    row = df.select(F.expr(phrases._CUT).alias("c")).first().c
    assert (row.score, row.l, row.r) == (2000000 * big // (2 * big + 12), big + 5, big + 7)


def test_collocation_ranks_break_ties_by_bytes(spark):
    df = spark.createDataFrame([("en", p, 5, 9) for p in ("b a", "é a", "z a", "a z")] + [("en", "q q", 6, 9)],
                               "lang string, phrase string, a long, score long")
    got = sorted((r["rank"], r.phrase) for r in phrases.ranked(df, 4).collect())
    assert got == [(1, "q q"), (2, "a z"), (3, "b a"), (4, "z a")]


# ---- op13 ----

def hard_of(rows):
    """Every (anchor, positive, rank, negative, scores), by sorting all pairs; rows: (id, vector, label)."""
    use = [(i, [math.floor(256 * x) for x in v], (lab + 1) % 10 if i is not None and i % 7 == 0 else lab)
           for i, v, lab in rows
           if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, va, la in use:
        if a is None or a % 50:
            continue
        pairs = sorted(((-sum(x * y for x, y in zip(va, v)), i is None, i or 0, lab) for i, v, lab in use
                        if i != a and len(v) == len(va)))
        ident = lambda p: None if p[1] else p[2]
        for p in [p for p in pairs if p[3] == la][:5]:
            fits = [n for n in pairs if n[3] != la and 50 * -p[0] <= 100 * -n[0] <= 95 * -p[0]][:3]
            out += [(a, ident(p), k + 1, ident(n), -p[0], -n[0]) for k, n in enumerate(fits)]
    return sorted(out, key=str)


def found_in(spark, rows):
    df = spark.createDataFrame([(i, v, lab, "x", 0) for i, v, lab in rows],
                               "vec_id long, embedding array<double>, label int, key string, number long")
    return sorted((tuple(r) for r in negatives.hard_negatives(df).collect()), key=str)


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(negatives, "TILE", 16)
    monkeypatch.setattr(negatives, "TILE_ANCHORS", 2)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(.3, .4) for _ in range(4)], rng.randrange(3)) for i in range(300)]
    rows += [(1000 + i, [.5, .5, .5, .5], i % 3) for i in range(60)]                        # ties
    rows += [(2000, None, 1), (2050, [1.0] * 4, None), (2100, [float("nan")] * 4, 1), (2150, [None] + [1.0] * 3, 1),
             (2200, [float("inf")] * 4, 0), (2250, [1.0, 1.0], 1), (2251, [.8, .9], 1), (2252, [.6, .7], 2),
             (2300, [], 1), (2301, [], 1), (2302, [], 2), (None, [.5] * 4, 0), (None, [.4] * 4, 1), (2350, [0.0] * 4, 1)]
    rows += [(2401, [.3, .2, .4, .1], 1)] * 3                                                # repeated rows
    want = hard_of(rows)
    assert len(want) > 50 and found_in(spark, rows) == want


def test_hard_negatives_beyond_doubles_and_of_nothing(spark):
    big = [(50, [2.0 ** 21 + 1 / 256, 3.0], 1), (51, [2.0 ** 21, 2.0], 1), (52, [2.0 ** 20 + 5 / 256, 1.0], 2)]
    assert found_in(spark, big) == hard_of(big) != []
    assert found_in(spark, []) == [] and found_in(spark, [(50, None, 1)]) == []


def test_packed_keys_sort_as_their_parts():
    rng = random.Random(4)
    parts = [(rng.choice([-5, 0, 50]), rng.randrange(2), rng.choice([-9, 0, 3, 2 ** 63 - 1, -2 ** 63]),
              rng.random() < .5, rng.choice([None, -1, 0, 7])) for _ in range(300)]
    order = sorted(parts, key=lambda p: (p[0], p[1], -p[2], p[3], p[4] is None, p[4] or 0))
    assert [negatives.unpack(k) for k in sorted(negatives.pack(*p) for p in parts)] == order


def test_windows_open_as_keys_stream_by():
    keys = [negatives.pack(50, 0, 100, False, 1), negatives.pack(50, 0, 96, True, 2), negatives.pack(50, 0, 95, True, 3),
            negatives.pack(50, 0, 0, True, 4), negatives.pack(100, 1, 95, True, 5)]
    assert list(negatives.opened(iter(sorted(keys)))) == [(50, 1, 1, 3, 100, 95)]


def test_collocation_groups_are_exchanged_once(spark, monkeypatch):
    """What goes back to the blocks is read from the counted rows: no join of all groups with the frequent ones."""
    plans, own = [], phrases.semi_join

    def spy(relation, frequent):
        plans.append(frequent._jdf.queryExecution().optimizedPlan().toString())
        return own(relation, frequent)

    monkeypatch.setattr(phrases, "semi_join", spy)
    docs = spark.createDataFrame([("a b c d e. a b c d x", None), ("a b c d e", "en"), (None, "en")], "text string, lang string")
    _, tables = phrases.mined(docs, 2)
    assert len(plans) == 3 and not any("Join" in p for p in plans)
    assert [sorted((r.lang, bytes(r.phrase).decode(), r.n) for r in t.collect()) for t in tables[2:]] == [
        [("und", "a b c", 2), ("und", "b c d", 2)], [("und", "a b c d", 2)]]
    assert all(t.select("id").distinct().count() == t.count() for t in tables)


def test_collocation_relations_are_not_exchanged_and_no_shuffle_files_stay(spark, monkeypatch):
    """The semi-join exchanges the frequent groups alone, and a pass's shuffle files go with it."""
    plans, own = [], phrases.semi_join

    def spy(relation, frequent):
        out = own(relation, frequent)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    def shuffled():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
        return {b for b in blocks.split() if b.startswith("shuffle_")}

    monkeypatch.setattr(phrases, "semi_join", spy)
    docs = spark.createDataFrame([("a b c d e. a b c d x", None), ("a b c d e", "en"), (None, "en")], "text string, lang string")
    before = shuffled()
    phrases.mined(docs, 2)
    assert [p.count("Exchange") for p in plans] == [1, 1, 1] and all("Bucketed: true" in p for p in plans)
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("occurrences_", "relation"))]


def test_collocation_groups_are_a_row_a_block_and_bucket(spark):
    """The groups of a block are dealt by bucket, and numbered in the order in which they are sent."""
    step, grp, ids = np.ones(400, np.int32), np.arange(400, dtype=np.int32) * 7 % 31, np.arange(100, 131, dtype=np.int64)
    at, own, (bucket, left, right, n) = phrases.merge_join(step, grp, ids, 5)
    assert len(at) == 399 and n.sum() == 399 and (np.diff(bucket) >= 0).all() and 0 <= bucket.min() <= bucket.max() < 5
    assert (left[own] == ids[grp[:-1]]).all() and (right[own] == ids[grp[1:]]).all()
    kept = spark.createDataFrame([(1, step.tolist(), grp.tolist(), ids.tolist()), (2, [], [], []), (3, [1], [0], [9])],
                                 "block long, step array<int>, grp array<int>, ids array<long>")
    packed = phrases.joined_groups(kept, 5, "long")
    assert packed.count() == len(set(bucket.tolist()))
    got = sorted((r.bucket, r.gid, r.l, r.r, r.n) for r in phrases._dealt(packed, 5).collect())
    assert got == [(*map(int, x[:1]), i, *map(int, x[1:])) for i, x in enumerate(zip(bucket, left, right, n))]


def test_collocations_with_numbers_beyond_ints(spark, monkeypatch):
    rows = [("en", "new york city. new york"), ("de", "new york"), ("en", "new york city a b"), (None, "a b a b")] * 3
    want = collocations_of(rows, 3)
    assert mined(spark, rows) == want
    monkeypatch.setattr(phrases, "INTS", 0)
    monkeypatch.setattr(phrases, "BLOCK", 20)
    assert want and mined(spark, rows) == want
