"""Exact operators against brute force: copies, repeated passages,
near-duplicates, top-k, mixing, components."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetta.llm import bloom, exact_dedup, jaccard_join, mixing, substring_dedup, topk
from vetta.llm.common import word_count
from vetta.llm.components import components

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Union:
    def __init__(self, names):
        self.up = {n: n for n in names}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# ---- exact dedup

def copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    return groups


def test_exact_dedup(docs, corpus):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(exact_dedup.with_hash(docs)).collect()}
    assert len(got) == len(corpus)
    for text, ids in copies(corpus).items():
        for i in ids:
            r = got[i]
            assert (r["_keep_id"], r.group_size, r.kept) == (max(ids), len(ids), i == max(ids))
            assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
            assert (r.keep_id, r.row, r.hit) == (1, "z", 3)         # own columns untouched


def test_exact_dedup_with_a_full_filter(docs, corpus, monkeypatch):
    """False hits of a far too small filter cost shuffles, not answers."""
    monkeypatch.setattr(bloom, "filter_bits", lambda n: 4)
    kept = exact_dedup.deduplicated(exact_dedup.with_hash(docs)).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted(max(ids) for ids in copies(corpus).values())


def test_exact_dedup_odd_rows(spark, empty):
    assert exact_dedup.exact_dedup(exact_dedup.with_hash(empty)).count() == 0
    rows = [(1, "a"), (1, "a"), (None, "A"), (None, "b"), (2, None), (3, "")]
    df = exact_dedup.with_hash(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter((r.doc_id, r.text, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect())
    assert got == Counter({(1, "a", 1, 3, True): 2, (None, "A", 1, 3, False): 1, (None, "b", None, 1, True): 1,
                           (2, None, 3, 2, False): 1, (3, "", 3, 2, True): 1})
    assert Counter(r.doc_id for r in exact_dedup.deduplicated(df).collect()) == Counter([1, None, 3])


def test_without(spark, docs, corpus):
    dropped = spark.createDataFrame([(i,) for i in range(0, 200, 3)], "id long")
    left = bloom.without(docs, "doc_id", dropped)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _ in corpus if i % 3 or i >= 200)


# ---- substring dedup

def repeats(rows, n):
    first, out = {}, {}
    for i, t in sorted((i, t) for i, t in rows if i is not None):
        w = WORD.findall(t or "")
        for a in range(len(w) - n + 1):
            k = tuple(w[a:a + n])
            first[k] = min(first.get(k, i), i)
    for i, t in rows:
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for a in range(len(w) - n + 1):
            if i is not None and first[tuple(w[a:a + n])] < i:
                keep[a:a + n] = [False] * n
        out[i] = (len(w), keep.count(False), " ".join(x for x, k in zip(w, keep) if k))
    return out


@pytest.mark.parametrize("block_bytes", [2 << 20, 5000, 300])
def test_substring_dedup(docs, corpus, block_bytes):
    want = repeats(corpus, 13)
    rows = substring_dedup.remove_repeats(docs, block_bytes=block_bytes).collect()
    assert {r.id: (r.n_words, r.n_removed, r.kept) for r in rows} == want
    texts = {i: WORD.findall(t or "") for i, t in corpus}
    for r in rows:                              # the factors are the removed words
        covered = {p for f in r.factors for p in range(f.first_word, f.first_word + f.n_words)}
        assert len(covered) == r.n_removed
        for f in r.factors:
            phrase = " ".join(texts[r.id][f.first_word:f.first_word + 13])
            assert f.source < r.id and phrase in " ".join(texts[f.source])


def test_substring_dedup_other_windows(docs, corpus):
    got = {r.id: r.kept for r in substring_dedup.remove_repeats(docs, window=4, seed=2, block_bytes=4000).collect()}
    assert got == {i: w[2] for i, w in repeats(corpus, 4).items()}


def test_substring_dedup_odd_rows(spark, empty):
    assert substring_dedup.remove_repeats(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(None, text), (5, text), (5, text), (7, text), (None, text)]
    got = Counter((r.id, r.n_removed) for r in substring_dedup.remove_repeats(
        spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(None, 0): 2, (5, 0): 2, (7, 20): 1})


@pytest.mark.parametrize("block_bytes", [2 << 20, 40])
def test_substring_dedup_of_large_ids_beside_null(spark, block_bytes):
    """Ids that no double holds, null ids and one id with two texts."""
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(2 ** 60, a), (2 ** 60 + 1, a), (2 ** 60 + 2, a), (None, a), (None, b), (3, b), (3, a + " " + b), (2 ** 62, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df, block_bytes=block_bytes).collect())
    assert got == Counter({(2 ** 60, 30, 30): 1, (2 ** 60 + 1, 30, 30): 1, (2 ** 60 + 2, 30, 30): 1, (None, 30, 0): 2,
                           (3, 30, 0): 1, (3, 60, 0): 1, (2 ** 62, 30, 30): 1})


# ---- near-duplicates

def near(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[a:a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    join = Union(sets)
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    join.join(a, b)
    return {i: (len(sets[i]), join.find(i)) for i in ids}


def found(df):
    return {r.id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()}


def test_near_duplicates(docs, corpus):
    assert found(docs) == near(corpus)


def test_near_duplicates_in_blocks(docs, corpus, monkeypatch):
    """Every shingle is frequent, regions are joined in blocks of a few members."""
    monkeypatch.setattr(jaccard_join, "HEAVY", 1)
    monkeypatch.setattr(jaccard_join, "GRID_MEMBERS", 3)
    monkeypatch.setattr(jaccard_join, "GRID_OUTSIDE", 2)
    assert found(docs) == near(corpus)


def test_near_duplicates_of_one_group(spark):
    """One large group: chains of copies with more and more other words."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(len(text))] = f"x{rng.random()}"
        rows.append((i, " ".join(text)))
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == near(rows)


def test_heavy_postings_meet_in_no_group(spark, docs, monkeypatch):
    """Rows of frequent shingles pass batch by batch; the sketch and the blocks
    grow with the input."""
    monkeypatch.setattr(jaccard_join, "HEAVY", 1)
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    packed = jaccard_join.postings(texts, jaccard_join.count_sketch(texts, 22), 4)
    assert [r.bucket for r in packed.select("bucket").distinct().collect()] == [4]      # every row is heavy
    got = jaccard_join.meeting_places(packed, 4)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and got.count() > 0
    assert [jaccard_join.sketch_bits(n) for n in (0, 25_000_000, 60_000_000, 30_000_000_000)] == [22, 22, 24, 24]


def test_near_duplicates_in_blocks_of_shingles(docs, corpus, monkeypatch):
    """Few members with large sets are many blocks, too."""
    monkeypatch.setattr(jaccard_join, "GRID_KEYS", 400)
    assert found(docs) == near(corpus)


def test_signatures_rule_out_no_link():
    """Signatures of any sizes differ in no more bits than their sets in shingles,
    and tell sets apart that are far from a link."""
    rng = np.random.default_rng(3)
    told = 0
    for _ in range(400):
        own, both, other = rng.integers(0, 60), rng.integers(1, 900), rng.integers(0, 400)
        keys = rng.integers(0, 1 << 63, own + both + other, dtype=np.uint64)
        x, y = np.sort(keys[:own + both]), np.sort(keys[own:])
        bits = jaccard_join.differing(*(jaccard_join.signature(k).view(np.uint64) for k in (x, y)))
        assert bits <= own + other
        links = 100 * both >= 75 * (own + both + other)
        may = bool(jaccard_join.may_link(len(x), len(y), bits))
        assert may or not links
        assert 2 * bits / (len(x) + len(y) + bits) <= 1 - both / (own + both + other) + 1e-12
        told += not may
        assert not may or 100 * both >= 60 * (own + both + other) or len(x) + len(y) < 200
    assert told > 100


def test_few_sets_move(spark, monkeypatch):
    """Sets that share a shingle and little else are told apart by signatures: no
    exact distance is asked for."""
    rows = [(i, " ".join(["same", "five", "words", "in", "all"] + [f"w{i}x{j}" for j in range(200)])) for i in range(12)]
    rows += [(100, rows[0][1] + " more"), (101, rows[1][1] + " more")]
    asked, distances = [], jaccard_join.distances

    def counted(pairs, sets):
        asked.append(pairs.count())
        return distances(pairs, sets)

    monkeypatch.setattr(jaccard_join, "distances", counted)
    monkeypatch.setattr(jaccard_join, "HEAVY", 1)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == near(rows)
    assert 0 < sum(asked) <= 6


def test_blocks_with_many_pairs_are_joined_whole(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        text = [f"w{j}" for j in range(120)]
        for _ in range(rng.randint(0, 8)):
            text[rng.randrange(len(text))] = f"x{rng.random()}"
        rows.append((i, " ".join(text)))
    joined, block_links = [], jaccard_join.block_links
    monkeypatch.setattr(jaccard_join, "LIGHT", -1)
    monkeypatch.setattr(jaccard_join, "block_links", lambda *a: joined.append(1) or block_links(*a))
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == near(rows)
    assert joined


def test_texts_of_chosen_rows_stay(spark, monkeypatch):
    """The rows asked for are found without a shuffle of their texts, also where the
    filter of their keys lets others through: only those that it cannot tell move."""
    monkeypatch.setattr(jaccard_join.bloom, "filter_bits", lambda n: 15 if n == 2000 else 18)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(12_000)], "id long, text string").repartition(3)
    docs = docs.select("id", "text", jaccard_join.row_key("id", "text").alias("row_key"))
    chosen = jaccard_join.staged(docs.where("id % 6 = 0").select("row_key"), "chosen")
    told, looked_up = jaccard_join.rows_of(docs, docs, chosen)
    assert "hashpartitioning" not in told.select("text")._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in told._jdf.queryExecution().executedPlan().toString() for x in ("SortMergeJoin", "ShuffledHashJoin"))
    few, many = looked_up.count(), told.count()
    assert few + many == 2000 and few < 100
    assert {r.id for r in told.unionByName(looked_up).collect()} == set(range(0, 12_000, 6))


def test_regions_are_told_apart_without_their_members(spark, monkeypatch):
    """A bucket gives a row for each region, those with the same members once."""
    base = [f"w{j}" for j in range(100)]
    rows = [(i, " ".join(base + [f"x{i}"])) for i in range(5)] + [(5, " ".join(f"y{j}" for j in range(40)))]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(2)
    packed = jaccard_join.postings(docs, jaccard_join.count_sketch(docs, 22), 1)
    places = jaccard_join.staged(jaccard_join.meeting_places(packed, 1), "places")
    assert [r.size for r in places.collect()] == [5]
    regions = jaccard_join.merged(places).collect()
    assert len(regions) == 5 and len({r.node for r in regions}) == 5 and {r.n for r in regions} == {97}


def test_near_duplicates_odd_rows(spark, empty):
    assert jaccard_join.near_duplicates(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(4, text), (4, text.upper()), (None, text), (9, text + " more"), (6, None), (7, " ")]
    got = Counter(tuple(r) for r in jaccard_join.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string")).select("id", "n_shingles", "component_id").collect())
    assert got == Counter({(4, 26, 4): 2, (None, 26, 4): 1, (9, 27, 4): 1, (6, 0, 6): 1, (7, 0, 7): 1})


def test_near_duplicates_without_ids(spark):
    """Sets that only rows without an id hold link as others do, and of each
    component one row stays, also where an id has two texts."""
    words = [f"w{i}" for i in range(120)]
    bridge, right = " ".join(words), " ".join(words[:100] + [f"r{i}" for i in range(12)])
    left = " ".join([f"l{i}" for i in range(12)] + words[12:])
    other, lone = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    rows = [(3, left), (None, bridge), (None, bridge), (8, right), (1, other), (None, other + " more"), (8, lone),
            (None, other + " most"), (None, "z1 z2 z3 z4 z5 z6 z7 z8"), (None, "z1 z2 z3 z4 z5 z6 z7 z8"), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.text, r.component_id) for r in jaccard_join.near_duplicates(df).join(
        df.select("text", jaccard_join.row_key("doc_id", "text").alias("row_key")), "row_key").collect()}
    assert got == {(left, 3), (bridge, 3), (right, 3), (other, 1), (other + " more", 1), (other + " most", 1), (lone, 8),
                   (rows[8][1], None), (None, None), ("", None)}
    import corpus_pipeline
    left_over = Counter(map(tuple, corpus_pipeline.drop_near_copies(spark, df, "").collect()))
    assert left_over == Counter([(3, left), (1, other), (8, lone), rows[8], (None, None), (None, "")])


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(30)]
    nodes = list(range(200))
    join = Union(nodes)
    for a, b in links:
        join.join(a, b)
    got = components(spark.createDataFrame([(n, n) for n in nodes], "node long, name long"),
                     spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == {n: join.find(n) for n in {x for p in links for x in p}}


# ---- top-k

def best(rows, asked, k):
    out = []
    for q, v in asked:
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(v, w)), i) for i, w in rows if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("size", [3, 1 << 40])
def test_top_k(spark, monkeypatch, size):
    """Ties, grids of many cells, and products beyond 2^53."""
    monkeypatch.setattr(topk, "ROW_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-size, size)) if size < 10 else float(rng.randint(-3, 3)) * 2.0 ** 25 for _ in range(6)])
            for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    for k in (5, 300):
        got = topk.top_k(df, df.where("id % 10 = 0"), k).collect()
        assert sorted(map(tuple, got)) == best(rows, [r for r in rows if r[0] % 10 == 0], k)


def test_top_k_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]),
            (5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, []), (7, [3.0, 4.0, 5.0]), (8, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = sorted(map(tuple, topk.top_k(df, df, 5).collect()))
    assert got == [(0, 1, 5, 5), (0, 2, 8, -1), (5, 1, 0, 5), (5, 2, 8, -1), (8, 1, 0, -1), (8, 2, 5, -1)]
    assert topk.top_k(df.where("false"), df.where("false"), 5).count() == 0


# ---- mixing

def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, f"s{rng.randrange(9)}" if rng.random() < 0.6 else "s0", rng.randint(0, 300), "own") for i in range(3000)]
    rows += [(9000 + i, None, 40, "own") for i in range(30)] + [(9999, "zero", 0, "own")]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, target string")
    got = mixing.mix(df, "size").collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows) and {r.target for r in got} == {"own"}
    sizes = Counter()
    for _, s, n, _ in rows:
        sizes[s] += n
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, capped, share = {}, set(), 1.5 * sum(sizes.values())
    while True:                                 # clamp, share again
        left = share - sum(2 * sizes[s] for s in capped)
        level = left / max(1, sum(weight[s] for s in order if s not in capped))
        target = {s: 2 * sizes[s] if s in capped else weight[s] * level for s in order}
        over = {s for s in order if s not in capped and target[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    taken = Counter()
    for r in got:
        assert r["_target"] == pytest.approx(target[r.source]) and 0 <= r.repeats <= 2 and r.source_size == sizes[r.source]
        taken[r.source] += r.size * r.repeats
    for s in order:
        assert abs(taken[s] - target[s]) <= 300
    again = mixing.mix(df.repartition(7), "size").collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixing_odd_rows(spark, empty):
    assert mixing.mix(empty.withColumn("source", F.lit("a")), "words").count() == 0
    df = spark.createDataFrame([(1, None, None), (1, None, None), (None, "a", " ")], "doc_id long, source string, text string")
    got = mixing.mix(df.withColumn("size", word_count(F.col("text"))), "size").collect()
    assert [(r.target, r.repeats) for r in got] == [(0.0, 0)] * 3 or all(r.target == 0 for r in got)


def test_word_count(docs, corpus):
    got = {r.doc_id: r.n for r in docs.select("doc_id", word_count(F.col("text")).alias("n")).collect()}
    assert got == {i: len(WORD.findall(t or "")) for i, t in corpus}
