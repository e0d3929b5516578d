"""Importance resampling, collocations and byte-level BPE against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetta.llm import byte_bpe, collocations, entries, resampling
from vetta.llm.common import table

UPPER_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- importance resampling --------------------------------------------------

def runs_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER_LOWER))
    return words, [" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute_draw(docs, target, percent=5, buckets=10_000, least=20):
    def counts(texts):
        return Counter(zlib.crc32(r.encode()) % buckets for t in texts for r in runs_of(t)[1])
    s, t = counts(x for _, x in docs), counts(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in s}
    rows = []
    for i, x in docs:
        words, runs = runs_of(x)
        weight = sum(gain[zlib.crc32(r.encode()) % buckets] for r in runs)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(runs), weight, score, len(words)))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    places = {}
    for k, r in enumerate(fit[:percent * len(fit) // 100], start=1):
        places.setdefault(r[:4], []).append(k)
    return rows, places


def check_draw(got, docs, target, percent=5):
    rows, places = brute_draw(docs, target, percent)
    assert sorted(map(repr, (r[:4] for r in rows))) == sorted(map(repr, (tuple(r)[:4] for r in got)))
    drawn = {}
    for r in got:
        if r["rank"] is not None:
            drawn.setdefault(tuple(r)[:4], []).append(r["rank"])
    assert {k: sorted(v) for k, v in drawn.items()} == places


COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def test_draw_equals_brute_force_on_the_table(spark, sf_dir):
    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    target = [r[0] for r in table(spark, sf_dir, "benchmark").select("text").collect()]
    check_draw(entries.op11_importance_resampling(spark, sf_dir).collect(), docs, target)


def test_draw_with_nulls_repeats_and_long_words(spark, corpus, words):
    rng = random.Random(5)
    same = " ".join(rng.choice(words) for _ in range(30))
    docs = corpus + [(None, same), (None, same), (7, same), (7, same), (2 ** 60, same), (2 ** 60 + 1, same),
                     (500, "y" * 70 + " " + "z" * 129 + " \x7f\x00A1é " * 12), (501, "w" * 64 + "'" + "v" * 65)]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, rank int, weight string").repartition(4)
    target = [same, None, "y" * 70 + " " + "z" * 129, ""]
    out = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=40)
    assert out.columns == ["doc_id", "rank", "weight", "n_words", "n_features", "_weight", "score", "_rank"]
    got = out.select("doc_id", "n_features", F.col("_weight").alias("weight"), "score", F.col("_rank").alias("rank")).collect()
    check_draw(got, docs, target, 40)


def test_draw_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    out = resampling.resample(empty, empty)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"] and out.collect() == []
    one = resampling.resample(spark.createDataFrame([(1, None)], "doc_id long, text string"), empty).collect()
    assert [tuple(r)[:4] for r in one] == [(1, 0, 0, 0)] and one[0]["rank"] is None


@pytest.mark.parametrize("k", [0, 1, 2, 57, 299, 300, 301])
def test_kth_key_of_tied_scores(spark, k):
    rng = random.Random(k)
    rows = [(rng.randint(0, 3), rng.randint(0, 5), i) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b int, c int").repartition(3).cache()
    want = sorted(rows)[k - 1] if 0 < k <= 300 else None
    assert resampling.kth_key(df, ["a", "b", "c"], k, pivots=5) == want


# --- collocations -----------------------------------------------------------

def brute_phrases(rows, longest=3, least=10, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i:i + k])
                    f[key] = f.get(key, 0) + 1
    out = []
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longer = {}
    for (lang, w), a in cand.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                key = lang, w[i:i + size]
                longer[key] = max(longer.get(key, 0), a)
    for (lang, w), a in cand.items():
        if 100 * longer.get((lang, w), 0) >= 50 * a:
            continue
        score, _, left, right = min((10 ** 6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]])
                                    for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], k, *r[1:]) for k, r in enumerate(own[:top], start=1)]
    return sorted(ranked)


@pytest.fixture(scope="module")
def speech():
    """Few words, so that phrases repeat; odd spaces and marks, null languages."""
    rng = random.Random(11)
    common = ["the", "of", "A", "é", "\x1f", "日本", "x" * 300, "no-one"]
    rows = []
    for i in range(260):
        words = [rng.choice(common) if rng.random() < .7 else f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " \r\n", ";!"]) for w in words)
        rows.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), text))
    rows += [("en", "kept whole phrase " * 40), ("en", "kept whole phrase"), ("en", None), ("de", ""), (None, " . \n"),
             ("en", "the of " * 400), ("xx", "rare words only")]
    return rows


@pytest.mark.parametrize("longest, least, top, budget", [(3, 10, 2000, 1 << 20), (3, 10, 20, 500), (3, 4, 2000, 60), (4, 3, 50, 10), (2, 5, 7, 100)])
def test_phrases_equal_brute_force(spark, speech, longest, least, top, budget):
    df = spark.createDataFrame([(*r, 1, "p") for r in speech], "lang string, text string, n int, phrase string").repartition(6)
    got = collocations.collocations(df, longest=longest, least=least, top=top, budget=budget)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(speech, longest, least, top)


def test_frequent_counts_by_broadcast_give_the_same(spark, speech, monkeypatch):
    df = spark.createDataFrame(speech, "lang string, text string")
    monkeypatch.setattr(collocations, "TABLE_ROWS", 6)
    words, phrases = collocations.phrase_counts(df, least=4, budget=50)
    often, threshold = collocations.largest(words, 1, 6)
    assert 0 < often.count() <= 6 and threshold > 1
    got = collocations.collocations(df, least=4, budget=50)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(speech, 3, 4)


def test_phrases_of_an_empty_table(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(df).collect() == []
    only_null = spark.createDataFrame([(None, None)], "lang string, text string")
    assert collocations.collocations(only_null).collect() == []


def test_scores_past_64_bits_are_exact(spark):
    # the expression of the scores alone, on counts that no test text could hold
    a, left, right = 9_999_999_999_999, 10_000_000_000_007, 12_345_678_901_234
    row = spark.range(1).select(F.expr(
        f"(cast(1000000 as decimal(7,0)) * cast({a} as decimal(18,0)) * cast({a} as decimal(18,0)))"
        f" div (cast({left} as decimal(18,0)) * cast({right} as decimal(18,0)))").alias("s")).first()
    assert row["s"] == 10 ** 6 * a * a // (left * right)


# --- byte-level BPE ---------------------------------------------------------

@pytest.fixture(scope="module")
def vocab():
    return byte_bpe.vocabulary(entries.byte_vocabulary())


def nasty_texts():
    rng = random.Random(2)
    parts = [" ", "  ", "\t", "\n", " \n", "  ", "　", "\x85", "\x1c ", "a", "the", " s", "'s", " 're", "'", "12", "3", "!?", "..",
             "<|endoftext|>", "<|endo", "text|> ", "日本", " 語", "é", "ß ", "🙂", "x" * 40, "Ġ", "  "]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    shared = " ".join(rng.choice(["shared", "passage", "of", "words,", "日本", "it's"]) for _ in range(500))
    out += [x[:rng.randint(0, 99)] + " " + shared for x in out[:40]]
    return out + ["", "x" * 30_000, "a b " * 4000, " " * 3000, "日本語" * 3000, "\n" * 500 + " a"]


@pytest.mark.parametrize("bits", [3, 6, 10])
def test_chunks_equal_the_library(vocab, bits):
    tok = byte_bpe.load(vocab)
    enc = byte_bpe.Chunks(tok, byte_bpe.token_sizes(vocab), bits=bits, limit=200_000)
    texts = nasty_texts()
    for i in range(0, len(texts), 50):
        part = [t.encode() for t in texts[i:i + 50]]
        offsets = np.cumsum([0] + [len(p) for p in part])
        got = enc.encode(np.frombuffer(b"".join(part), dtype=np.uint8), offsets)
        want = tok.encode_batch(texts[i:i + 50], add_special_tokens=False)
        assert [g.tolist() for g in got] == [w.ids for w in want]


def test_equal_passages_are_encoded_once_and_joins_repaired(vocab):
    tok = byte_bpe.load(vocab)
    enc = byte_bpe.Chunks(tok, byte_bpe.token_sizes(vocab), bits=6)
    rng = random.Random(4)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(3000))
    texts = [f"{'unlike ' * k}{passage}" for k in range(20)]
    part = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(part), dtype=np.uint8), np.cumsum([0] + [len(p) for p in part])
    chunks = enc.chunks(data, offsets)
    assert all(len(c) > 20 for c in chunks) and len({x for c in chunks for x in c}) < 3 * len(chunks[0])
    got = enc.encode(data, offsets)
    assert enc.encoded < 2 * len(passage) and enc.whole == 0
    assert [g.tolist() for g in got] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_disagreeing_windows_widen_and_end_with_the_whole_text(vocab):
    """A table with wrong ids beside the joins: the repair must not accept them."""
    tok = byte_bpe.load(vocab)
    enc = byte_bpe.Chunks(tok, byte_bpe.token_sizes(vocab), bits=5)
    text = " ".join(f"word{i}" for i in range(400)).encode()
    data, offsets = np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)])
    for c in enc.chunks(data, offsets)[0]:
        enc.learn([c])
        ids, places, at = enc.table[c]
        bad = ids.copy()
        bad[max(0, at[-1] - 2):] = 0
        enc.table[c] = bad, places, at
    got = enc.encode(data, offsets)[0]
    assert got.tolist() == tok.encode(text.decode(), add_special_tokens=False).ids
    assert enc.widened > 0 and enc.whole == 1


def test_other_vocabularies_get_whole_texts(vocab):
    import public_tokenizers
    other = byte_bpe.vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    assert byte_bpe.splits_at_spaces(vocab) and not byte_bpe.splits_at_spaces(other)
    texts = [b"", "Some  TEXT é".encode()]
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    want = byte_bpe.load(other).encode_batch([t.decode() for t in texts], add_special_tokens=False)
    assert [g.tolist() for g in byte_bpe.encoder(other).encode(data, offsets)] == [w.ids for w in want]


def test_rows_equal_the_library(spark, docs, corpus, vocab):
    tok = byte_bpe.load(vocab)
    want = {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in corpus}
    out = byte_bpe.encode_decode(docs, entries.byte_vocabulary())
    assert out.columns == [*docs.columns, "_ids", "decoded"]        # the table has a column ids
    got = {r["doc_id"]: r for r in out.collect()}
    assert {i: r["_ids"] for i, r in got.items()} == want
    assert {i: r["decoded"] for i, r in got.items()} == {i: tok.decode(v, skip_special_tokens=False) for i, v in want.items()}
    packed = byte_bpe.encode_decode(docs.select("doc_id", "text"), entries.byte_vocabulary(), packed=True).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packed} == want


def test_query_digests(spark, sf_dir, vocab):
    tok = byte_bpe.load(vocab)
    got = {r["doc_id"]: r for r in entries.op13_byte_bpe(spark, sf_dir).collect()}
    for i, t in table(spark, sf_dir, "documents").select("doc_id", "text").collect():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty_table(spark, empty):
    out = byte_bpe.encode_decode(empty, entries.byte_vocabulary())
    assert out.collect() == []
