import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vetta.functions import text
from vetta.functions import text as T
from vetta.functions import vectors as V
from vetta.operators import analyse, blend, features, learn, pairs, pairstats, profile, rank, select
from vetta.plans import ordered
from vetta.plans.ordered import exact_quantiles, value_places


def seg_df(spark, rows):
    return spark.createDataFrame(rows, "row_id string, doc_id long, tgt_system string, src_lang string, "
                                       "tgt_lang string, score double, sig double")


# --- rank statistics ----------------------------------------------------------------

def test_tau_hand_cases(spark):
    rows = [
        ("a1", 1, "S1", "en", "de", 10.0, 1.0), ("a2", 1, "S2", "en", "de", 20.0, 2.0),   # n=2 -> 1
        ("b1", 2, "S1", "en", "de", 10.0, 1.0), ("b2", 2, "S2", "en", "de", 20.0, 1.0),   # constant pred
        ("c1", 3, "S1", "en", "de", None, 1.0), ("c2", 3, "S2", "en", "de", 20.0, 2.0),   # null gold
        ("d1", 4, "S1", "en", "de", 5.0, 3.0),                                             # one row
        ("e1", 5, "S1", "en", "de", 1.0, 1.0), ("e2", 5, "S2", "en", "de", 1.0, 2.0),
        ("e3", 5, "S3", "en", "de", 2.0, 3.0),                                             # ties in gold
    ]
    t = {r.doc_id: r.tau for r in rank.tau_by_group(seg_df(spark, rows), ["sig"]).collect()}
    assert t[1] == pytest.approx(1.0)
    assert t[2] is None
    assert t[3] is None
    assert 4 not in t
    # x=(1,2,3), y=(1,1,2): s=2, n0=3, tx=0, ty=1 -> 2/sqrt(3*2)
    assert t[5] == pytest.approx(2 / math.sqrt(6))
    m = rank.kendall_per_source(seg_df(spark, rows), ["sig"]).first()
    assert m.per_source_tau == pytest.approx(round((1.0 + 2 / math.sqrt(6)) / 2, 6), abs=2e-6)
    assert m.n_docs == 2


def test_tau_properties(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=60)
    y = x + rng.normal(size=60)
    df = spark.createDataFrame([(float(a), float(b), float(-b), float(np.exp(a)))
                                for a, b in zip(x, y)], "x double, y double, ny double, ex double")
    res = {r.sig: r.tau for r in pairs.pairstats.concordance(df, [], "y", ["x", "ex"]).withColumnRenamed(
        "signal", "sig").collect()}
    neg = pairs.pairstats.concordance(df, [], "ny", ["x"]).first().tau
    assert -1 <= res["x"] <= 1
    assert res["x"] == pytest.approx(res["ex"])          # monotone transform
    assert neg == pytest.approx(-res["x"])               # tau(x, -y) = -tau(x, y)
    self_tau = pairs.pairstats.concordance(df, [], "x", ["x"]).first().tau
    assert self_tau == pytest.approx(1.0)


def test_spa_band_and_predicted_tie(spark):
    # system means: gold A=50, B=80, C=60 ; pred A=1, B=1, C=2
    rows = [("1", 1, "A", "en", "de", 50.0, 1.0), ("2", 1, "B", "en", "de", 80.0, 1.0),
            ("3", 1, "C", "en", "de", 60.0, 2.0)]
    spa = rank.soft_pairwise_accuracy(seg_df(spark, rows), ["sig"]).first().spa
    # A-B: |30| >= 25, predicted tie -> miss; A-C: inside band; B-C: inside band
    assert spa == pytest.approx(2 / 3)
    one = rank.soft_pairwise_accuracy(seg_df(spark, rows[:1]), ["sig"]).first().spa
    assert one == 0.0
    exact = [("1", 1, "A", "en", "de", 50.0, 2.0), ("2", 1, "B", "en", "de", 75.0, 1.0)]
    assert rank.soft_pairwise_accuracy(seg_df(spark, exact), ["sig"]).first().spa == 0.0


def test_pearson_constant_is_null(spark):
    rows = [("1", 1, "A", "en", "de", 1.0, 3.0), ("2", 1, "B", "en", "de", 2.0, 3.0)]
    assert rank.pearson(seg_df(spark, rows), ["sig"]).first().pearson is None


def test_pair_agreement_exact_band(spark):
    rows = [("1", 1, "A", "en", "de", 10.0, 1.0), ("2", 1, "B", "en", "de", 11.0, 2.0),   # exactly 1.0: not a tie
            ("3", 1, "C", "en", "de", 10.5, 0.0)]
    r = analyse.pair_agreement(seg_df(spark, rows), ["sig"]).first()
    # pairs: (1,2) gap 1.0 agree ; (1,3) tie ; (2,3) tie
    assert (r.agree, r.disagree, r.tie) == (1, 0, 2)


# --- order statistics -----------------------------------------------------------------

def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = rng.integers(0, 30, 257).astype(float)
    df = spark.createDataFrame([(float(v), int(i % 3)) for i, v in enumerate(vals)], "v double, g int")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    q = ordered.exact_quantiles(df, "v", probs).first()
    for i, p in enumerate(probs):
        assert q[f"q{i}"] == pytest.approx(np.percentile(vals, p * 100))
    by = {r.g: r for r in ordered.exact_quantiles(df, "v", [0.5], by=["g"]).collect()}
    for g in range(3):
        assert by[g].q0 == pytest.approx(np.median(vals[np.arange(len(vals)) % 3 == g]))


def test_with_position_is_dense(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    p = ordered.with_position(df, [F.col("k"), F.col("id")]).select("_pos").collect()
    assert sorted(r._pos for r in p) == list(range(1000))


def test_prefix_sum(spark):
    df = spark.range(500).withColumn("w", (F.col("id") % 5).cast("double"))
    got = ordered.with_prefix_sum(df, [F.col("id")], "w").orderBy("id").select("_before").collect()
    w = np.arange(500) % 5
    exp = np.cumsum(w) - w
    assert [r._before for r in got] == pytest.approx(list(exp))


def test_histogram_top_edge_and_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (100.0,), (55.0,), (101.0,), (-1.0,)], "score double")
    h = {r.bin: r for r in profile.score_histogram(df).collect()}
    assert len(h) == 10
    assert h[0]["count"] == 1 and h[9]["count"] == 1 and h[5]["count"] == 1
    assert h[3]["count"] == 0 and h[3].bar == ""
    assert h[0].bar == "#" * 40


def test_quintiles_duplicate_edges(spark):
    # many equal values: qcut drops duplicate edges -> edges [0, 50, 100];
    # right-closed bins, lowest included: 0 and 50 in bin 0, 100 in bin 1 (as pandas)
    vals = [0.0] * 10 + [50.0] * 5 + [100.0] * 5
    df = spark.createDataFrame([(v, v / 100) for v in vals], "score double, sig double")
    q = {r.bin: r.n for r in analyse.gold_quintiles(df, ["sig"]).collect()}
    assert q == {0: 15, 1: 5}


# --- text, spans, vectors -----------------------------------------------------------------

def test_clean_text_edge_rows(spark):
    rows = [("1", "ok", " fine\t"), ("2", None, "x"), ("3", "", "x"), ("4", "   ", "x"),
            ("5", "nan", "x"), ("6", "\n a \n", "b")]
    df = spark.createDataFrame(rows, "row_id string, src_text string, tgt_text string")
    out = {r.row_id: (r.src_text, r.tgt_text) for r in T.clean_text(df).collect()}
    assert out == {"1": ("ok", "fine"), "6": ("a", "b")}


def test_word_count_and_ratios(spark):
    df = spark.createDataFrame([("a  b\tc", "x y"), ("", "z"), (None, "z")], "s string, t string")
    r = df.select(T.word_count("s").alias("w"), T.ratio_floor1(T.word_count("t"), T.word_count("s")).alias("r")) \
        .collect()
    assert [x.w for x in r] == [3, 0, None]
    assert r[0].r == pytest.approx(2 / 3) and r[1].r == 1.0 and r[2].r is None


def test_clip_invert_and_indicators(spark):
    df = spark.createDataFrame([(-1.0, "zh"), (30.0, None), (None, "de"), (10.0, "de")], "e double, l string")
    r = df.select(T.clip_invert("e").alias("q"), T.indicator("l", "zh").alias("z")).collect()
    assert [x.q for x in r] == [25.0, 0.0, None, 15.0]
    assert [x.z for x in r] == [1.0, 0.0, 0.0, 0.0]


def test_span_features_defaults(spark):
    schema = "doc_id long, spans array<struct<severity:string,confidence:double>>"
    df = spark.createDataFrame([(1, []), (2, [("major", 0.9), ("weird", None), (None, 0.1)])], schema)
    r = {x.doc_id: x for x in features.span_features(df).collect()}
    assert (r[1].error_count, r[1].error_severity, r[1].error_confidence) == (0.0, 0.0, 0.0)
    assert r[2].error_count == 3.0
    assert r[2].error_severity == pytest.approx(2.0 + 1.0 + 1.0)
    assert r[2].error_confidence == pytest.approx((0.9 + 0.5 + 0.1) / 3)


def test_cosine_and_pool(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [2.0, 2.0], 1)],
                               "vec_id long, embedding array<float>, label int")
    p = {r.label: r.pooled for r in features.mean_pool(df, "label").collect()}
    assert p[0] == pytest.approx([0.5, 0.5])
    c = {r.vec_id: r.cosine for r in features.cosine_to_pool(df, "label").collect()}
    assert c[1] == pytest.approx(1 / math.sqrt(2)) and c[3] == pytest.approx(1.0)
    v = df.select(V.norm("embedding").alias("n"), V.std_pop("embedding").alias("s")).collect()
    assert v[2].n == pytest.approx(math.sqrt(8)) and v[0].s == pytest.approx(0.5)


# --- folds and blending ---------------------------------------------------------------------

def test_fold_hash_matches_python(spark):
    df = spark.createDataFrame([(7,), (123,), (99999,)], "doc_id long")
    got = {r.doc_id: r.fold for r in blend.doc_folds(df).collect()}
    for d, f in got.items():
        h = hashlib.md5(f"42|{d}".encode()).hexdigest()
        assert f == int(h[:8], 16) % 5
    assert got[7] == 0


def test_balanced_folds_snake(spark):
    df = spark.createDataFrame([(d,) for d in range(10) for _ in range(d + 1)], "doc_id long")
    f = {r.doc_id: r.fold for r in blend.balanced_folds(df, k=3).collect()}
    # sizes descending: doc 9 (10 rows) -> 0, 8 -> 1, 7 -> 2, 6 -> 2, 5 -> 1, 4 -> 0, 3 -> 0 ...
    assert [f[d] for d in (9, 8, 7, 6, 5, 4, 3)] == [0, 1, 2, 2, 1, 0, 0]


def test_weighted_blend_zero_sum_and_single(spark):
    df = spark.createDataFrame([(1.0, 3.0)], "a double, b double")
    assert df.select(blend.weighted_blend(["a", "b"], [0.0, 0.0]).alias("x")).first().x is None
    assert df.select(blend.weighted_blend(["a", "b"], [1.0, 3.0]).alias("x")).first().x == pytest.approx(2.5)


def test_lp_complement_keeps_nulls(spark):
    df = spark.createDataFrame([("en", "de"), ("en", "fr"), (None, "de"), ("en", None)],
                               "src_lang string, tgt_lang string")
    assert select.lp_filter(df).count() == 1
    assert select.lp_complement(df).count() == 3


# --- pairs ------------------------------------------------------------------------------------

def _brute_pairs(rows, gap=1.0):
    out = set()
    for (ra, da, ga), (rb, db, gb) in itertools.permutations(rows, 2):
        if da == db and ga - gb > gap:
            out.add((ra, rb))
    return out


@pytest.mark.parametrize("small", [64, 10])
def test_preference_pairs_all_and_sampled(spark, small, monkeypatch):
    monkeypatch.setattr(pairs.pairstats, "SMALL_GROUP", small)
    rng = np.random.default_rng(3)
    rows = [(f"r{i}", int(rng.integers(0, 6)), float(rng.integers(0, 8))) for i in range(60)]
    rows += [(f"h{i}", 99, float(i % 13)) for i in range(40)]          # a larger source
    df = spark.createDataFrame(rows, "row_id string, doc_id long, score double")
    truth = _brute_pairs(rows)
    cnt = pairs.preference_counts(df).agg(F.sum("n_pairs")).first()[0]
    assert cnt == len(truth)
    allp = pairs.sample_preference_pairs(df, payload=(), k=10_000).collect()
    assert {(r.row_better, r.row_worse) for r in allp} == truth
    assert sorted(r.pair_index for r in allp) == list(range(len(truth)))
    samp = pairs.sample_preference_pairs(df, payload=(), k=50).collect()
    got = {(r.row_better, r.row_worse) for r in samp}
    assert len(samp) == 50 and len(got) == 50 and got <= truth
    for r in samp:
        assert r.margin == pytest.approx(r.score_better - r.score_worse) and r.margin > 0.01


def _losses(rows, gap, margin, adaptive, scale):
    n = hinge = squares = right = 0.0
    for d, g, p in rows:
        for e, h, q in rows:
            if d == e and g - h > gap:
                m = max(0.5 * ((g - h) / scale), margin) if adaptive else margin
                n, hinge = n + 1, hinge + max(0.0, m - (p - q))
                squares += ((p - g / scale) ** 2 + (q - h / scale) ** 2) / 2
                right += p > q
    return n, hinge, squares, right


@pytest.mark.parametrize("small", [64, 2])
def test_pair_losses_over_all_pairs(spark, small):
    """Both variants in both tiers, two-decimal gold on and about the gaps."""
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 6)), float(rng.integers(3000, 3600)) / 100, float(rng.normal(0.33, 0.02))) for _ in range(150)]
    rows += [(9, 10.0, 0.1), (9, 11.0, 0.1), (9, 12.0, 0.3), (9, 12.01, 0.2), (9, 13.02, 0.15)]
    df = spark.createDataFrame(rows + [(9, None, 0.5), (9, 50.0, None), (9, float("nan"), 0.1)], "doc_id long, score double, p double")
    n, hinge, squares, right = _losses(rows, 1.0, 0.01, True, 100.0)
    r = pairs.pair_loss(df, "p", small=small).first()
    assert (r.n_pairs, r.ranking_loss, r.mse_loss, r.rank_accuracy) == (n, *map(pytest.approx, (hinge / n, squares / n, right / n)))
    unit = [(d, g / 100, p) for d, g, p in rows]
    n, hinge, _, _ = _losses(unit, 1e-6, 0.01, False, 1.0)
    r = pairs.fixed_margin_loss(df.dropna().filter("score = score"), "p", small=small).first()
    assert (r.n_pairs, r.ranking_loss) == (n, pytest.approx(hinge / n))
    assert r.mse_loss == pytest.approx(np.mean([(p - g) ** 2 for _, g, p in unit]))


@pytest.mark.parametrize("small", [64, 2])
@pytest.mark.parametrize("places, tol", [(10, 25.0), (10, 1.0), (100, 1.0)])
def test_band_is_one_rule_in_every_tier(spark, small, places, tol):
    """Scores with one and two decimals lie on the band's edge; the tiers agree
    with plain subtraction."""
    rng = np.random.default_rng(places)
    rows = [(int(rng.integers(0, 3)), float(rng.integers(0, 60 * places)) / places, float(rng.integers(0, 9))) for _ in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, g double, p double")
    want = {}
    for d in range(3):
        own = [(g, p) for e, g, p in rows if e == d]
        pairs_ = [(a, b) for i, a in enumerate(own) for b in own[i + 1:]]
        tie = sum(abs(a[0] - b[0]) < tol for a, b in pairs_)
        agree = sum(abs(a[0] - b[0]) >= tol and (a[0] - b[0]) * (a[1] - b[1]) > 0 for a, b in pairs_)
        want[d] = (agree, len(pairs_) - tie - agree, tie)
    got = pairstats.band_agreement(df, ["doc_id"], "g", "p", tol, small=small).collect()
    assert {r.doc_id: (r.agree, r.disagree, r.tie) for r in got} == want


@pytest.mark.parametrize("small", [64, 2])
def test_preference_gap_is_one_rule(spark, monkeypatch, small):
    monkeypatch.setattr(pairstats, "SMALL_GROUP", small)
    rng = np.random.default_rng(9)
    rows = [(f"r{i}", int(rng.integers(0, 3)), float(rng.integers(0, 800)) / 100) for i in range(150)]
    df = spark.createDataFrame(rows, "row_id string, doc_id long, score double")
    k = {a: sum(e == d and g - h > 1.0 for _, e, h in rows) for a, d, g in rows}
    assert {r.row_id: r._k for r in pairs.partner_counts(df).collect()} == k
    counts = {r.doc_id: r.n_pairs for r in pairs.preference_counts(df).collect()}
    assert counts == {d: sum(k[a] for a, e, _ in rows if e == d) for d in range(3)}


def test_difference_cut():
    rng = np.random.default_rng(3)
    g = np.concatenate([rng.integers(0, 10_000, 500) / 100, [0.0, 1.0, 25.0, -3.7, 1e-9, 1e12]])
    for width in (1.0, 25.0, 0.1):
        for strict in (False, True):
            cut = pairstats.difference_cut(g, width, strict)
            far = (lambda d: d > width) if strict else (lambda d: d >= width)
            assert far(g - cut).all() and not far(g - np.nextafter(cut, np.inf)).any()


def test_nan_is_missing(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 10.0), ("b", 1, float("nan"), 20.0), ("c", 1, 3.0, float("nan")), ("d", 2, 5.0, 40.0)],
                               "row_id string, doc_id long, s double, score double")
    ctx = {r.row_id: r for r in features.doc_context(df, ["s"]).collect()}
    assert (ctx["b"].s_doc_mean, ctx["b"].s_doc_dev, ctx["a"].s_doc_max) == (2.0, None, 3.0)
    assert profile.score_profile(df, "s").first().n == 3
    assert [r.n for r in profile.stats_by(df, ["doc_id"], "s").orderBy("doc_id").collect()] == [2, 1]
    assert analyse.gold_quintiles(df, ["s"]).agg({"n": "sum"}).first()[0] == 3
    z = df.withColumn("u", df.score / 7)
    assert {r.row_id for r in analyse.signal_disagreement(z, ["s", "u"], k=2).collect()} == {"a", "d"}


def test_unicode_space(spark):
    df = spark.createDataFrame([("a\u3000b\u00a0c ",), ("\u3000x\u00a0",)], "t string")
    assert [r[0] for r in df.select(text.word_count("t")).collect()] == [3, 1]
    assert [r[0] for r in df.select(text.strip_ws("t")).collect()] == ["a\u3000b\u00a0c", "x"]


def test_spans_of_rows(spark):
    """Span features belong to a row where the spans have row ids."""
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.6)], "row_id string, doc_id long, s double")
    spans = spark.createDataFrame([("a", [("major", 0.5)]), ("b", [])], "row_id string, spans array<struct<severity:string,confidence:double>>")
    table, _ = features.build_features(df, ["s"], spans=spans)
    assert {r.row_id: (r.error_count, r.error_severity) for r in table.collect()} == {"a": (1.0, 2.0), "b": (0.0, 0.0)}


def test_kendall_p_of_long_perfect_orders():
    frame = pd.DataFrame({"n": [200, 200, 4, 40, 5], "s": [19900.0, 19898.0, 6.0, 200.0, None],
                          **{c: [0.0] * 5 for c in ("tx", "ty", "x0", "x1", "y0", "y1")}})
    p = analyse._kendall_p_rows(frame)
    assert p[0] == 0.0 and p[1] < 1e-300 and p[2] == pytest.approx(2 / 24) and 0 < p[3] < 1 and np.isnan(p[4])
    for n in (2, 3, 5, 6):                      # against all permutations
        orders = [sum(a > b for i, a in enumerate(o) for b in o[i + 1:]) for o in itertools.permutations(range(n))]
        tails = analyse.inversion_tails(n)
        for d in range(len(tails)):
            low = min(d, len(tails) - 1 - d)
            assert tails[d] == pytest.approx(min(1.0, 2 * np.mean([x <= low for x in orders])))


def test_order_statistics_of_one_value(spark):
    """A constant column is one row before the sort."""
    df = spark.range(5000).selectExpr("id % 2 AS k", "3.0D AS v")
    assert value_places(df, "v", ["k"]).count() == 2
    assert [r.q0 for r in exact_quantiles(df, "v", [0.5], by=["k"]).collect()] == [3.0, 3.0]


def test_disagreements_of_a_hot_source(spark, monkeypatch):
    monkeypatch.setattr(pairs, "EXAMPLE_ROWS", 7)
    rows = [(1, f"r{i:04d}", "s", float(i), float(i)) for i in range(300)] + [(1, "z1", "s", 500.0, -1.0), (1, "z2", "s", 600.0, -2.0)]
    df = spark.createDataFrame(rows, "doc_id long, row_id string, tgt_system string, score double, p double")
    got = [(r.row_i, r.row_j) for r in pairs.disagreement_examples(df, "p", k=3).collect()]
    assert got == [("r0000", "z1"), ("r0000", "z2"), ("r0001", "z1")]
    assert pairs.disagreement_examples(df.filter("row_id < 'z'"), "p", k=3).count() == 0


# --- learning -----------------------------------------------------------------------------------

def test_learners_lose_no_row(spark):
    """Two sources in one language pair, a pair with one source, null and NaN
    gold and signals: as many rows out as in."""
    rng = np.random.default_rng(4)
    rows = [(f"r{i}", i % 2, "en", "de", None if i % 7 == 0 else float(i), float("nan") if i == 5 else float(rng.normal()), float(i % 5))
            for i in range(24)] + [(f"q{i}", 9, "en", "zh", float(i), 0.1 * i, 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "row_id string, doc_id long, src_lang string, tgt_lang string, score double, a double, b double")
    assert sorted(r.row_id for r in learn.isotonic_oof(df, "a").collect()) == sorted(r[0] for r in rows)
    assert sorted(r.row_id for r in learn.ridge_oof(df, ["a", "b"])[0].collect()) == sorted(r[0] for r in rows)
    assert sorted(r.row_id for r in learn.gbt_oof(df.fillna(0.0, ["a"]), ["a", "b"], k=2)[0].collect()) == sorted(r[0] for r in rows)


def test_ridge_ignores_rows_without_gold(spark):
    rows = [(f"r{i}", i % 40, 10.0 * (i % 17) + 50 if i % 2 else None, float(i % 17)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id string, doc_id long, score double, x double")
    scores, coef = learn.ridge_oof(df, ["x"], alpha=1e-9)
    assert scores.count() == 400
    for c in coef.collect():
        assert (c.intercept, c.b0) == (pytest.approx(50), pytest.approx(10))


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(2)
    n = 300
    x = rng.normal(size=(n, 2))
    y = 3 + x @ np.array([1.5, -2.0]) + rng.normal(scale=0.1, size=n)
    docs = rng.integers(0, 40, n)
    df = spark.createDataFrame([(f"r{i}", int(docs[i]), float(y[i]), float(x[i, 0]), float(x[i, 1]))
                                for i in range(n)], "row_id string, doc_id long, score double, a double, b double")
    _, coef = learn.ridge_oof(df, ["a", "b"], alpha=1.0)
    folds = {r.doc_id: r.fold for r in blend.balanced_folds(df).collect()}
    for c in coef.collect():
        tr = np.array([folds[d] != c.fold for d in docs])
        xm, ym = x[tr].mean(0), y[tr].mean()
        xc, yc = x[tr] - xm, y[tr] - ym
        beta = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
        assert [c.b0, c.b1] == pytest.approx(list(beta), rel=1e-9)
        assert c.intercept == pytest.approx(ym - xm @ beta, rel=1e-9)


def test_spearman_pvalue():
    assert analyse.spearman_pvalue(0.5, 10) == pytest.approx(0.14111, abs=1e-4)
    assert analyse.spearman_pvalue(0.0, 30) == pytest.approx(1.0)


# --- plans ---------------------------------------------------------------------------------------

def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_is_pruned(spark, sf_dir):
    from vetta.sources import segments
    df = segments.read_segments(spark, [f"{sf_dir}/lineitem.parquet"], ["l_orderkey", "l_tax", "nope"])
    plan = _plan(df.filter(F.col("l_tax") > 0.05))
    assert "ReadSchema: struct<l_orderkey:bigint,l_tax:double>" in plan
    assert "PushedFilters: [IsNotNull(l_tax), GreaterThan(l_tax,0.05)]" in plan


def test_flagship_plan_has_no_cartesian(spark, sf_dir):
    from vetta.queries import REGISTRY
    plan = _plan(REGISTRY["evaluate_metric"](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_candidate_kernel_matches_generic(spark, monkeypatch):
    from vetta.operators import pairstats
    rng = np.random.default_rng(9)
    rows = []
    for d in range(40):
        n = int(rng.integers(1, 12)) if d % 7 else 20        # some sources above the limit
        for i in range(n):
            g = float(rng.integers(0, 6)) if d != 3 else None if i == 0 else 1.0
            rows.append((f"{d}-{i}", d, g, float(rng.integers(0, 4)), float(rng.integers(0, 3)), int(d % 3)))
    df = spark.createDataFrame(rows, "row_id string, doc_id long, score double, a double, b double, fold long")
    monkeypatch.setattr(pairstats, "SMALL_GROUP", 10)
    cands = [(1.0, 0.0), (0.5, 0.5), (0.25, 1.0)]
    got = {(r.fold, r.cand): (r.sum_tau, r.n_def)
           for r in blend.candidate_tau_sums(df, ["a", "b"], cands, fold_col="fold").collect()}
    t = blend.candidate_doc_taus(df, ["a", "b"], cands, extra=["fold"]).collect()
    exp = {}
    for r in t:
        if r.tau is None:
            continue
        key = (r.fold, int(r.signal[-4:]))
        s, c = exp.get(key, (0.0, 0))
        exp[key] = (s + r.tau, c + 1)
    assert set(exp) <= set(got)
    for key, (s, c) in exp.items():
        assert got[key][1] == c and got[key][0] == pytest.approx(s)


def test_differential_evolution_finds_informative_signal(spark):
    rng = np.random.default_rng(4)
    rows = []
    for d in range(60):
        for i in range(5):
            g = float(rng.integers(0, 100))
            rows.append((d, g, g + rng.normal(scale=5), float(rng.normal())))
    df = spark.createDataFrame(rows, "doc_id long, score double, good double, noise double")
    w, tau = blend.differential_evolution_weights(df, ["good", "noise"], generations=3, popsize=4)
    assert w[0] > w[1] and tau > 0.5


def test_kendall_pvalues(spark):
    # exact: perfect order of 3 -> 2/3! ; of 4 -> 2/4! ; one swap in 4 -> 2 * 4/24
    assert analyse.inversion_tails(3)[0] == pytest.approx(1 / 3)
    assert analyse.inversion_tails(4)[0] == pytest.approx(1 / 12)
    assert analyse.inversion_tails(4)[1] == pytest.approx(2 / 6)
    assert analyse.inversion_tails(5)[2] == pytest.approx(2 * (1 + 4 + 9) / 120)
    rows = [("a", 1, "S", "en", "de", 1.0, 1.0), ("b", 1, "S", "en", "de", 2.0, 2.0),
            ("c", 1, "S", "en", "de", 3.0, 3.0),
            ("d", 2, "S", "en", "de", 1.0, 1.0), ("e", 2, "S", "en", "de", 1.0, 2.0),
            ("f", 2, "S", "en", "de", 2.0, 3.0)]
    got = {r.doc_id: r for r in analyse.per_source_pvalues(seg_df(spark, rows), ["sig"]).collect()}
    assert got[1].pvalue == pytest.approx(1 / 3)
    # ties -> normal approximation: s=2, n=3, gold ties t=2 -> var = (6*11 - 2*1*9)/18 = 48/18
    assert got[2].pvalue == pytest.approx(math.erfc(2 / math.sqrt(48 / 18) / math.sqrt(2)))


def test_top_features_order(spark):
    imp = spark.createDataFrame([("a", 0.1), ("b", 0.5), ("c", 0.5), ("d", 0.0)], "feature string, importance double")
    assert [r.feature for r in learn.top_features(imp, 3).collect()] == ["b", "c", "a"]


def test_cv_predictions_use_fold_weights(spark):
    df = spark.createDataFrame([(d, float(d), 10.0 * d) for d in range(20)], "doc_id long, a double, b double")
    folds = spark.createDataFrame([(f, 1.0, float(f)) for f in range(5)], "fold long, w_a double, w_b double")
    out = blend.cv_predictions(df, folds, ["a", "b"]).collect()
    for r in out:
        assert r.cv_ensemble_score == pytest.approx((r.a * 1.0 + r.b * r.fold) / (1.0 + r.fold))


def test_isotonic_is_monotone_within_lp_and_fold(spark):
    rng = np.random.default_rng(8)
    rows = []
    for d in range(60):
        for i in range(4):
            x = float(rng.normal())
            rows.append((f"{d}-{i}", d, "en", "de" if d % 2 else "zh", x, 50 + 10 * x + float(rng.normal())))
    rows.append(("solo", 999, "en", "ja", 0.3, 40.0))        # an LP with one source keeps raw values
    df = spark.createDataFrame(rows, "row_id string, doc_id long, src_lang string, tgt_lang string, "
                                     "sig double, score double")
    cal = df.join(learn.isotonic_oof(df, "sig"), "row_id").collect()
    assert len(cal) == len(rows)
    by = {}
    for r in cal:
        by.setdefault((r.tgt_lang, r.fold), []).append((r.sig, r.calibrated))
    for (lp, fold), pts in by.items():
        pts.sort()
        vals = [c for _, c in pts]
        assert all(b >= a - 1e-9 for a, b in zip(vals, vals[1:])), (lp, fold)
    solo = [r for r in cal if r.row_id == "solo"][0]
    assert solo.calibrated == pytest.approx(0.3) and solo.fold == -1


def test_pairwise_ranker_recovers_order(spark):
    rng = np.random.default_rng(6)
    rows = []
    for d in range(40):
        for i in range(5):
            g = float(rng.integers(0, 100))
            rows.append((f"{d}-{i}", d, g, g / 100, float(rng.normal())))
    df = spark.createDataFrame(rows, "row_id string, doc_id long, score double, good double, noise double")
    sample = pairs.sample_preference_pairs(df, payload=("good", "noise"))
    scored, w = learn.pairwise_ranker(sample, df, ["good", "noise"])
    wts = {r.feature: r.weight for r in w.collect()}
    assert wts["good"] > 0 and abs(wts["good"]) > abs(wts["noise"])
    got = pairs.pairstats.concordance(scored, [], "score", ["ranker_score"]).first().tau
    assert got > 0.9


def test_epoch_order(spark):
    df = spark.range(300).withColumnRenamed("id", "pair_index")
    o1 = [r.pair_index for r in pairs.epoch_order(df, 1).orderBy("position").collect()]
    o1b = [r.pair_index for r in pairs.epoch_order(df, 1).orderBy("position").collect()]
    o2 = [r.pair_index for r in pairs.epoch_order(df, 2).orderBy("position").collect()]
    assert o1 == o1b and o1 != o2 and sorted(o1) == list(range(300))


def test_signal_disagreement_sorts_no_table(spark):
    rows = [(f"r{i:03d}", float(i % 7), float(i * 37 % 101), None if i % 50 == 0 else float(i * 53 % 97), float(i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id string, score double, a double, b double, c double").repartition(4)
    out = analyse.signal_disagreement(df, ["a", "b", "c"], 4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Window" not in plan and " Sort " not in plan
    z = {}
    for j, s in enumerate("abc", 2):
        v = np.array([r[j] for r in rows if r[j] is not None])
        z[s] = {r[0]: (r[j] - v.mean()) / v.std(ddof=1) for r in rows if r[j] is not None}
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        want = sorted((-round(abs(z[x][r] - z[y][r]), 9), r) for r in z[x] if r in z[y])[:4]
        got = sorted((-round(r["diff"], 9), r["row_id"]) for r in out.collect() if (r["signal_a"], r["signal_b"]) == (x, y))
        assert got == want


@pytest.mark.parametrize("report", [analyse.lp_tau_breakdown, analyse.spearman_props])
def test_reports_evaluate_the_detail_once(spark, report):
    rows = [("s", i, (i * 7 % 13) / 13, i % 5, float(i % 11), float(i % 3), float(i), 0.0, "en", "de") for i in range(50)]
    df = spark.createDataFrame(rows, "signal string, doc_id long, tau double, n_systems int, gold_range double, pred_range double, "
                                     "gold_mean double, pred_mean double, src_lang string, tgt_lang string")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    assert report(df.mapInPandas(counted, df.schema)).collect()
    assert seen.value == len(rows)


def test_gold_ties_are_counted_once_for_all_signals(spark):
    rows = [(f"r{i}", i % 6, float(i * 7 % 5), float(i * 3 % 4), float(i * 5 % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id string, doc_id long, score double, a double, b double")
    out = analyse.per_source_pvalues(df, ["a", "b"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate stack") == 2     # taus and ties of signals
    alone = {r["doc_id"]: r["pvalue"] for r in analyse.per_source_pvalues(df, ["b"]).collect()}
    got = {r["doc_id"]: r["pvalue"] for r in out.collect() if r["signal"] == "b"}
    assert got == alone and len(got) == 6
