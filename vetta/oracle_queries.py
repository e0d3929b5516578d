"""DuckDB SQL for each registered key (the correctness oracle)."""

from __future__ import annotations

from vetta.oracle import (AUDIO_META, DOC_QUALITY, RATINGS, SEGMENTS, SIGNALS, SPAN_ROWS,
                          USER_MATRIX, long_signals, tau_per_group, with_views)
from vetta.operators.pairs import permutation_rounds

SIG_VALUES = "(VALUES " + ", ".join(f"('{s}')" for s in SIGNALS) + ") AS sl(signal)"
LP = "src_lang || '->' || tgt_lang"


def _pearson(x="pred", y="gold"):
    return (f"CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 0 THEN covar_pop({x}, {y}) / "
            f"(stddev_pop({x}) * stddev_pop({y})) END")


def _overall_tau(lg: str, by: str = "") -> str:
    """Exact tau-b from distinct weighted points (ties collapse first)."""
    b = f"{by}, " if by else ""
    on = "".join(f" AND a.{k.strip()} = b.{k.strip()}" for k in by.split(",") if k.strip())
    using = ", ".join([k.strip() for k in by.split(",") if k.strip()] + ["signal"])
    return f"""pts AS (SELECT {b}signal, pred, gold, count(*) AS w FROM ({lg}) z
             WHERE pred IS NOT NULL AND gold IS NOT NULL GROUP BY ALL),
ss AS (SELECT {''.join(f'a.{k.strip()}, ' for k in by.split(',') if k.strip())}a.signal,
              sum(a.w * b.w * sign(a.pred - b.pred) * sign(a.gold - b.gold)) / 2 AS s
       FROM pts a JOIN pts b ON a.signal = b.signal{on} GROUP BY ALL),
nn AS (SELECT {b}signal, CAST(sum(w) AS BIGINT) AS n FROM pts GROUP BY ALL),
tx AS (SELECT {b}signal, sum(c * (c - 1) / 2) AS tx FROM
        (SELECT {b}signal, pred, sum(w) AS c FROM pts GROUP BY ALL) GROUP BY ALL),
ty AS (SELECT {b}signal, sum(c * (c - 1) / 2) AS ty FROM
        (SELECT {b}signal, gold, sum(w) AS c FROM pts GROUP BY ALL) GROUP BY ALL),
ov AS (SELECT {b}signal, n,
         CASE WHEN (n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty) > 0
              THEN s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)) END AS tau
       FROM nn JOIN ss USING ({using}) JOIN tx USING ({using}) JOIN ty USING ({using}))"""


def _spa(lg: str, thr: float, by: str = "") -> str:
    b = f"{by}, " if by else ""
    on = "".join(f" AND a.{k.strip()} = b.{k.strip()}" for k in by.split(",") if k.strip())
    sel = "".join(f"a.{k.strip()} AS {k.strip()}, " for k in by.split(",") if k.strip())
    return f"""SELECT {sel}a.signal,
       avg(CASE WHEN abs(a.g - b.g) < {thr} THEN 1.0
                WHEN (a.g - b.g > 0 AND a.p - b.p > 0) OR (a.g - b.g < 0 AND a.p - b.p < 0) THEN 1.0
                ELSE 0.0 END) AS spa
FROM (SELECT {b}signal, tgt_system, avg(gold) AS g, avg(pred) AS p FROM ({lg}) z
      WHERE tgt_system IS NOT NULL GROUP BY ALL) a
JOIN (SELECT {b}signal, tgt_system, avg(gold) AS g, avg(pred) AS p FROM ({lg}) z
      WHERE tgt_system IS NOT NULL GROUP BY ALL) b
  ON a.signal = b.signal{on} AND a.tgt_system < b.tgt_system
GROUP BY ALL"""


LG_DOC = long_signals("ratings", "row_id, doc_id")
LG_LP = long_signals("ratings", f"row_id, doc_id, tgt_system, {LP} AS lp")

SQL: dict[str, str] = {}

SQL["kendall_per_source"] = with_views(RATINGS) + f"""
, t AS ({tau_per_group(LG_DOC, 'doc_id')})
SELECT sl.signal, round(coalesce(avg(t.tau), 0.0), 6) AS per_source_tau,
       count(t.tau) AS n_docs
FROM {SIG_VALUES} LEFT JOIN t ON t.signal = sl.signal GROUP BY sl.signal"""

SQL["kendall_per_lp"] = with_views(RATINGS) + f"""
, t AS ({tau_per_group(LG_LP, 'lp, doc_id')}),
lps AS (SELECT DISTINCT {LP} AS lp FROM ratings WHERE {LP} IS NOT NULL)
SELECT lps.lp, sl.signal, round(coalesce(avg(t.tau), 0.0), 6) AS per_source_tau,
       count(t.tau) AS n_docs
FROM lps CROSS JOIN {SIG_VALUES}
LEFT JOIN t ON t.signal = sl.signal AND t.lp = lps.lp GROUP BY lps.lp, sl.signal"""

SQL["kendall_overall"] = with_views(RATINGS) + f""", {_overall_tau(LG_DOC)}
SELECT signal, n, round(tau, 6) AS tau FROM ov"""

SQL["pearson_report"] = with_views(RATINGS) + f""", lg AS ({LG_LP})
SELECT 'all' AS lp, signal, count(*) AS n, round({_pearson()}, 6) AS pearson
FROM lg WHERE pred IS NOT NULL AND gold IS NOT NULL GROUP BY signal
UNION ALL
SELECT lp, signal, count(*) AS n, round({_pearson()}, 6) AS pearson
FROM lg WHERE pred IS NOT NULL AND gold IS NOT NULL AND lp IS NOT NULL GROUP BY lp, signal"""

SQL["soft_pairwise_accuracy"] = with_views(RATINGS) + f""", lg AS ({LG_LP})
SELECT 25.0::DOUBLE AS threshold, signal, round(spa, 6) AS spa FROM ({_spa('SELECT * FROM lg', 25.0)})
UNION ALL
SELECT 10.0::DOUBLE AS threshold, signal, round(spa, 6) AS spa FROM ({_spa('SELECT * FROM lg', 10.0)})"""

SQL["evaluate_metric"] = with_views(RATINGS) + f""", lg AS ({LG_LP}), {_overall_tau('SELECT * FROM lg')},
td AS ({tau_per_group(LG_DOC, 'doc_id')}),
tl AS ({tau_per_group(LG_LP, 'lp, doc_id')}),
lps AS (SELECT DISTINCT lp FROM lg WHERE lp IS NOT NULL)
SELECT 'overall' AS scope, 'all' AS lp, signal, 'kendall_tau' AS metric, round(tau, 6) AS value FROM ov
UNION ALL
SELECT 'overall', 'all', sl.signal, 'per_source_kendall_tau', round(coalesce(avg(td.tau), 0.0), 6)
FROM {SIG_VALUES} LEFT JOIN td ON td.signal = sl.signal GROUP BY sl.signal
UNION ALL
SELECT 'overall', 'all', signal, 'pearson', round({_pearson()}, 6)
FROM lg WHERE pred IS NOT NULL AND gold IS NOT NULL GROUP BY signal
UNION ALL
SELECT 'overall', 'all', signal, 'spa', round(spa, 6) FROM ({_spa('SELECT * FROM lg', 25.0)})
UNION ALL
SELECT 'lp', lps.lp, sl.signal, 'kendall_tau', round(coalesce(avg(tl.tau), 0.0), 6)
FROM lps CROSS JOIN {SIG_VALUES} LEFT JOIN tl ON tl.signal = sl.signal AND tl.lp = lps.lp
GROUP BY lps.lp, sl.signal
UNION ALL
SELECT 'lp', lp, signal, 'pearson', round({_pearson()}, 6)
FROM lg WHERE pred IS NOT NULL AND gold IS NOT NULL AND lp IS NOT NULL GROUP BY lp, signal
UNION ALL
SELECT 'lp', lp, signal, 'spa', round(spa, 6) FROM ({_spa('SELECT * FROM lg WHERE lp IS NOT NULL', 25.0, 'lp')})"""

# --- profiles -------------------------------------------------------------------

LP_SP = "src_lang || ' -> ' || tgt_lang"


def _stats(src, keys, extra=""):
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}{extra}count(*) AS n, round(avg(score), 6) AS mean,
       round(quantile_cont(score, 0.5), 6) AS median, round(stddev_pop(score), 6) AS std,
       round(min(score), 6) AS min, round(max(score), 6) AS max
FROM {src} WHERE score IS NOT NULL GROUP BY {keys}"""


SQL["score_profile"] = with_views(RATINGS) + """
SELECT count(*) AS n, round(min(score), 6) AS min, round(max(score), 6) AS max,
       round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median,
       round(stddev_pop(score), 6) AS std, round(quantile_cont(score, 0.25), 6) AS p25,
       round(quantile_cont(score, 0.75), 6) AS p75
FROM ratings WHERE score IS NOT NULL"""


def _hist(col):
    return f"""SELECT '{col}' AS "column", b.bin, b.lo, b.hi, coalesce(h.c, 0) AS count,
       repeat('#', CAST(CASE WHEN max(coalesce(h.c, 0)) OVER () > 0
                             THEN coalesce(h.c, 0) * 40 // max(coalesce(h.c, 0)) OVER () ELSE 0 END AS INT)) AS bar
FROM (SELECT i AS bin,
             CASE WHEN t.top > 1 THEN i * 10.0 ELSE i / 10 END AS lo,
             CASE WHEN t.top > 1 THEN i * 10.0 + 10 ELSE (i + 1) / 10 END AS hi
      FROM range(10) r(i),
           (SELECT CASE WHEN max({col}) > 1.5 THEN 100.0 ELSE 1.0 END AS top FROM ratings) t) b
LEFT JOIN (SELECT CASE WHEN top > 1
                       THEN len(list_filter([{', '.join(f'{i * 10}.0::DOUBLE' for i in range(1, 10))}], lambda e: e <= v))
                       ELSE len(list_filter([{', '.join(f'({i}/10)::DOUBLE' for i in range(1, 10))}], lambda e: e <= v)) END AS bin,
                  count(*) AS c
           FROM (SELECT {col} AS v, (SELECT CASE WHEN max({col}) > 1.5 THEN 100.0 ELSE 1.0 END
                                     FROM ratings) AS top FROM ratings WHERE {col} IS NOT NULL)
           WHERE v >= 0 AND v <= top GROUP BY 1) h ON h.bin = b.bin"""


SQL["score_histogram"] = with_views(RATINGS) + _hist("score") + "\nUNION ALL\n" + _hist("sig_c_score")

SQL["value_counts"] = with_views(RATINGS) + f"""
, c AS (
  SELECT 'lp' AS dimension, {LP_SP} AS value, count(*) AS count FROM ratings GROUP BY 2
  UNION ALL SELECT 'domain', domain, count(*) FROM ratings GROUP BY 2
  UNION ALL SELECT 'tgt_system', tgt_system, count(*) FROM ratings GROUP BY 2
  UNION ALL SELECT 'src_text_system', src_text_system, count(*) FROM ratings GROUP BY 2)
SELECT dimension, value, count,
       row_number() OVER (PARTITION BY dimension ORDER BY count DESC, value ASC NULLS LAST) AS rank
FROM c"""

SQL["stats_by_lp"] = with_views(RATINGS) + _stats(f"(SELECT {LP_SP} AS lp, score FROM ratings)", "lp")
SQL["stats_by_system"] = with_views(RATINGS) + _stats("ratings", "tgt_system")
SQL["stats_grouping_sets"] = with_views(RATINGS) + f""", r AS (SELECT {LP_SP} AS lp, tgt_system, score FROM ratings)
{_stats('r', 'lp', "'lp' AS grouping, NULL::VARCHAR AS tgt_system, ")}
UNION ALL BY NAME
{_stats('r', 'tgt_system', "'system' AS grouping, NULL::VARCHAR AS lp, ")}
UNION ALL BY NAME
{_stats('r', 'lp, tgt_system', "'lp_system' AS grouping, ")}"""

SQL["doc_structure"] = with_views(RATINGS) + """
SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_rows,
       round(count(*) / count(DISTINCT doc_id), 6) AS rows_per_doc FROM ratings"""


def _wc(c):
    return f"len(list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> ''))"


SQL["length_stats"] = with_views(SEGMENTS) + f"""
SELECT 'src_text' AS "column", round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median,
       CAST(min(v) AS BIGINT) AS min, CAST(max(v) AS BIGINT) AS max
FROM (SELECT {_wc('src_text')} AS v FROM segments) WHERE v IS NOT NULL
UNION ALL
SELECT 'tgt_text', round(avg(v), 6), round(quantile_cont(v, 0.5), 6), CAST(min(v) AS BIGINT), CAST(max(v) AS BIGINT)
FROM (SELECT {_wc('tgt_text')} AS v FROM segments) WHERE v IS NOT NULL"""

SQL["score_examples"] = with_views(DOC_QUALITY) + """
, p AS (SELECT doc_id AS row_id, score, text,
               row_number() OVER (ORDER BY score, doc_id) - 1 AS position,
               count(*) OVER () AS n
        FROM doc_quality WHERE score IS NOT NULL)
SELECT 'lowest' AS kind, position, row_id, score, substr(text, 1, 150) AS text_preview FROM p WHERE position < 5
UNION ALL
SELECT 'highest', position, row_id, score, substr(text, 1, 150) FROM p WHERE position >= n - 5
UNION ALL
SELECT 'median', position, row_id, score, substr(text, 1, 150) FROM p
WHERE position >= n // 2 - 2 AND position <= n // 2 + 2"""

SQL["head_docs"] = with_views(RATINGS) + """
SELECT row_id, doc_id FROM ratings ORDER BY row_id LIMIT 20"""

# --- sources, projections, filters, sinks ------------------------------------------

SEGMENTS_LEFT = """segments_left AS (
  SELECT CAST(u.conv_id AS VARCHAR) || '-' || CAST(u.turn AS VARCHAR) AS row_id,
         u.conv_id AS doc_id, u.text AS src_text, a.text AS tgt_text
  FROM conversations u LEFT JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""

UNION = """u AS (
  SELECT 'train' AS split, row_id, doc_id, src_lang, tgt_lang, score FROM ratings
  UNION ALL
  SELECT 'train_synthetic', 'syn-' || CAST(doc_id AS VARCHAR), doc_id, 'en', lang,
         CAST(quality AS DOUBLE) * 100.0
  FROM doc_quality WHERE quality IS NOT NULL)"""

LPRED = "(src_lang = 'en' AND tgt_lang IN ('de', 'zh'))"

SQL["scan_prune"] = "SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem"
SQL["rescale_union"] = with_views(RATINGS, DOC_QUALITY, UNION) + \
    "SELECT split, row_id, doc_id, src_lang, tgt_lang, round(score, 6) AS score FROM u"
SQL["lp_filter"] = with_views(RATINGS, DOC_QUALITY, UNION) + \
    f"SELECT split, row_id, tgt_lang FROM u WHERE {LPRED}"
SQL["lp_complement"] = with_views(RATINGS, DOC_QUALITY, UNION) + \
    f"SELECT split, row_id, tgt_lang FROM u WHERE NOT coalesce({LPRED}, false)"
SQL["subset_counts"] = with_views(RATINGS, DOC_QUALITY) + f"""
SELECT (SELECT count(*) FILTER (WHERE coalesce({LPRED}, false)) FROM ratings) AS target,
       (SELECT count(*) FILTER (WHERE NOT coalesce({LPRED}, false)) FROM ratings) AS other,
       (SELECT count(*) FROM doc_quality WHERE quality IS NOT NULL AND lang = 'de') AS synthetic"""

STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
SQL["clean_text"] = with_views(SEGMENTS_LEFT) + f"""
SELECT row_id, s, t FROM (
  SELECT row_id, {STRIP.format(c='src_text')} AS s, {STRIP.format(c='tgt_text')} AS t
  FROM segments_left WHERE src_text IS NOT NULL AND tgt_text IS NOT NULL)
WHERE s NOT IN ('', 'nan') AND t NOT IN ('', 'nan')""".replace(
    "SELECT row_id, s, t FROM", "SELECT row_id, s AS src_text, t AS tgt_text FROM")
SQL["null_to_empty"] = with_views(SEGMENTS_LEFT) + \
    "SELECT row_id, coalesce(tgt_text, '') AS tgt_text, tgt_text IS NULL AS was_null FROM segments_left"
SQL["prompt_format"] = with_views(SEGMENTS) + """
SELECT row_id, 'source: ' || coalesce(src_text, '') || ' candidate: ' || coalesce(tgt_text, '') AS prompt,
       coalesce(src_text, '') || ' </s> ' || coalesce(tgt_text, '') AS pair_text FROM segments"""

_LANG = ("CASE lang WHEN 'en' THEN 'eng_Latn' WHEN 'de' THEN 'deu_Latn' WHEN 'zh' THEN 'zho_Hans' "
         "WHEN 'ja' THEN 'jpn_Jpan' WHEN 'cs' THEN 'ces_Latn' WHEN 'uk' THEN 'ukr_Cyrl' "
         "WHEN 'ru' THEN 'rus_Cyrl' WHEN 'ar' THEN 'arb_Arab' WHEN 'is' THEN 'isl_Latn' END")
SQL["lang_code"] = with_views(DOC_QUALITY) + f"""
SELECT doc_id, lang, coalesce({_LANG}, 'eng_Latn') AS src_code, coalesce({_LANG}, 'deu_Latn') AS tgt_code
FROM doc_quality"""
SQL["clip_invert"] = with_views(RATINGS) + """
SELECT row_id, round(score / 3 - 5, 6) AS error,
       round(CASE WHEN score / 3 - 5 IS NOT NULL THEN 25.0 - least(greatest(score / 3 - 5, 0.0), 25.0) END, 6) AS quality
FROM ratings"""
SQL["side_features"] = """
SELECT d.doc_id AS row_id, d.n_chars, l.quality AS side_quality, l.toxic AS side_toxic
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
SQL["weights_default"] = with_views(RATINGS) + f"""
SELECT sl.signal, round(coalesce(w.weight, 1.0 / 3), 6) AS weight
FROM {SIG_VALUES} LEFT JOIN (
  SELECT 'sig_a_score' AS signal, {_pearson('sig_a_score', 'score')} AS weight FROM ratings
  UNION ALL SELECT 'sig_b_score', {_pearson('sig_b_score', 'score')} FROM ratings) w ON w.signal = sl.signal"""
SQL["train_csv_rows"] = with_views(DOC_QUALITY) + f"""
SELECT src, mt, round(score, 6) AS score FROM (
  SELECT {STRIP.format(c='CAST(text AS VARCHAR)')} AS src, {STRIP.format(c='CAST(source AS VARCHAR)')} AS mt,
         score / 100.0 AS score
  FROM doc_quality WHERE text IS NOT NULL AND source IS NOT NULL AND score IS NOT NULL)
WHERE src NOT IN ('', 'nan') AND mt NOT IN ('', 'nan')"""
FINAL = "(sig_a_score + sig_b_score + sig_c_score) / 3"
SQL["submission_lines"] = with_views(RATINGS) + f"""
SELECT row_id AS seq, printf('%.6f', {FINAL}) AS line FROM ratings"""
SQL["submission_stats"] = with_views(RATINGS) + f"""
SELECT 'team' AS team, 'ensemble-qe' AS system, 'sig_a_score,sig_b_score,sig_c_score' AS signals,
       'weighted' AS method, '2024-01-01 00:00:00' AS timestamp, count(*) AS n_test_samples,
       round(avg({FINAL}), 6) AS mean, round(stddev_pop({FINAL}), 6) AS std,
       round(min({FINAL}), 6) AS min, round(max({FINAL}), 6) AS max FROM ratings"""

# --- error analysis ---------------------------------------------------------------------

LG_DETAIL = long_signals("ratings", "row_id, doc_id, src_lang, tgt_lang, tgt_system")
DETAIL = f"""lgd AS ({LG_DETAIL}),
td AS ({tau_per_group('SELECT * FROM lgd', 'doc_id')}),
st AS (SELECT doc_id, signal, count(*) AS n, max(gold) - min(gold) AS gold_range,
              max(pred) - min(pred) AS pred_range, avg(gold) AS gold_mean, avg(pred) AS pred_mean,
              arg_min(src_lang, row_id) AS src_lang, arg_min(tgt_lang, row_id) AS tgt_lang
       FROM lgd GROUP BY ALL),
detail AS (SELECT td.signal, td.doc_id, td.tau, st.n AS n_systems, st.gold_range, st.pred_range,
                  st.gold_mean, st.pred_mean, st.src_lang, st.tgt_lang
           FROM td JOIN st ON st.doc_id = td.doc_id AND st.signal = td.signal WHERE td.tau IS NOT NULL)"""
R = "round({0}, 6) AS {0}".format

SQL["per_source_detail"] = with_views(RATINGS) + f""", {DETAIL}
SELECT signal, doc_id, {R('tau')}, n_systems, {R('gold_range')}, {R('pred_range')},
       {R('gold_mean')}, {R('pred_mean')}, src_lang, tgt_lang FROM detail"""

SQL["tau_distribution"] = with_views(RATINGS) + f""", {DETAIL}
SELECT signal, count(*) AS n_sources, round(avg(tau), 6) AS mean, round(stddev_samp(tau), 6) AS std,
       round(min(tau), 6) AS min, round(max(tau), 6) AS max,
       round(quantile_cont(tau, 0.1), 6) AS p10, round(quantile_cont(tau, 0.25), 6) AS p25,
       round(quantile_cont(tau, 0.5), 6) AS p50, round(quantile_cont(tau, 0.75), 6) AS p75,
       round(quantile_cont(tau, 0.9), 6) AS p90, round(quantile_cont(tau, 0.5), 6) AS median
FROM detail GROUP BY signal"""

SQL["worst_sources"] = with_views(RATINGS) + f""", {DETAIL}
SELECT signal, rank, doc_id, {R('tau')}, n_systems, {R('gold_range')}, {R('pred_range')}, src_lang, tgt_lang
FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY tau, doc_id) AS rank FROM detail)
WHERE rank <= 10"""

SQL["worst_drilldown"] = with_views(RATINGS) + f""", {DETAIL},
w AS (SELECT doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY tau, doc_id) AS rank
                                FROM detail) WHERE signal = 'sig_a_score' AND rank <= 3)
SELECT w.rank AS worst_rank, r.doc_id,
       row_number() OVER (PARTITION BY r.doc_id ORDER BY r.score DESC, r.row_id) AS pos,
       r.row_id, r.tgt_system, round(r.score, 6) AS score, round(r.sig_a_score, 6) AS sig_a_score
FROM ratings r JOIN w ON w.doc_id = r.doc_id"""


def _spearman_prop(prop, r=f"round({_pearson('rx', 'ry')}, 6)"):
    return f"""SELECT signal, count(*) AS n,
       {r} AS spearman_r, '{prop}' AS property
FROM (SELECT signal,
             rank() OVER (PARTITION BY signal ORDER BY x) + (count(*) OVER (PARTITION BY signal, x) - 1) / 2.0 AS rx,
             rank() OVER (PARTITION BY signal ORDER BY y) + (count(*) OVER (PARTITION BY signal, y) - 1) / 2.0 AS ry
      FROM (SELECT signal, round(CAST({prop} AS DOUBLE), 9) AS x, round(tau, 9) AS y FROM detail
            WHERE {prop} IS NOT NULL AND tau IS NOT NULL))
GROUP BY signal"""


SQL["spearman_props"] = with_views(RATINGS) + f""", {DETAIL}
""" + "\nUNION ALL\n".join(_spearman_prop(p) for p in ("n_systems", "gold_range", "pred_range", "gold_mean"))

# two-sided p of t with n - 2 degrees of freedom, as the finite sums of its
# distribution function (even and odd degrees), with r = sin(theta)
SQL["spearman_pvalues"] = with_views(RATINGS) + f""", {DETAIL},
sp AS ({" UNION ALL ".join(_spearman_prop(p, _pearson('rx', 'ry')) for p in ("n_systems", "gold_range", "pred_range", "gold_mean"))}),
t AS (SELECT *, n - 2 AS k, abs(spearman_r) AS s, 1 - spearman_r * spearman_r AS c FROM sp),
a AS (SELECT *, CASE WHEN s IS NULL OR k < 1 THEN NULL WHEN s >= 1 THEN 1.0
  WHEN k % 2 = 0 THEN s * list_sum(list_transform(range(0, k // 2), lambda i: exp(lgamma(i + 0.5) - lgamma(0.5) - lgamma(i + 1.0) + i * ln(c))))
  ELSE 2 / pi() * (asin(s) + s * sqrt(c) * coalesce(list_sum(list_transform(range(0, (k - 1) // 2),
         lambda i: exp(lgamma(i + 1.0) + lgamma(1.5) - lgamma(i + 1.5) + i * ln(c)))), 0.0)) END AS inside FROM t)
SELECT signal, n, round(spearman_r, 6) AS spearman_r, property, round(1 - inside, 6) AS pvalue FROM a"""

SQL["lp_tau_breakdown"] = with_views(RATINGS) + f""", {DETAIL}
SELECT signal, src_lang, tgt_lang, round(avg(tau), 6) AS mean_tau, count(*) AS n_sources,
       round(quantile_cont(gold_range, 0.5), 6) AS median_gold_range
FROM detail GROUP BY ALL"""

SQL["gold_quintiles"] = with_views(RATINGS) + f""",
e AS (SELECT list_sort(list_distinct([quantile_cont(score, 0.0), quantile_cont(score, 0.2),
        quantile_cont(score, 0.4), quantile_cont(score, 0.6), quantile_cont(score, 0.8),
        quantile_cont(score, 1.0)])) AS edges FROM ratings WHERE score IS NOT NULL),
b AS (SELECT len(list_filter(e.edges[2:], lambda x: x < r.score)) AS bin, r.*
      FROM ratings r, e WHERE r.score IS NOT NULL),
lg AS ({long_signals('b', 'bin')})
SELECT signal, bin, count(*) AS n, round(avg(gold), 6) AS gold_mean, round(min(gold), 6) AS gold_min,
       round(max(gold), 6) AS gold_max, round(avg(pred), 6) AS pred_mean, round(stddev_samp(pred), 6) AS pred_std
FROM lg GROUP BY ALL"""

SQL["pair_agreement"] = with_views(RATINGS) + f""", lg AS ({LG_DOC}),
p AS (SELECT a.signal,
             CASE WHEN abs(a.gold - b.gold) < 1.0 THEN 'tie'
                  WHEN (a.gold - b.gold > 0 AND a.pred - b.pred > 0) OR (a.gold - b.gold < 0 AND a.pred - b.pred < 0)
                  THEN 'agree' ELSE 'disagree' END AS k
      FROM lg a JOIN lg b ON a.doc_id = b.doc_id AND a.signal = b.signal AND a.row_id < b.row_id
      WHERE a.gold IS NOT NULL AND b.gold IS NOT NULL AND a.pred IS NOT NULL AND b.pred IS NOT NULL)
SELECT signal, count(*) AS total_pairs, count(*) FILTER (WHERE k = 'agree') AS agree,
       count(*) FILTER (WHERE k = 'disagree') AS disagree, count(*) FILTER (WHERE k = 'tie') AS tie,
       round(100.0 * count(*) FILTER (WHERE k = 'agree') / count(*), 6) AS agree_pct,
       round(100.0 * count(*) FILTER (WHERE k = 'disagree') / count(*), 6) AS disagree_pct,
       round(100.0 * count(*) FILTER (WHERE k = 'tie') / count(*), 6) AS tie_pct
FROM p GROUP BY signal"""

SQL["compression_ratio"] = with_views(RATINGS) + f""", lg AS ({LG_DOC}),
g AS (SELECT stddev_samp(score) AS gold_std FROM ratings)
SELECT signal, round(g.gold_std, 6) AS gold_std, round(stddev_samp(pred), 6) AS pred_std,
       round(CASE WHEN g.gold_std > 0 THEN stddev_samp(pred) / g.gold_std END, 6) AS compression_ratio
FROM lg, g GROUP BY signal, g.gold_std"""

SQL["signal_summary"] = with_views(RATINGS) + f""", lg AS ({LG_DOC})
SELECT signal, count(pred) AS n, round(min(pred), 6) AS min, round(max(pred), 6) AS max,
       round(avg(pred), 6) AS mean, round(stddev_pop(pred), 6) AS std_pop,
       round(stddev_samp(pred), 6) AS std_samp FROM lg GROUP BY signal"""

_PAIRS = [(a, b) for i, a in enumerate(SIGNALS) for b in SIGNALS[i + 1:]]
_CROSS_LG = "\nUNION ALL\n".join(
    f"SELECT '{a}|{b}' AS signal, {a} AS pred, {b} AS gold FROM ratings" for a, b in _PAIRS)
SQL["cross_signal"] = with_views(RATINGS) + f""", {_overall_tau(_CROSS_LG)},
pr AS (SELECT signal, {_pearson()} AS pearson FROM ({_CROSS_LG}) z
       WHERE pred IS NOT NULL AND gold IS NOT NULL GROUP BY signal)
SELECT split_part(pr.signal, '|', 1) AS signal_a, split_part(pr.signal, '|', 2) AS signal_b,
       round(pr.pearson, 6) AS pearson, round(ov.tau, 6) AS kendall_tau
FROM pr LEFT JOIN ov ON ov.signal = pr.signal"""

_DIS = "\nUNION ALL\n".join(f"""(SELECT * FROM (
  SELECT '{a}' AS signal_a, '{b}' AS signal_b, row_id, round(score, 6) AS score,
         round({a}, 6) AS value_a, round({b}, 6) AS value_b,
         abs(({a} - avg({a}) OVER ()) / stddev_samp({a}) OVER () - ({b} - avg({b}) OVER ()) / stddev_samp({b}) OVER ()) AS d
  FROM ratings) ORDER BY d DESC NULLS LAST, row_id LIMIT 5)""" for a, b in _PAIRS)
SQL["signal_disagreement"] = with_views(RATINGS) + f"""
SELECT signal_a, signal_b, row_id, score, value_a, value_b, round(d, 6) AS diff FROM ({_DIS})"""

SQL["system_means"] = with_views(RATINGS) + f""", lg AS ({LG_LP})
SELECT signal, tgt_system, round(avg(gold), 6) AS gold_mean, round(avg(pred), 6) AS pred_mean
FROM lg WHERE tgt_system IS NOT NULL GROUP BY ALL"""

_BOARD = f""", lg AS ({LG_LP}), {_overall_tau('SELECT * FROM lg')},
td AS ({tau_per_group(LG_DOC, 'doc_id')}),
ps AS (SELECT sl.signal, coalesce(avg(td.tau), 0.0) AS per_source_tau
       FROM {SIG_VALUES} LEFT JOIN td ON td.signal = sl.signal GROUP BY sl.signal),
sp AS ({_spa('SELECT * FROM lg', 25.0)}),
board AS (SELECT o.signal, o.signal_order, round(ps.per_source_tau, 6) AS per_source_tau,
                 round(ov.tau, 6) AS overall_tau, round(sp.spa, 6) AS spa
          FROM (VALUES {', '.join(f"('{s}', {i})" for i, s in enumerate(SIGNALS))}) o(signal, signal_order)
          LEFT JOIN ps ON ps.signal = o.signal LEFT JOIN ov ON ov.signal = o.signal
          LEFT JOIN sp ON sp.signal = o.signal)"""
SQL["leaderboard"] = with_views(RATINGS) + _BOARD + "\nSELECT * FROM board"
SQL["best_signal"] = with_views(RATINGS) + _BOARD + \
    "\nSELECT * FROM board ORDER BY per_source_tau DESC, signal_order LIMIT 1"

_VF = """vf AS (SELECT vec_id, CAST(label AS DOUBLE) AS label,
         sqrt(list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda a, b: a + b)) AS emb_norm,
         list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda a, b: a + b) / len(embedding) AS emb_mean
       FROM embeddings),
vf2 AS (SELECT v.*, sqrt(list_reduce(list_transform(e.embedding, lambda x: (CAST(x AS DOUBLE) - v.emb_mean) * (CAST(x AS DOUBLE) - v.emb_mean)), lambda a, b: a + b) / len(e.embedding)) AS emb_std
        FROM vf v JOIN embeddings e ON e.vec_id = v.vec_id)"""
_VF_LG = "\nUNION ALL\n".join(f"SELECT '{f}' AS signal, {f} AS pred, label AS gold FROM vf2"
                              for f in ("emb_norm", "emb_mean", "emb_std"))
SQL["feature_tau"] = f"WITH {_VF}, {_overall_tau(_VF_LG)}\nSELECT signal AS feature, n, round(tau, 6) AS tau FROM ov"


def _nudge_rounds(sql: str) -> str:
    """``round(x, 6)`` -> ``round((x) + 1e-9, 6)``: values that sit exactly on a
    rounding tie (means of 5-decimal data) then round the same way in both
    engines despite last-ulp summation differences."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + 6:k - 1]
        if inner.endswith(", 6"):
            out.append(sql[i:j] + "round((" + _nudge_rounds(inner[:-3]) + ") + 1e-9, 6)")
        else:
            out.append(sql[i:k])
        i = k


SQL = {k: _nudge_rounds(v) for k, v in SQL.items()}

# --- pairs ---------------------------------------------------------------------------------

SQL["doc_pairs"] = _nudge_rounds(with_views(RATINGS) + f""", t AS ({tau_per_group(LG_DOC, 'doc_id')}),
nn AS (SELECT doc_id, count(*) AS n FROM ratings GROUP BY doc_id)
SELECT t.doc_id, t.signal, nn.n, round(CAST(t.npairs AS DOUBLE), 6) AS n_pairs, round(CAST(t.s AS DOUBLE), 6) AS s,
       round(CAST(t.tx AS DOUBLE), 6) AS tied_pred, round(CAST(t.ty AS DOUBLE), 6) AS tied_gold
FROM t JOIN nn ON nn.doc_id = t.doc_id""")

SQL["preference_pairs"] = with_views(RATINGS) + """
SELECT r.doc_id, r.n, coalesce(p.c, 0) AS n_pairs
FROM (SELECT doc_id, count(*) AS n FROM ratings WHERE score IS NOT NULL GROUP BY doc_id) r
LEFT JOIN (SELECT a.doc_id, count(*) AS c FROM ratings a JOIN ratings b
           ON a.doc_id = b.doc_id AND a.score - b.score > 1.0 GROUP BY a.doc_id) p ON p.doc_id = r.doc_id"""

SQL["disagreement_examples"] = _nudge_rounds(with_views(RATINGS) + """
SELECT a.doc_id, a.row_id AS row_i, b.row_id AS row_j, a.tgt_system AS sys_i, b.tgt_system AS sys_j,
       round(a.score - b.score, 6) AS gold_diff, round(a.sig_a_score - b.sig_a_score, 6) AS pred_diff
FROM ratings a JOIN ratings b ON a.doc_id = b.doc_id AND a.row_id < b.row_id
WHERE abs(a.score - b.score) >= 1.0
  AND NOT ((a.score - b.score > 0 AND a.sig_a_score - b.sig_a_score > 0)
        OR (a.score - b.score < 0 AND a.sig_a_score - b.sig_a_score < 0))
ORDER BY a.doc_id, a.row_id, b.row_id LIMIT 5""")

SQL["seeded_shuffle"] = with_views(RATINGS) + """
SELECT row_id, doc_id, row_number() OVER (ORDER BY md5('42|' || row_id)) - 1 AS position FROM ratings"""

# --- features ----------------------------------------------------------------------------------

def _wcount(c):
    return f"len(list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> ''))"


_TF = f"""tf AS (SELECT row_id, src_text, tgt_text,
              {_wcount('src_text')} AS src_word_count, {_wcount('tgt_text')} AS tgt_word_count,
              length(src_text) AS src_char_count, length(tgt_text) AS tgt_char_count FROM segments)"""
SQL["text_features"] = _nudge_rounds(with_views(SEGMENTS) + f""", {_TF}
SELECT row_id, src_word_count, tgt_word_count,
       round(tgt_word_count / greatest(src_word_count, 1), 6) AS length_ratio,
       src_char_count, tgt_char_count, round(tgt_char_count / greatest(src_char_count, 1), 6) AS char_ratio
FROM tf""")

_CROSS = ", ".join(f"round({a} - {b}, 6) AS {a}_minus_{b}, round({a} * {b}, 6) AS {a}_times_{b}"
                   for a, b in _PAIRS)
SQL["cross_features"] = _nudge_rounds(with_views(RATINGS) + f"SELECT row_id, {_CROSS} FROM ratings")

_DOCSTATS = ", ".join(f"avg({s}) AS {s}_doc_mean, stddev_samp({s}) AS {s}_doc_std, "
                      f"min({s}) AS {s}_doc_min, max({s}) AS {s}_doc_max" for s in SIGNALS)
_DOCCOLS = ", ".join(f"round(d.{s}_doc_{st}, 6) AS {s}_doc_{st}" for s in SIGNALS
                     for st in ("mean", "std", "min", "max")) + ", " + ", ".join(
    f"round(r.{s} - d.{s}_doc_mean, 6) AS {s}_doc_dev" for s in SIGNALS)
SQL["doc_context"] = _nudge_rounds(with_views(RATINGS) + f""", d AS (SELECT doc_id, {_DOCSTATS} FROM ratings GROUP BY doc_id)
SELECT r.row_id, {_DOCCOLS} FROM ratings r LEFT JOIN d ON d.doc_id = r.doc_id""")

_SPANF = """sf AS (
  SELECT o.o_orderkey AS doc_id, CAST(coalesce(s.c, 0) AS DOUBLE) AS error_count,
         coalesce(s.sev, 0.0) AS error_severity, coalesce(s.conf, 0.0) AS error_confidence
  FROM orders o LEFT JOIN (
    SELECT doc_id, count(*) AS c,
           sum(CASE coalesce(severity, 'minor') WHEN 'minor' THEN 1.0 WHEN 'major' THEN 2.0
                    WHEN 'critical' THEN 3.0 ELSE 1.0 END) AS sev,
           avg(coalesce(confidence, 0.5)) AS conf
    FROM span_rows GROUP BY doc_id) s ON s.doc_id = o.o_orderkey)"""
SQL["span_features"] = _nudge_rounds(with_views(SPAN_ROWS, _SPANF) + """
SELECT doc_id, round(error_count, 6) AS error_count, round(error_severity, 6) AS error_severity,
       round(error_confidence, 6) AS error_confidence FROM sf""")

SQL["vector_features"] = _nudge_rounds(f"WITH {_VF}\nSELECT vec_id, round(emb_norm, 6) AS emb_norm, "
                                       "round(emb_mean, 6) AS emb_mean, round(emb_std, 6) AS emb_std FROM vf2")

_EX = """ex AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v,
                unnest(generate_series(0, len(embedding) - 1)) AS pos FROM embeddings),
pool AS (SELECT label, pos, avg(v) AS m, count(*) AS n FROM ex GROUP BY ALL)"""
SQL["mean_pool"] = _nudge_rounds(f"WITH {_EX}\nSELECT label, n, pos AS dim, round(m, 6) AS value FROM pool")
SQL["cosine"] = _nudge_rounds(f"""WITH {_EX},
pn AS (SELECT label, sqrt(sum(m * m)) AS np FROM pool GROUP BY label),
dots AS (SELECT ex.vec_id, ex.label, sum(ex.v * pool.m) AS dot, sqrt(sum(ex.v * ex.v)) AS nv
         FROM ex JOIN pool ON pool.label = ex.label AND pool.pos = ex.pos GROUP BY ALL)
SELECT dots.vec_id, dots.label,
       round(CASE WHEN nv * np > 0 THEN dot / (nv * np) END, 6) AS cosine
FROM dots JOIN pn ON pn.label = dots.label""")

SQL["speech_rate"] = _nudge_rounds(with_views(SEGMENTS, AUDIO_META) + f"""
SELECT row_id, frames, round(frames / sample_rate, 6) AS audio_duration,
       round({_wcount('src_text')} / greatest(frames / sample_rate, 0.1), 6) AS words_per_sec
FROM audio_meta""")

_FEAT = ", ".join(f"round(r.{s}, 6) AS {s}" for s in SIGNALS)
SQL["build_features"] = _nudge_rounds(with_views(RATINGS, SPAN_ROWS, _SPANF) + f""",
d AS (SELECT doc_id, {_DOCSTATS} FROM ratings GROUP BY doc_id)
SELECT r.row_id, {_FEAT},
       CASE WHEN r.tgt_lang = 'zh' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_zh,
       CASE WHEN r.tgt_lang = 'de' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_de,
       {_CROSS.replace('round(', 'round(r.').replace(' - ', ' - r.').replace(' * ', ' * r.')},
       {', '.join(f"round(coalesce(d.{s}_doc_{st}, 0.0), 6) AS {s}_doc_{st}" for s in SIGNALS for st in ('mean', 'std', 'min', 'max'))},
       {', '.join(f"round(coalesce(r.{s} - d.{s}_doc_mean, 0.0), 6) AS {s}_doc_dev" for s in SIGNALS)},
       round(coalesce(sf.error_count, 0.0), 6) AS error_count,
       round(coalesce(sf.error_severity, 0.0), 6) AS error_severity,
       round(coalesce(sf.error_confidence, 0.0), 6) AS error_confidence
FROM ratings r LEFT JOIN d ON d.doc_id = r.doc_id LEFT JOIN sf ON sf.doc_id = r.doc_id""")

# --- folds, blending, weight search -----------------------------------------------------------------

FOLD = "CAST(('0x' || substr(md5('42|' || CAST(doc_id AS VARCHAR)), 1, 8))::UBIGINT % 5 AS BIGINT)"
SQL["doc_folds"] = with_views(RATINGS) + f"SELECT DISTINCT doc_id, {FOLD} AS fold FROM ratings"
SQL["balanced_folds"] = with_views(RATINGS) + """
SELECT doc_id, n, CAST(CASE WHEN (p // 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END AS BIGINT) AS fold
FROM (SELECT doc_id, n, row_number() OVER (ORDER BY n DESC, doc_id) - 1 AS p
      FROM (SELECT doc_id, count(*) AS n FROM ratings GROUP BY doc_id))"""
SQL["weighted_ensemble"] = _nudge_rounds(with_views(RATINGS) + f""",
w AS (SELECT {_pearson('sig_a_score', 'score')} AS wa, {_pearson('sig_b_score', 'score')} AS wb, 1.0 / 3 AS wc FROM ratings)
SELECT row_id, round((sig_a_score * wa + sig_b_score * wb + sig_c_score * wc) / (wa + wb + wc), 6) AS ensemble_score
FROM ratings, w""")

_GRID = [0.0, 0.25, 0.5, 0.75, 1.0]
_CANDS = [(a, b, c) for a in _GRID for b in _GRID for c in _GRID if a + b + c > 0]
_CAND_VALUES = ", ".join(f"({i}, '{a:g},{b:g},{c:g}', {a}, {b}, {c})" for i, (a, b, c) in enumerate(_CANDS))
_SWEEP = f"""cands AS (SELECT * FROM (VALUES {_CAND_VALUES}) v(cand_order, weights, wa, wb, wc)),
bl AS (SELECT c.cand_order, r.row_id, r.doc_id, r.score AS gold,
              (r.sig_a_score * c.wa + r.sig_b_score * c.wb + r.sig_c_score * c.wc) / (c.wa + c.wb + c.wc) AS pred
       FROM ratings r, cands c),
dt AS ({tau_per_group("SELECT row_id, doc_id, CAST(cand_order AS VARCHAR) AS signal, pred, gold FROM bl", 'doc_id')}),
sweep AS (SELECT c.cand_order, c.weights, c.wa, c.wb, c.wc, coalesce(avg(dt.tau), 0.0) AS tau
          FROM cands c LEFT JOIN dt ON dt.signal = CAST(c.cand_order AS VARCHAR) GROUP BY ALL)"""
SQL["weight_sweep"] = _nudge_rounds(with_views(RATINGS) + f", {_SWEEP}\nSELECT weights, round(tau, 6) AS tau FROM sweep")
SQL["final_score"] = _nudge_rounds(with_views(RATINGS) + f""", {_SWEEP},
best AS (SELECT * FROM sweep ORDER BY round(tau, 9) DESC, cand_order LIMIT 1)
SELECT r.row_id, round((r.sig_a_score * b.wa + r.sig_b_score * b.wb + r.sig_c_score * b.wc) / (b.wa + b.wb + b.wc), 6) AS final_score
FROM ratings r, best b""")
_LINE_SIGNALS = " UNION ALL ".join(
    f"SELECT '{s}' AS signal, doc_id, row_id, score, {' + '.join(x for x in SIGNALS if x != s)} AS rest, {s} AS own FROM ratings"
    for s in SIGNALS)
# between two breakpoints no pair changes its order: every breakpoint of every pair, in order
SQL["weight_lines"] = _nudge_rounds(with_views(RATINGS) + f""",
v AS ({_LINE_SIGNALS}),
p AS (SELECT a.signal, a.doc_id, a.rest - b.rest AS d0, a.own - b.own AS d1, sign(a.score - b.score) AS g
      FROM v a JOIN v b ON a.signal = b.signal AND a.doc_id = b.doc_id AND a.row_id < b.row_id),
s AS (SELECT signal, doc_id, CAST(count(*) - count_if(d0 = 0 AND d1 = 0) AS DOUBLE) * (count(*) - count_if(g = 0)) AS den
      FROM p GROUP BY signal, doc_id),
q AS (SELECT p.*, 1.0 / sqrt(s.den) AS unit FROM p JOIN s ON p.signal = s.signal AND p.doc_id = s.doc_id WHERE s.den > 0),
b AS (SELECT signal, sum(CASE WHEN d0 <> 0 THEN sign(d0) ELSE sign(d1) END * g * unit) AS base, count(DISTINCT doc_id) AS n
      FROM q GROUP BY signal),
f AS (SELECT signal, round(-d0 / d1, 9) AS t, sum(2 * sign(d1) * g * unit) AS jump
      FROM q WHERE d0 * d1 < 0 AND abs(d0) < abs(d1) AND g <> 0 GROUP BY 1, 2),
u AS (SELECT signal, 0.0::DOUBLE AS t, 0.0::DOUBLE AS jump FROM b UNION ALL SELECT signal, t, jump FROM f),
c AS (SELECT signal, t, sum(jump) OVER w AS upto, coalesce(lead(t) OVER w, 1.0) AS high FROM u WINDOW w AS (PARTITION BY signal ORDER BY t)),
o AS (SELECT c.signal, (b.base + c.upto) / b.n AS tau, c.t AS low, c.high FROM c JOIN b ON b.signal = c.signal WHERE c.high > c.t),
m AS (SELECT *, max(tau) OVER (PARTITION BY signal) AS top FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY low) AS o FROM m WHERE tau >= top - 1e-9)
SELECT signal, round(tau, 6) AS tau, round(low, 6) AS low, round(high, 6) AS high FROM r WHERE o = 1""")
SQL["oof_tau"] = _nudge_rounds(with_views(RATINGS) + f""",
lg AS (SELECT row_id, doc_id, {FOLD} AS fold, 'sig_a_score' AS signal, sig_a_score AS pred, score AS gold FROM ratings),
t AS ({tau_per_group('SELECT * FROM lg', 'fold, doc_id')}),
per AS (SELECT fold, coalesce(avg(tau), 0.0) AS tau, count(tau) AS n_docs FROM t GROUP BY fold)
SELECT fold, round(tau, 6) AS tau, n_docs FROM per
UNION ALL SELECT -1, round(avg(tau), 6), sum(n_docs) FROM per""")

def _permuted(x: str) -> str:
    """One turn of the keyed permutation of m-bit numbers, in SQL."""
    for a, c in permutation_rounds(42):
        x = f"(({x} * {a} + {c}) % (1::BIGINT << m))"
        x = f"xor({x}, {x} >> ((m + 1) // 2))"
    return x


SQL["pair_cap"] = _nudge_rounds(with_views(RATINGS).replace("WITH", "WITH RECURSIVE", 1) + f""",
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, row_id) AS dp FROM ratings),
prs AS (SELECT row_number() OVER (ORDER BY b.doc_id, b.dp, w.dp) - 1 AS pair_index, b.doc_id,
               b.row_id AS row_better, w.row_id AS row_worse, b.tgt_system AS tgt_system_better, w.tgt_system AS tgt_system_worse,
               b.sig_a_score AS sb, w.sig_a_score AS sw, b.score AS gb, w.score AS gw
        FROM p b JOIN p w ON b.doc_id = w.doc_id AND b.score - w.score > 1.0),
n AS (SELECT count(*) AS total, greatest(2, length(bin(count(*) - 1))) AS m FROM prs),
walk AS (SELECT i, {_permuted('i')} AS x FROM (SELECT range AS i FROM range(0, 50000)), n
         UNION ALL SELECT i, {_permuted('x')} FROM walk, n WHERE x >= total),
picked AS (SELECT x FROM walk, n WHERE x < total)
SELECT pair_index, doc_id, row_better, row_worse, tgt_system_better, tgt_system_worse,
       round(sb, 6) AS sig_a_score_better, round(sw, 6) AS sig_a_score_worse,
       round(gb / 100.0, 6) AS score_better, round(gw / 100.0, 6) AS score_worse, round((gb - gw) / 100.0, 6) AS margin
FROM prs, n WHERE total <= 50000 OR pair_index IN (SELECT x FROM picked)""")

# ways[n]: share of the permutations of n items with 0, 1, .. inversions (the
# n-th item adds 0 to n - 1 of them); with ties the normal approximation, its
# tail by the series of the error function
SQL["per_source_pvalue"] = _nudge_rounds(with_views(RATINGS).replace("WITH", "WITH RECURSIVE", 1) + f""", lg AS ({LG_DOC}),
ways AS (SELECT 1 AS n, [1.0::DOUBLE] AS w
  UNION ALL SELECT n + 1, list_transform(range(0, len(w) + n), lambda k: list_sum(w[greatest(1, k - n + 1):least(len(w), k + 1)]) / (n + 1))
  FROM ways WHERE n < 33),
p AS (SELECT a.signal, a.doc_id, sum(sign(a.gold - b.gold) * sign(a.pred - b.pred)) AS s,
             count_if(a.pred = b.pred) AS tx, count_if(a.gold = b.gold) AS ty, count(*) AS total
      FROM lg a JOIN lg b ON a.signal = b.signal AND a.doc_id = b.doc_id AND a.row_id < b.row_id GROUP BY ALL),
c AS (SELECT signal, doc_id, count(*)::DOUBLE AS n FROM lg GROUP BY ALL),
x AS (SELECT signal, doc_id, sum(t * (t - 1) * (t - 2)) AS x0, sum(t * (t - 1) * (2 * t + 5)) AS x1
      FROM (SELECT signal, doc_id, pred, count(*)::DOUBLE AS t FROM lg GROUP BY ALL) GROUP BY ALL),
y AS (SELECT signal, doc_id, sum(t * (t - 1) * (t - 2)) AS y0, sum(t * (t - 1) * (2 * t + 5)) AS y1
      FROM (SELECT signal, doc_id, gold, count(*)::DOUBLE AS t FROM lg GROUP BY ALL) GROUP BY ALL),
j AS (SELECT p.*, c.n, x0, x1, y0, y1, n * (n - 1) AS m, ((total - s) / 2)::BIGINT AS d
      FROM p JOIN c USING (signal, doc_id) JOIN x USING (signal, doc_id) JOIN y USING (signal, doc_id)
      WHERE tx < total AND ty < total),
z AS (SELECT *, abs(s) / sqrt(2 * ((m * (2 * n + 5) - x1 - y1) / 18 + 2 * tx * ty / m
             + CASE WHEN n > 2 THEN x0 * y0 / (9 * m * (n - 2)) ELSE 0 END)) AS e FROM j),
q AS (SELECT z.*, w.w, CASE WHEN tx = 0 AND ty = 0 THEN
    CASE WHEN 2 * least(d, total - d) = total THEN 1.0 ELSE least(1.0, 2 * list_sum(w.w[1:least(d, total - d) + 1])) END
  ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90),
         lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * power(e, 2 * k + 1) / (gamma(k + 1.0) * (2 * k + 1)))) END AS pv
  FROM z JOIN ways w ON w.n = z.n)
SELECT signal, doc_id, round(s / sqrt((total - tx) * (total - ty)), 6) AS tau, round(pv, 6) AS pvalue FROM q""")

# isotonic fit in its max-min form: the largest, over starts up to a point, of the
# smallest mean from the start to an end at or after the point
SQL["isotonic_oof"] = _nudge_rounds(with_views(RATINGS) + f""",
sz AS (SELECT {LP} AS lp, doc_id, count(*) AS c FROM ratings GROUP BY 1, 2),
fo AS (SELECT lp, doc_id, row_number() OVER (PARTITION BY lp ORDER BY c DESC, doc_id) - 1 AS p,
              least(count(*) OVER (PARTITION BY lp), 5) AS kk FROM sz),
fd AS (SELECT lp, doc_id, kk, CASE WHEN kk < 2 THEN -1 WHEN (p // kk) % 2 = 0 THEN p % kk ELSE kk - 1 - p % kk END AS fold FROM fo),
r AS (SELECT t.row_id, fd.lp, fd.fold, fd.kk, t.sig_a_score AS x, t.score AS y
      FROM ratings t JOIN fd ON fd.lp = t.src_lang || '->' || t.tgt_lang AND fd.doc_id = t.doc_id),
pt AS (SELECT r.lp, g.f, r.x, count(*) AS w, sum(r.y) AS s FROM r JOIN range(0, 5) g(f) ON r.fold <> g.f AND g.f < r.kk GROUP BY ALL),
px AS (SELECT *, row_number() OVER o AS i, sum(w) OVER o AS cw, sum(s) OVER o AS cs FROM pt WINDOW o AS (PARTITION BY lp, f ORDER BY x)),
jk AS (SELECT a.lp, a.f, a.i AS j, b.i AS k, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS m
       FROM px a JOIN px b ON a.lp = b.lp AND a.f = b.f AND b.i >= a.i),
mn AS (SELECT lp, f, j, k, min(m) OVER (PARTITION BY lp, f, j ORDER BY k DESC) AS low FROM jk),
fit AS (SELECT px.lp, px.f, px.x, v.v FROM px JOIN (SELECT lp, f, k, max(low) AS v FROM mn GROUP BY ALL) v
        ON v.lp = px.lp AND v.f = px.f AND v.k = px.i),
a AS (SELECT r.*, fit.x AS lx, fit.v AS lv FROM r ASOF LEFT JOIN fit ON r.lp = fit.lp AND r.fold = fit.f AND r.x >= fit.x),
b AS (SELECT a.*, fit.x AS rx, fit.v AS rv FROM a ASOF LEFT JOIN fit ON a.lp = fit.lp AND a.fold = fit.f AND a.x <= fit.x)
SELECT row_id, fold, round(CASE WHEN lx IS NULL AND rx IS NULL THEN x WHEN lx IS NULL THEN rv WHEN rx IS NULL OR lx = rx THEN lv
                                ELSE lv + (rv - lv) * (x - lx) / (rx - lx) END, 6) AS calibrated FROM b""")

# --- scoring -----------------------------------------------------------------------------------------

_LEX = ("100.0 * least(length(coalesce(src_text, '')), length(coalesce(tgt_text, ''))) / "
        "greatest(length(coalesce(src_text, '')), length(coalesce(tgt_text, '')), 1)")
SQL["batch_scorer"] = _nudge_rounds(with_views(SEGMENTS) + f"SELECT row_id, round({_LEX}, 6) AS lexical_score FROM segments")
SQL["merge_signal"] = _nudge_rounds(with_views(SEGMENTS, SEGMENTS_LEFT) + f"""
SELECT s.row_id, l.lexical_score FROM segments s
LEFT JOIN (SELECT row_id, round({_LEX}, 6) AS lexical_score FROM segments_left) l ON l.row_id = s.row_id""")

# --- the same operators over the events matrix and the labelled documents -----------------

_LG_UM = "SELECT CAST(doc_id AS VARCHAR) || '|' || tgt_system AS row_id, doc_id, tgt_system, " \
         "'sig_k_score' AS signal, sig_k_score AS pred, score AS gold FROM user_matrix"
SQL["kendall_per_source_events"] = _nudge_rounds(with_views(USER_MATRIX) + f"""
, t AS ({tau_per_group(_LG_UM, 'doc_id')})
SELECT sl.signal, round(coalesce(avg(t.tau), 0.0), 6) AS per_source_tau, count(t.tau) AS n_docs
FROM (VALUES ('sig_k_score')) sl(signal) LEFT JOIN t ON t.signal = sl.signal GROUP BY sl.signal""")
SQL["spa_events"] = _nudge_rounds(with_views(USER_MATRIX) + f"""
SELECT signal, round(spa, 6) AS spa FROM ({_spa(_LG_UM, 25.0)})""")
SQL["kendall_overall_labels"] = _nudge_rounds(with_views(DOC_QUALITY) + f""",
{_overall_tau("SELECT 'len_score' AS signal, CAST(n_chars AS DOUBLE) AS pred, score AS gold FROM doc_quality")}
SELECT signal, n, round(tau, 6) AS tau FROM ov""")

_CV = f"""cands AS (SELECT * FROM (VALUES {_CAND_VALUES}) v(cand_order, weights, wa, wb, wc)),
bl AS (SELECT c.cand_order, r.row_id, r.doc_id, {FOLD} AS fold, r.score AS gold,
              (r.sig_a_score * c.wa + r.sig_b_score * c.wb + r.sig_c_score * c.wc) / (c.wa + c.wb + c.wc) AS pred
       FROM ratings r, cands c),
dt AS ({tau_per_group("SELECT row_id, doc_id, fold, CAST(cand_order AS VARCHAR) AS signal, pred, gold FROM bl", 'fold, doc_id')}),
per AS (SELECT fold, CAST(signal AS INTEGER) AS cand_order, sum(tau) AS fs, count(tau) AS fc
        FROM dt GROUP BY ALL),
tot AS (SELECT cand_order, sum(fs) AS ts, sum(fc) AS tc FROM per GROUP BY cand_order),
j AS (SELECT per.fold, per.cand_order,
             CASE WHEN tot.tc - per.fc > 0 THEN (tot.ts - per.fs) / (tot.tc - per.fc) ELSE 0.0 END AS train_tau,
             CASE WHEN per.fc > 0 THEN per.fs / per.fc ELSE 0.0 END AS val_tau
      FROM per JOIN tot ON tot.cand_order = per.cand_order),
ranked AS (SELECT j.*, c.weights, c.wa, c.wb, c.wc,
                  row_number() OVER (PARTITION BY j.fold ORDER BY round(j.train_tau, 9) DESC, j.cand_order) AS rk
           FROM j JOIN cands c ON c.cand_order = j.cand_order)"""
SQL["cv_ensemble"] = _nudge_rounds(with_views(RATINGS) + f""", {_CV}
SELECT fold, weights, round(train_tau, 6) AS train_tau, round(val_tau, 6) AS val_tau,
       round(CAST(wa AS DOUBLE), 6) AS w_sig_a_score, round(CAST(wb AS DOUBLE), 6) AS w_sig_b_score,
       round(CAST(wc AS DOUBLE), 6) AS w_sig_c_score
FROM ranked WHERE rk = 1""")


# --- pairs over all rows, two-decimal gold ------------------------------------------------------------

_DECIMAL = """decimal_ratings AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS row_id,
         CASE WHEN l_suppkey % 4 = 0 THEN l_suppkey ELSE 1000000 + l_orderkey END AS doc_id,
         floor(l_extendedprice / 10)::DOUBLE / 100 AS score,
         l_quantity / 50 + 4.0 * l_tax AS sig_a_score
  FROM lineitem)"""


def _pair_loss(src: str) -> str:
    return f""",
p AS (SELECT greatest(0.0, greatest(0.5 * ((b.score - w.score) / 100), 0.01) - (b.sig_a_score - w.sig_a_score)) AS h,
             (power(b.sig_a_score - b.score / 100, 2) + power(w.sig_a_score - w.score / 100, 2)) / 2 AS q,
             CASE WHEN b.sig_a_score > w.sig_a_score THEN 1.0 ELSE 0.0 END AS r
      FROM {src} b JOIN {src} w ON b.doc_id = w.doc_id AND b.score - w.score > 1.0)
SELECT count(*) AS n_pairs, round(avg(h), 6) AS ranking_loss, round(avg(q), 6) AS mse_loss,
       round(avg(r), 6) AS rank_accuracy, round(0.3 * avg(q) + 0.7 * avg(h), 6) AS loss FROM p"""


SQL["pair_loss"] = _nudge_rounds(with_views(RATINGS) + _pair_loss("ratings"))
SQL["pair_loss_decimal"] = _nudge_rounds(with_views(_DECIMAL) + _pair_loss("decimal_ratings"))
SQL["pair_loss_fixed"] = _nudge_rounds(with_views(RATINGS) + """,
u AS (SELECT doc_id, score / 100 AS g, sig_a_score AS p FROM ratings),
l AS (SELECT count(*) AS n_pairs, avg(greatest(0.0, 0.01 - (b.p - w.p))) AS h
      FROM u b JOIN u w ON b.doc_id = w.doc_id AND b.g - w.g > 0.000001),
m AS (SELECT avg(power(p - g, 2)) AS q FROM u)
SELECT n_pairs, round(h, 6) AS ranking_loss, round(q, 6) AS mse_loss, round(0.3 * q + 0.7 * h, 6) AS loss FROM l, m""")
SQL["preference_pairs_decimal"] = with_views(_DECIMAL) + """
SELECT r.doc_id, r.n, coalesce(p.c, 0) AS n_pairs
FROM (SELECT doc_id, count(*) AS n FROM decimal_ratings GROUP BY doc_id) r
LEFT JOIN (SELECT a.doc_id, count(*) AS c FROM decimal_ratings a JOIN decimal_ratings b
           ON a.doc_id = b.doc_id AND a.score - b.score > 1.0 GROUP BY a.doc_id) p ON p.doc_id = r.doc_id"""
SQL["pair_agreement_decimal"] = with_views(_DECIMAL) + """,
p AS (SELECT CASE WHEN abs(a.score - b.score) < 1.0 THEN 'tie'
                  WHEN (a.score > b.score AND a.sig_a_score > b.sig_a_score)
                    OR (a.score < b.score AND a.sig_a_score < b.sig_a_score) THEN 'agree' ELSE 'disagree' END AS k
      FROM decimal_ratings a JOIN decimal_ratings b ON a.doc_id = b.doc_id AND a.row_id < b.row_id)
SELECT 'sig_a_score' AS signal, count(*) AS total_pairs, count(*) FILTER (WHERE k = 'agree') AS agree,
       count(*) FILTER (WHERE k = 'disagree') AS disagree, count(*) FILTER (WHERE k = 'tie') AS tie,
       round(100.0 * count(*) FILTER (WHERE k = 'agree') / count(*), 6) AS agree_pct,
       round(100.0 * count(*) FILTER (WHERE k = 'disagree') / count(*), 6) AS disagree_pct,
       round(100.0 * count(*) FILTER (WHERE k = 'tie') / count(*), 6) AS tie_pct
FROM p"""

# --- ridge stacking: three signals, folds dealt by size, solved by Cramer's rule ------------------------

_SUMS = ", ".join(["count(*) AS n", "sum(y) AS sy"] + [f"sum({x}) AS s{x}" for x in "abc"] + [f"sum({x} * y) AS y{x}" for x in "abc"]
                  + [f"sum({x} * {z}) AS s{x}{z}" for x, z in ("aa", "ab", "ac", "bb", "bc", "cc")])
_CENTRED = ", ".join([f"s{x}{z} - s{x} * s{z} / n + {1.0 if x == z else 0.0} AS m{x}{z}" for x, z in ("aa", "ab", "ac", "bb", "bc", "cc")]
                     + [f"y{x} - s{x} * sy / n AS v{x}" for x in "abc"] + [f"s{x} / n AS a{x}" for x in "abc"] + ["sy / n AS ay"])


def _det(c1, c2, c3):
    """Determinant of the matrix with these columns."""
    (a, b, c), (d, e, f), (g, h, i) = c1, c2, c3
    return f"({a} * ({e} * {i} - {f} * {h}) - {d} * ({b} * {i} - {c} * {h}) + {g} * ({b} * {f} - {c} * {e}))"


_A, _B, _C, _V = ("maa", "mab", "mac"), ("mab", "mbb", "mbc"), ("mac", "mbc", "mcc"), ("va", "vb", "vc")
SQL["ridge_stack"] = _nudge_rounds(with_views(RATINGS) + f""",
f AS (SELECT doc_id, CASE WHEN (p // 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END AS fold
      FROM (SELECT doc_id, row_number() OVER (ORDER BY count(*) DESC, doc_id) - 1 AS p FROM ratings GROUP BY doc_id)),
x AS (SELECT r.row_id, f.fold, r.score AS y, r.sig_a_score AS a, r.sig_b_score AS b, r.sig_c_score AS c
      FROM ratings r JOIN f ON f.doc_id = r.doc_id),
t AS (SELECT h.fold, {_SUMS} FROM (SELECT DISTINCT fold FROM x) h JOIN x ON x.fold <> h.fold GROUP BY h.fold),
m AS (SELECT fold, {_CENTRED} FROM t),
w AS (SELECT *, {_det(_V, _B, _C)} / {_det(_A, _B, _C)} AS wa, {_det(_A, _V, _C)} / {_det(_A, _B, _C)} AS wb,
             {_det(_A, _B, _V)} / {_det(_A, _B, _C)} AS wc FROM m)
SELECT x.row_id, x.fold, round(ay - wa * aa - wb * ab - wc * ac + wa * a + wb * b + wc * c, 6) AS meta_score
FROM x JOIN w ON w.fold = x.fold""")

# --- cross-validated blend ----------------------------------------------------------------------------------

_CV = SQL["cv_ensemble"].replace("round((val_tau) + 1e-9, 6) AS val_tau", "val_tau")
SQL["cv_weights"] = f"""WITH e AS ({_CV})
SELECT {", ".join(f"round(avg(w_{s}) + 1e-9, 6) AS w_{s}" for s in SIGNALS)}, round(avg(val_tau) + 1e-9, 6) AS mean_tau FROM e"""
_NUM = " + ".join(f"r.{s} * e.w_{s}" for s in SIGNALS)
_DEN = " + ".join(f"e.w_{s}" for s in SIGNALS)
SQL["cv_scores"] = _nudge_rounds(with_views(RATINGS) + f""", e AS ({_CV}),
r AS (SELECT *, {FOLD} AS fold FROM ratings)
SELECT r.row_id, r.fold, round(CASE WHEN {_DEN} <> 0 THEN ({_NUM}) / ({_DEN}) END, 6) AS cv_ensemble_score
FROM r JOIN e ON e.fold = r.fold""")

# --- ranker over all preference pairs: normal equations of the pair differences -------------------------

SQL["pairwise_ranker"] = _nudge_rounds(with_views(RATINGS) + f""",
d AS (SELECT a.sig_a_score - b.sig_a_score AS a, a.sig_b_score - b.sig_b_score AS b, a.sig_c_score - b.sig_c_score AS c
      FROM ratings a JOIN ratings b ON a.doc_id = b.doc_id AND a.score - b.score > 1.0),
m AS (SELECT sum(a * a) + 1 AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) + 1 AS bb, sum(b * c) AS bc,
             sum(c * c) + 1 AS cc, sum(a) AS va, sum(b) AS vb, sum(c) AS vc FROM d),
e AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM m),
w AS (SELECT (va * (bb * cc - bc * bc) - ab * (vb * cc - bc * vc) + ac * (vb * bc - bb * vc)) / det AS wa,
             (aa * (vb * cc - bc * vc) - va * (ab * cc - bc * ac) + ac * (ab * vc - vb * ac)) / det AS wb,
             (aa * (bb * vc - vb * bc) - ab * (ab * vc - vb * ac) + va * (ab * bc - bb * ac)) / det AS wc FROM e)
SELECT row_id, round(sig_a_score * wa + sig_b_score * wb + sig_c_score * wc, 6) AS ranker_score FROM ratings, w""")
SQL["pairwise_ranker_decimal"] = _nudge_rounds(with_views(_DECIMAL) + """,
r AS (SELECT *, CAST(length(row_id) AS DOUBLE) AS length_score FROM decimal_ratings),
d AS (SELECT a.sig_a_score - b.sig_a_score AS a, a.length_score - b.length_score AS b
      FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.score - b.score > 1.0),
m AS (SELECT sum(a * a) + 1 AS aa, sum(a * b) AS ab, sum(b * b) + 1 AS bb, sum(a) AS va, sum(b) AS vb FROM d)
SELECT row_id, round(sig_a_score * (va * bb - ab * vb) / (aa * bb - ab * ab)
                     + length_score * (aa * vb - ab * va) / (aa * bb - ab * ab), 6) AS ranker_score FROM r, m""")
