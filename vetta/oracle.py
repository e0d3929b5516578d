"""DuckDB twins of the fixture views and SQL helpers for ``oracle_sql()``.

These strings are the correctness oracle: plain ANSI SQL over the driver's
pre-registered tables, written independently of the Spark plans (pairs are
enumerated by brute-force self-joins here, never in the Spark code).
"""

RATINGS = """ratings AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   strftime(l_shipdate, '%Y%m%d')) AS row_id,
         l_orderkey AS doc_id,
         'SYS' || CAST(l_suppkey % 8 AS VARCHAR) AS tgt_system,
         'en' AS src_lang,
         CASE WHEN l_linestatus = 'O' THEN 'de' ELSE 'zh' END AS tgt_lang,
         l_returnflag AS domain,
         CASE WHEN l_linenumber % 2 = 0 THEN 'human' ELSE 'asr' END AS src_text_system,
         l_quantity * 1.4 + (l_suppkey % 8) * 4 AS score,
         l_quantity / 50 + 4.0 * l_tax AS sig_a_score,
         l_quantity / 100 + l_extendedprice / 100000 + (l_suppkey % 8) / 10 AS sig_b_score,
         10.0 * l_discount AS sig_c_score
  FROM lineitem)"""

SEGMENTS = """segments AS (
  SELECT CAST(u.conv_id AS VARCHAR) || '-' || CAST(u.turn AS VARCHAR) AS row_id,
         u.conv_id AS doc_id, u.text AS src_text, a.text AS tgt_text
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""

DOC_QUALITY = """doc_quality AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic,
         CAST(l.quality AS DOUBLE) * 100.0 AS score
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

USER_MATRIX = """user_matrix AS (
  SELECT user_id AS doc_id, event_type AS tgt_system, avg(value) AS score,
         avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS sig_k_score
  FROM events GROUP BY user_id, event_type)"""

SPAN_ROWS = """span_rows AS (
  SELECT l_orderkey AS doc_id,
         CASE WHEN l_tax = CAST(0.08 AS DOUBLE) THEN 'other'
              WHEN l_returnflag = 'A' THEN 'minor'
              WHEN l_returnflag = 'N' THEN 'major'
              WHEN l_returnflag = 'R' THEN 'critical' END AS severity,
         CASE WHEN l_tax = CAST(0.08 AS DOUBLE) THEN NULL ELSE 1.0 - l_discount END AS confidence
  FROM lineitem)"""

AUDIO_META = """audio_meta AS (
  SELECT row_id, doc_id, src_text, tgt_text,
         CAST((16000 * length(src_text)) // 15 AS BIGINT) AS frames, 16000 AS sample_rate
  FROM segments)"""

SIGNALS = ["sig_a_score", "sig_b_score", "sig_c_score"]


def with_views(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def long_signals(src: str, keep: str, signals=SIGNALS, gold: str = "score") -> str:
    """UNION ALL unpivot: ``keep, signal, pred, gold``."""
    parts = [f"SELECT {keep}, '{s}' AS signal, CAST({s} AS DOUBLE) AS pred, "
             f"CAST({gold} AS DOUBLE) AS gold FROM {src}" for s in signals]
    return "\nUNION ALL\n".join(parts)


def tau_per_group(long_src: str, keys: str) -> str:
    """Brute-force tau-b per ``keys, signal`` over a long table with a
    ``row_id`` column; groups of one row have no pair and are absent."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    sel = ", ".join(f"a.{k.strip()} AS {k.strip()}" for k in keys.split(","))
    return f"""SELECT {keys}, signal, count(*) AS npairs,
       count(*) FILTER (WHERE s IS NULL) AS nnull,
       sum(s) AS s, sum(tx) AS tx, sum(ty) AS ty,
       CASE WHEN count(*) FILTER (WHERE s IS NULL) = 0
             AND (count(*) - sum(tx)) * (count(*) - sum(ty)) > 0
            THEN sum(s) / sqrt((count(*) - sum(tx)) * (count(*) - sum(ty))) END AS tau
FROM (SELECT {sel}, a.signal,
             sign(a.pred - b.pred) * sign(a.gold - b.gold) AS s,
             CASE WHEN a.pred = b.pred THEN 1 ELSE 0 END AS tx,
             CASE WHEN a.gold = b.gold THEN 1 ELSE 0 END AS ty
      FROM ({long_src}) a JOIN ({long_src}) b
        ON {on} AND a.signal = b.signal AND a.row_id < b.row_id) p
GROUP BY {keys}, signal"""
