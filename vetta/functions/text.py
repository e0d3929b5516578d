"""Column expressions over text and scores (all built-in, JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-letter language code -> shared-space encoder code; codes
# missing from the map fall back to the source / target defaults below.
LANG_CODES = {
    "en": "eng_Latn",
    "de": "deu_Latn",
    "zh": "zho_Hans",
    "ja": "jpn_Jpan",
    "cs": "ces_Latn",
    "uk": "ukr_Cyrl",
    "ru": "rus_Cyrl",
    "ar": "arb_Arab",
    "is": "isl_Latn",
}
DEFAULT_SRC_CODE = "eng_Latn"
DEFAULT_TGT_CODE = "deu_Latn"

ERROR_CAP = 25.0    # error scores live in [0, 25]; quality = 25 - error


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_count(c) -> Column:
    """Whitespace tokens; empty text gives 0, null stays null."""
    return F.size(F.filter(F.split(_c(c), r"(?U)\s+"), lambda x: x != ""))


def char_count(c) -> Column:
    return F.char_length(_c(c))


def ratio_floor1(num, den) -> Column:
    """``num / max(den, 1)``; null when either side is null (``greatest``
    alone would turn a null denominator into 1)."""
    n, d = _c(num), _c(den)
    return F.when(n.isNotNull() & d.isNotNull(), n / F.greatest(d, F.lit(1)))


def indicator(c, value: str) -> Column:
    """1.0 when equal, 0.0 otherwise (null compares as 0.0)."""
    return F.coalesce((_c(c) == F.lit(value)).cast("double"), F.lit(0.0))


def strip_ws(c) -> Column:
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def clean_text(df, cols=("src_text", "tgt_text")):
    """Drop rows with a null text, strip surrounding whitespace, and drop rows
    whose text is then empty or the literal string 'nan'."""
    out = df.na.drop(subset=list(cols))
    for c in cols:
        out = out.withColumn(c, strip_ws(F.col(c).cast("string")))
    for c in cols:
        out = out.filter(~F.col(c).isin("", "nan"))
    return out


def null_to_empty(c) -> Column:
    return F.coalesce(_c(c), F.lit(""))


def prompt_source_candidate(src, mt) -> Column:
    return F.concat(F.lit("source: "), null_to_empty(src), F.lit(" candidate: "), null_to_empty(mt))


def prompt_separator(src, mt, sep: str = " </s> ") -> Column:
    return F.concat(null_to_empty(src), F.lit(sep), null_to_empty(mt))


def model_input(src, mt) -> Column:
    return F.struct(_c(src).alias("src"), _c(mt).alias("mt"))


def lang_code(c, default: str) -> Column:
    m = F.create_map(*[F.lit(x) for kv in LANG_CODES.items() for x in kv])
    return F.coalesce(m[_c(c)], F.lit(default))


def clip_invert(err, cap: float = ERROR_CAP) -> Column:
    """``cap - clip(err, 0, cap)``; null stays null (``greatest`` skips nulls)."""
    e = _c(err)
    return F.when(e.isNotNull(), F.lit(cap) - F.least(F.greatest(e, F.lit(0.0)), F.lit(cap)))


def lp_label(src="src_lang", tgt="tgt_lang", sep: str = " -> ") -> Column:
    return F.concat(_c(src), F.lit(sep), _c(tgt))


def preview(c, n: int) -> Column:
    return F.substring(_c(c), 1, n)
