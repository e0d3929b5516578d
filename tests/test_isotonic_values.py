"""few values of a prediction are looked up once each, not with every row."""

import numpy as np
import pytest

from vetta.operators import isotonic, learn, pairstats


def test_few_values_and_all_rows_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(f"r{i}", None if i % 41 == 0 else int(rng.integers(0, 30)), "en", "de" if i % 3 else "zh",
             None if i % 17 == 0 else float(rng.normal()), None if i % 23 == 0 else float(rng.integers(-3, 4)) / 2) for i in range(300)]
    rows += [("one", 99, "en", "fr", 1.0, .5), ("zero", 3, "en", "de", 0.0, -0.0)]
    df = spark.createDataFrame(rows, "row_id string, doc_id long, src_lang string, tgt_lang string, score double, p double")
    sorted_rows, looked_up = [], isotonic.looked_up

    def counted(rows_, *a):
        sorted_rows.append(rows_.count())
        return looked_up(rows_, *a)

    monkeypatch.setattr(isotonic, "looked_up", counted)
    few = sorted((r.row_id, r.fold, r.calibrated) for r in learn.isotonic_oof(df, "p").collect())
    monkeypatch.setattr(pairstats, "BROADCAST_KEYS", 0)
    every = sorted((r.row_id, r.fold, r.calibrated) for r in learn.isotonic_oof(df, "p").collect())
    assert [r[:2] for r in few] == [r[:2] for r in every] and len(few) == len(rows)
    assert [r[2] is None for r in few] == [r[2] is None for r in every]
    assert [r[2] for r in few if r[2] is not None] == pytest.approx([r[2] for r in every if r[2] is not None])
    assert sorted_rows[0] < 80 < sorted_rows[1]
