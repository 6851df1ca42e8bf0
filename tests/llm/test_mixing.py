"""Drawn copies meet the raked marginals and the budget, where single draws cannot."""

import numpy as np

from strataweave.llm import mixing, queries


def test_copies_meet_marginals_and_budget(spark):
    got = queries.op10_mixing(spark, "/root/testdata/sf0.01").toPandas()
    wanted, total = mixing.BUDGET * got.weight, got.tokens.sum()
    assert wanted.max() > 1 and (np.abs(got["copies"] - wanted) < 1).all()
    assert abs((got.tokens * wanted).sum() / total - mixing.BUDGET) < 1e-6
    for name in mixing.MARGINALS:
        target = mixing.smoothed(got.groupby(name, dropna=False).tokens.sum().to_numpy())
        assert np.allclose((got.tokens * wanted).groupby(got[name].fillna("?")).sum() / total / mixing.BUDGET, target, atol=1e-4)
    assert abs(got["copies"].sum() / wanted.sum() - 1) < 0.05
