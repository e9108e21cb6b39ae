import math
from collections import Counter

import numpy as np
import pytest

from meridia.operators import noise as N
from meridia.operators import privacy as V


@pytest.mark.parametrize("sigma", [1, 3, 40])
def test_discrete_gaussian_follows_its_law(sigma):
    draws = Counter(N.Stream(N.new_key(5), str(i)).gaussian(sigma) for i in range(8000))
    reach = range(-12 * sigma, 12 * sigma + 1)
    law = np.exp([-x * x / (2 * sigma**2) for x in reach])
    law /= law.sum()
    bins = np.searchsorted(np.cumsum(law), np.linspace(0, 1, 12)[1:-1])
    place = lambda x: int(np.searchsorted(bins, x + 12 * sigma, side="left"))
    seen, want = np.zeros(11), np.zeros(11)
    for x, n in draws.items():
        seen[place(x)] += n
    for x, p in zip(reach, law, strict=True):
        want[place(x)] += 8000 * p
    used = want > 0
    assert (((seen - want)[used] ** 2) / want[used]).sum() < 40 and seen[~used].sum() == 0


def test_noise_lies_on_the_grid_and_covers_sigma():
    key = N.new_key(1)
    values = [N.noisy(3.14159, 0.01, N.Stream(key, str(i))) for i in range(4000)]
    step = 2.0 ** (math.floor(math.log2(0.01)) - N.FINE)
    assert all((v / step).is_integer() for v in values)
    assert np.std(values) == pytest.approx(0.01, rel=0.05) and np.mean(values) == pytest.approx(3.14159, abs=1e-3)
    assert N.noisy(2.5, 0.0, N.Stream(key, "x")) == 2.5


def test_releases_differ_and_a_stored_one_stays(spark):
    df = spark.createDataFrame([(g, float(v % 7)) for g in "abc" for v in range(50)] + [(None, 1.0)], "g string, v double")
    def values(d):
        return {r["g"]: r["dp_mean"] for r in d.collect()}

    one, two = (V.dp_mean(df, "v", 1.0, 1e-5, 0, 6, keys=["g"]) for _ in range(2))
    assert values(one) == values(one) and all(values(one)[g] != values(two)[g] for g in ("a", "b", "c", None))
    assert len(set(values(one).values())) == 4
    a, b = (values(V.dp_mean(df, "v", 1.0, 1e-5, 0, 6, keys=["g"], seed=4)) for _ in range(2))
    assert a == b
    # the key is in no plan
    assert "token" not in one._jdf.queryExecution().toString()


def test_ledger_refuses_what_was_not_granted(spark):
    df = spark.createDataFrame([(float(v),) for v in range(20)], "v double")
    ledger = N.Ledger(1.0, 2e-5)
    V.dp_mean(df, "v", 0.6, 1e-5, 0, 20, ledger=ledger)
    with pytest.raises(ValueError, match="dp_mean would spend"):
        V.dp_mean(df, "v", 0.6, 1e-5, 0, 20, ledger=ledger)
    assert ledger.spent == (0.6, 1e-5)
