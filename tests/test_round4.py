"""Findings of the fourth round: each of these failed before its change."""

import numpy as np
import pytest

from corpusloom.operators import stats


class Counted(np.random.PCG64):
    """numpy's bit generator, with the number of 32-bit numbers it was asked for."""

    asked = 0

    def random_raw(self, size=None, output=True):
        self.asked += 2 * (size or 1)
        return super().random_raw(size, output)


@pytest.mark.parametrize("at_once", [999, stats.AT_ONCE])
def test_groups_share_a_generator(at_once):
    """Numpy's own draws for every group, though the raw numbers are made once for all (F1)."""
    rng = np.random.default_rng(1)
    groups = [rng.random(n) + 1j * rng.integers(1, 51, n) for n in (1, 2, 3, 40, 4096, 4097, 70_001, 99_999)]
    groups[3][7] = np.nan + 1j
    source = Counted(17)
    got = stats.shared_sums(groups, 61, np.random.Generator(source), at_once)
    refused = 0
    for v, sums in zip(groups, got):
        again = np.random.default_rng(17)
        assert np.allclose(sums, v[again.integers(len(v), size=(61, len(v)))].sum(1), rtol=1e-12, equal_nan=True)
        one = np.random.default_rng(17).bit_generator.random_raw(61 * len(v) // 2).view(np.uint32)
        refused += np.count_nonzero(one * np.uint32(len(v)) < (1 << 32) % len(v))
    assert refused > 50  # numbers that numpy passes over shift all draws after them
    assert source.asked < 1.5 * 61 * len(groups[-1]) + (1 << 21)
    assert all(np.array_equal(stats.shared_sums([v], 61, np.random.default_rng(17), at_once)[0], s) for v, s in zip(groups[-1:], got[-1:]))


def test_bootstrap_of_groups_of_any_size(spark, monkeypatch):
    """A row for each group, equal to numpy's, wherever the groups are placed; nulls and NaN too (F1)."""
    rng = np.random.default_rng(4)
    rows = [(g, float(rng.integers(0, 90)), float(rng.random()), int(rng.integers(1, 9))) for g, n in ((None, 5), ("a", 1), ("b", 5000), ("c", 300), ("d", 5000)) for _ in range(n)]
    d = spark.createDataFrame([*rows, ("e", None, 1.0, 2), ("e", 3.0, float("nan"), 2)], "s string, a double, b double, n int")
    found = {r.s: r for r in stats.numpy_bootstrap(d.repartition(5), ["s"], "a", "a", "b", "n", draws=150).collect()}
    assert len(found) == 6 and np.isnan(found["e"].low) and found["e"].windows == 2
    for s in (None, "a", "b", "c", "d"):
        mine = sorted(r[1:] for r in rows if r[0] == s)
        diff, n = np.array([r[0] - r[1] for r in mine]), np.array([r[2] for r in mine])
        picks = np.random.default_rng(1701).integers(len(mine), size=(150, len(mine)))
        want = [diff.sum() / np.log(2) / n.sum(), *np.quantile(diff[picks].sum(1) / np.log(2) / n[picks].sum(1), [0.025, 0.975]), (diff < 0).sum(), len(mine)]
        assert np.allclose(list(found[s])[1:], want, rtol=1e-12)
    monkeypatch.setattr(stats, "GROUPS", 2)
    monkeypatch.setattr(stats, "HELD_ROWS", 5000)
    other = {r.s: r for r in stats.numpy_bootstrap(d, ["s"], "a", "a", "b", "n", draws=150).collect()}
    assert {s: r for s, r in found.items() if s != "e"} == {s: r for s, r in other.items() if s != "e"} and "e" in other
    assert not stats.numpy_bootstrap(d.limit(0), ["s"], "a", "a", "b", "n", draws=5).collect()
