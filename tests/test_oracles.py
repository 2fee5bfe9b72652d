import pytest

from sillage.plans.registry import ORACLES, QUERIES
from tests.oracle import same

SLOW = {"kmeans_sweep", "ablation"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, name):
    same(spark, sf_dir, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_kmeans_sweep(spark, sf_dir):
    rows = sorted(QUERIES["kmeans_sweep"](spark, sf_dir).collect(), key=lambda r: r["k"])
    assert [r["k"] for r in rows] == [2, 3, 4]
    assert all(a["inertia"] >= b["inertia"] * 0.98 for a, b in zip(rows, rows[1:]))
    assert all(-1 <= r["silhouette"] <= 1 and r["davies_bouldin"] > 0 for r in rows)
    assert rows[0]["best_silhouette"] == max(rows, key=lambda r: r["silhouette"])["k"]
