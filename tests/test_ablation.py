from sillage.plans.registry import QUERIES


def test_ablation_has_all_rows(spark, sf_dir):
    rows = QUERIES["ablation"](spark, sf_dir).collect()
    assert sorted((r["features"], r["k"]) for r in rows) == [(f, k) for f in ("full", "reduced") for k in (2, 3, 4)]
    assert all(-1 <= r["silhouette"] <= 1 and r["davies_bouldin"] > 0 and r["inertia"] > 0 for r in rows)
