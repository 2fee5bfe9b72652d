import numpy as np

from sillage.llm import vectors


def result(spark, rows):
    out = vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out}


def brute(rows):
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    comp = np.array([i for i, _ in rows])
    while True:
        new = np.array([comp[near[k]].min() for k in range(len(rows))])
        if (new == comp).all():
            break
        comp = new
    return {i: (int(near[k].sum()) - 1, int(comp[k]), bool(comp[k] == i)) for k, (i, _) in enumerate(rows)}


def test_recall_and_exactness(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BUCKET", 32)
    monkeypatch.setattr(vectors, "BLOCK", 64)
    r = np.random.default_rng(3)
    centres = r.standard_normal((40, 16))
    rows = [(i, (centres[r.integers(40)] + 0.25 * r.standard_normal(16)).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)]
    want, got = brute(rows), result(spark, rows)
    links = sum(n for n, _, _ in want.values())
    assert sum(n for n, _, _ in got.values()) >= 0.995 * links
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(rows)


def test_recall_with_the_constants_as_they_are(spark):
    r = np.random.default_rng(8)
    centres = r.standard_normal((700, 24))
    rows = [(i, (centres[r.integers(700)] + 0.3 * r.standard_normal(24)).tolist()) for i in range(5000)]
    rows += [(5000 + i, (centres[0] + 0.05 * r.standard_normal(24)).tolist()) for i in range(2500)]
    assert vectors.scheme(len(rows))[1] > 1
    want, got = brute(rows), result(spark, rows)
    assert sum(n for n, _, _ in got.values()) >= 0.99 * sum(n for n, _, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1:] == want[i][1:] for i in want) >= 0.99 * len(rows)


def test_double_vectors_keep_their_precision(spark):
    rows = [(1, [1.0, 1e-12, 1.0]), (2, [1.0, 2e-12, 1.0]), (3, [1.0, 1e-12, 1.0])]
    out = vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == [(1, 2, 1), (2, 2, 1), (3, 2, 1)]


def test_clashing_columns_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 5, "x"), (1, [1.0, 0.0], 6, "y"), (2, [0.0, 1.0], 7, "z")]
    out = vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int, e string")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, nan]), (4, [1.0, inf]), (5, [1.0, None]), (6, []), (8, [2.0, 0.0]), (7, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    got = result(spark, rows)
    assert all(got[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10))
    assert got[7] == (2, 7, True) and got[8] == got[9] == (2, 7, False)
    assert got[None] == (0, None, False)
    assert result(spark, []) == {}


def test_registered_query_on_a_table_with_links(spark, tmp_path):
    """The given tables hold no pair at 0.9; here a third of the rows are near copies of one vector."""
    from sillage.llm.queries import QUERIES

    r = np.random.default_rng(12)
    centres = r.standard_normal((300, 64))
    rows = [(i, (centres[r.integers(300)] + 0.25 * r.standard_normal(64)).tolist(), 1) for i in range(2000)]
    rows += [(2000 + i, (centres[0] + 0.1 * r.standard_normal(64)).tolist(), 2) for i in range(1000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in QUERIES["op8_embedding_near_dedup"](spark, str(tmp_path)).collect()}
    want = brute([(i, v) for i, v, _ in rows])
    links = sum(n for n, _, _ in want.values())
    assert links > 900_000 and sum(n for n, _, _ in out.values()) >= 0.99 * links
    assert sum(out[i][1:] == want[i][1:] for i in want) >= 0.99 * len(rows)
