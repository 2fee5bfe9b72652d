from pyspark.sql import functions as F

from sillage.plans.registry import QUERIES


def test_the_matrix_has_all_blocks(spark, sf_dir):
    m = QUERIES["feature_matrix_full"](spark, sf_dir).cache()
    text = [c for c in m.columns if c.startswith("txt_dim_")]
    assert len(m.columns) == 1 + 37 and len(text) == 20
    assert {"verified_ratio", "availability_rate", "brand_refill_share", "eco_badge_count"} < set(m.columns)
    row = m.agg(F.count(F.lit(1)).alias("n"), *[F.stddev_pop(c).alias(c) for c in text], *[F.avg(c).alias(f"m_{c}") for c in text]).first()
    assert row["n"] == QUERIES["feature_matrix"](spark, sf_dir).count()
    assert all(abs(row[f"m_{c}"]) < 1e-6 for c in text)
    assert all(abs(row[c] - 1) < 1e-6 for c in text[:19]) and row[text[19]] < 1.1  # 20 texts at least, so 19 directions
