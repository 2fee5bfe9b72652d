"""Command line: python -m sillage.cli COMMAND ...

    list                                 names of the queries
    run NAME SF_DIR [--out DIR]          a query over a table folder, shown or written as Parquet
    normalize BRONZE SILVER              combine per-site tables
    validate SF_DIR                      integrity report; exit code 1 unless it passes
    price-backstop SF_DIR OUT            price statistics, classified products, kept and dropped report
    export SF_DIR OUT                    the exploratory tables as CSV
    status DIR                           counts of stored files
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from sillage import schema
from sillage.plans.registry import QUERIES
from sillage.sources import io

GATES = ("provenance_gate", "evidence_gate", "rating_bounds", "price_sanity", "luxury_coverage", "review_quality", "collection_targets")
EXPORTED = ("luxury_counts_by_brand", "refill_share_by_brand", "price_tiles", "review_health", "text_sufficiency", "luxury_comparison", "refill_evidence")


def session() -> SparkSession:
    return SparkSession.builder.appName("sillage").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="sillage", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name")
    run.add_argument("sf_dir")
    run.add_argument("--out")
    for name, args in {"normalize": ("bronze", "silver"), "validate": ("sf_dir",), "price-backstop": ("sf_dir", "out"), "export": ("sf_dir", "out"), "features": ("sf_dir", "out"), "cluster": ("sf_dir", "out"), "gates": ("sf_dir", "out"), "crawl": ("sf_dir", "out"), "status": ("dir",)}.items():
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
    said = top.parse_args(argv)
    if said.command == "list":
        print("\n".join(QUERIES))
        return 0
    spark = session()
    if said.command == "run":
        df = QUERIES[said.name](spark, said.sf_dir)
        io.write_parquet(df, said.out) if said.out else df.show(truncate=False)
    elif said.command == "normalize":
        for kind, ddl in (("products", schema.PRODUCT), ("reviews", schema.REVIEW)):
            io.write_parquet(io.combine(spark, said.bronze, kind, ddl), f"{said.silver}/{kind}.parquet", by="site")
    elif said.command == "validate":
        row = QUERIES["integrity_report"](spark, said.sf_dir).first().asDict()
        print(io.summary("Integrity", row))
        return int(row["status"] != "PASS")
    elif said.command == "price-backstop":
        io.write_csv(QUERIES["price_stats"](spark, said.sf_dir), f"{said.out}/price_stats")
        io.write_parquet(QUERIES["luxury_classification"](spark, said.sf_dir), f"{said.out}/products_with_luxury")
        io.write_csv(QUERIES["kept_dropped"](spark, said.sf_dir), f"{said.out}/kept_dropped_report")
    elif said.command == "export":
        for name in EXPORTED:
            io.write_csv(QUERIES[name](spark, said.sf_dir), f"{said.out}/{name}")
    elif said.command == "gates":
        for name in GATES:
            io.write_csv(QUERIES[name](spark, said.sf_dir), f"{said.out}/{name}")
    elif said.command == "features":
        io.write_parquet(QUERIES["feature_matrix_full"](spark, said.sf_dir), f"{said.out}/feature_matrix")
    elif said.command == "cluster":
        for name in ("kmeans_sweep", "mini_batch_clusters", "cluster_profiles"):
            io.write_csv(QUERIES[name](spark, said.sf_dir), f"{said.out}/{name}")
    elif said.command == "crawl":
        for name in ("crawl_visits", "discovered_products", "scraped_products", "scraped_reviews"):
            io.write_parquet(QUERIES[name](spark, said.sf_dir), f"{said.out}/{name}")
    elif said.command == "status":
        print(io.summary("Stored files", io.stored_files(spark, said.dir).first().asDict()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
