"""Retail analytics on Spark: declarative plans over product, review and crawl tables."""
