"""Near-duplicate embeddings by random-hyperplane sign hashing.

Equal vectors are one class. In each of several tables a vector's bucket is the signs of its products with that
table's hyperplanes; bits per table follow the number of classes, tables follow from the recall asked for at the
threshold. Buckets are dealt out as pairs of blocks of bounded size, so a hot bucket is spread over tasks; within a
block pair the cosines are matrix products in double precision, a strip of rows at a time. A pair that meets in several
tables counts in the first of them. Vectors are shuffled once for each table, in the precision that the table has; few
large buckets need fewer tables, and so a smaller shuffle, than many small ones. Only link counts and a spanning forest
of each block pair leave the tasks; components are distributed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sillage.llm.common import components, cut

#: Cosine of a link; share of links at just that cosine that the tables must find; vectors of a bucket aimed at; the
#: most of a pair of blocks; rows of a strip; the seed of the hyperplanes.
COSINE, RECALL, BUCKET, BLOCK, STRIP, SEED = 0.9, 0.9998, 2048, 4096, 512, 20250101


def scheme(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table and number of tables for n classes."""
    bits = min(32, max(1, math.ceil(math.log2(max(2, n) / BUCKET)))) if n > BUCKET else 1
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def codes(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket of each row of x in each table."""
    planes = np.random.default_rng([SEED, x.shape[1]]).standard_normal((x.shape[1], bits * tables))
    signs = (x @ planes > 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def unit(blobs: pd.Series, kind: type) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # else squares of very large or small components leave the range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def lowest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the positions below n that each reaches by the links (a, b)."""
    low = np.arange(n)
    while True:
        was = low.copy()
        np.minimum.at(low, a, was[b])
        np.minimum.at(low, b, was[a])
        low = low[low]
        if (low == was).all():
            return low


def link_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(vec_id, embedding) to vec_id, n_links, component_id, kept: one row per row.

    Null, empty or zero vectors and such with null or non-finite components link with nothing, nor do vectors of
    different lengths with each other. A row with a null vec_id links with nothing and gets a null component_id and
    kept false. Rows that repeat a vec_id are vectors of their own in n_links and one node in component_id. Further
    columns are ignored; an empty table gives no rows.
    """
    e = F.col("e")
    fine = F.coalesce(F.size(e) > 0, F.lit(False)) & F.coalesce(F.forall(e, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("e")).withColumn(
        "fine", F.col("vec_id").isNotNull() & fine & F.coalesce(F.exists("e", lambda v: v != 0), F.lit(False))
    )
    classes = cut(rows.where("fine").groupBy("e").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")))
    bits, tables = scheme(classes.count(), cosine, recall)
    kind = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64

    def hashed(frames):
        for f in frames:
            f = f.reset_index(drop=True)
            for _, g in f.groupby(f["e"].map(len)):
                blobs = g["e"].map(lambda v: np.asarray(v, kind).tobytes())
                c = codes(unit(blobs, kind), bits, tables)
                for lot in range(0, len(g), 2000):
                    part = g.iloc[lot : lot + 2000]
                    for t in range(tables):
                        yield pd.DataFrame({
                            "t": t, "dim": part["e"].map(len), "code": c[lot : lot + 2000, t], "id": part["id"],
                            "copies": part["copies"], "v": blobs.iloc[lot : lot + 2000],
                        })

    placed = classes.mapInPandas(hashed, "t int, dim int, code bigint, id bigint, copies bigint, v binary")
    where = ["t", "dim", "code"]
    # Blocks of a bucket that needs several; the join is planned by the size this turns out to have.
    large = cut(placed.groupBy(*where).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK // 2))
    split = F.coalesce(F.ceil(F.col("m") / (BLOCK // 2)), F.lit(1))
    own = placed.join(large, where, "left").withColumn("blocks", split).withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = own.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    lo, hi = F.least("i", "j"), F.greatest("i", "j")
    dealt = dealt.select(*where, lo.alias("lo"), hi.alias("hi"), (F.col("i") == lo).alias("first"), "id", "copies", "v")

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"id": [], "links": [], "low": []}).astype("int64")
        if len(f) < 2:
            return out
        f = f.sort_values("id", kind="stable").reset_index(drop=True)
        x, ids, copies, t = unit(f["v"], kind), f["id"].to_numpy(), f["copies"].to_numpy(), int(f["t"].iloc[0])
        both, first = f["lo"].iloc[0] != f["hi"].iloc[0], f["first"].to_numpy()
        c = codes(x, bits, tables)[:, :t]
        at, links, low = np.arange(len(f)), np.zeros(len(f)), np.arange(len(f))
        for start in range(0, len(f), STRIP):
            near = x[start : start + STRIP] @ x[start:].T >= cosine
            if both:
                near &= first[start : start + STRIP, None] != first[None, start:]
            a, b = np.nonzero(np.triu(near, 1))
            if t and len(a):
                new = np.concatenate([~(c[start + a[k : k + 100_000]] == c[start + b[k : k + 100_000]]).any(1) for k in range(0, len(a), 100_000)])
                a, b = a[new], b[new]
            if len(a):
                a, b = start + a, start + b
                links += np.bincount(a, copies[b], len(f)) + np.bincount(b, copies[a], len(f))
                # ids ascend with positions: the smallest position that reaches a vector is its smallest id
                low = lowest(np.concatenate([a, at]), np.concatenate([b, low]), len(f))
        some = links > 0
        return pd.DataFrame({"id": ids[some], "links": links[some].astype("int64"), "low": ids[low[some]]})

    found = cut(dealt.groupBy(*where, "lo", "hi").applyInPandas(compare, "id bigint, links bigint, low bigint"))
    comps = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.join(links, "id", "left").join(comps, "id", "left").select(
        "e", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "id").alias("comp")
    )
    joined = rows.withColumn("e", F.when(F.col("fine"), F.col("e"))).join(named, "e", "left")
    component = F.coalesce("comp", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
