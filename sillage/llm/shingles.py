"""N-gram Jaccard join with PartEnum signatures.

The set of a document is its distinct 5-word shingles. Linked sets differ in few elements: with a Jaccard similarity
of 0.8 at least, in a quarter of the smaller set's size at most. Sets are put into overlapping size bands; the domain of shingles is
dealt into groups of sub-partitions, and within a group every subset of all but SPARE sub-partitions gives a
signature, a hash of the set's elements there. Two sets that differ in k elements differ in more than SPARE
sub-partitions of k // (SPARE + 1) groups at most, so a set that emits one group more is sure to share a signature
with every partner. Only groups without empty subsets count towards that number, so empty projections, which would
bring unrelated sets together, are never emitted; sets that run out of groups emit a further domain, in which the
elements that a bounded sample found in many documents take part again.

Pairs that share a signature are sifted by parity vectors (how many elements fall on each of some positions, modulo
two): these differ in no more positions than the sets in elements, so no link is lost. What is left is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sillage.llm.common import components, cut, few, scratch
from sillage.llm.dedup_links import linked

N_WORDS, SHARE = 5, 80
#: Size bands [a, BAND * a], each begun where sets that may link with the ones past the end before begin.
BAND = 2.5
#: Sub-partitions of a group in bands up to SMALL elements, and in others; how many of them a signature leaves out.
SMALL, FEW_SUBS, SUBS, SPARE = 64, 3, 2, 1
#: Documents of the sample in which an element must occur COMMON times to be left out of the first domain.
SAMPLE, COMMON = 8_000, 4
#: Classes above which a signature is dealt out by salts.
HOT = 4_096
#: Domains tried before empty projections count too; salts that a hot set's comparisons are dealt out by.
LEVELS, SALTS = 8, 16
#: Bits of the parity vector by which pairs are sifted before their texts are fetched.
PARITY = 2048
#: Of these, folded to so many longs, the bits that pairs without a leader are held against in their bucket.
FOLDED = 8
_C3 = 0x9E3779B97F4A7C15
_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, _C3))


def _times(k: int) -> np.uint64:
    return np.uint64(k * _C3 & (1 << 64) - 1)


_SPACE = bytes(range(9, 14)) + b" "
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (Stafford's variant 13), which leaves no structure in the low or high bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SPACES = np.zeros(256, bool)
_SPACES[list(_SPACE)] = True
_LOWERED = np.frombuffer(_LOWER, np.uint8)
_P = np.uint64(0x100000001B3)


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        np.multiply.accumulate(np.full(n - 1, _P), out=out[1:])
    return out


#: Powers of an odd base and of its inverse modulo 2**64, as far as a block of bytes reaches.
BLOCK = 1 << 16
_POW = _powers(BLOCK + 1)
_INV = np.empty(BLOCK + 1, np.uint64)
_INV[0] = 1
np.multiply.accumulate(np.full(BLOCK, np.uint64(pow(0x100000001B3, -1, 1 << 64))), out=_INV[1:])


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 text, A-Z lower-cased: a polynomial over its bytes, mixed with its length."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    inside = ~_SPACES[b]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.empty(0, np.uint64)
    out = np.empty(len(begin), np.uint64)
    low = mix(_LOWERED[b].astype(np.uint64) + _M3)
    at = 0
    while at < len(begin):  # words of up to BLOCK bytes at a time; a longer word is a block of its own
        start = begin[at]
        stop = max(at + 1, int(np.searchsorted(end, start + BLOCK, "right")))
        n = end[stop - 1] - start
        if n <= BLOCK:
            sums = np.empty(n + 1, np.uint64)
            sums[0] = 0
            np.cumsum(low[start : start + n] * _POW[:n], out=sums[1:])
            out[at:stop] = (sums[end[at:stop] - start] - sums[begin[at:stop] - start]) * _INV[begin[at:stop] - start]
        else:
            total = np.uint64(0)
            for k in range(start, start + n, BLOCK):
                part = low[k : min(k + BLOCK, start + n)]
                total = (mix(np.array([total])) + (part * _POW[: len(part)]).sum(dtype=np.uint64))[0]
            out[at] = total
        at = stop
    return mix(out + (end - begin).astype(np.uint64) * _M3)


def shingle_set(data: bytes, n: int = N_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of the whole sequence if there are fewer words."""
    w = word_hashes(data)
    if not len(w):
        return w
    n = min(n, len(w))
    h = np.full(len(w) - n + 1, np.uint64(n))
    for k in range(n):
        h = mix(h + w[k : len(w) - n + 1 + k] + _times(k))
    return np.unique(h)


_SALT = np.arange(1, FEW_SUBS + 1, dtype=np.uint64) * _M1


def bands(size: int) -> list[tuple[int, int]]:
    """The bands [a, b] of a size: any two sizes that may link share one. Below 4 only equal sets link: none."""
    out, a = [], 4
    while a <= size:
        b = max(12, int(BAND * a))
        if size <= b:
            out.append((a, b))
        a = -(-SHARE * (b + 1) // 100)
    return out


def signatures(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The signatures of a set (sorted hashes). common: sorted hashes left out of the first domain."""
    out = [np.empty(0, np.uint64)]
    rare = s
    if len(common) and len(s):
        rare = s[common[np.minimum(np.searchsorted(common, s), len(common) - 1)] != s]
    for low, high in bands(len(s)):
        subs = FEW_SUBS if high <= SMALL else SUBS
        most = high // 4 // (SPARE + 1) + 1
        groups = most + most // 4 + 2
        need = len(s) // 4 // (SPARE + 1) + 1
        for level in range(LEVELS):
            x = s if level else rare
            seed = _times((low << 20) + level)
            h = mix(x + seed)
            part = (((h >> np.uint64(32)) * np.uint64(groups * subs)) >> np.uint64(32)).astype(np.int64)
            sums = np.zeros(groups * subs, np.uint64)
            np.add.at(sums, part, mix(h))
            filled = (np.bincount(part, minlength=groups * subs) > 0).reshape(groups, subs)
            good = np.cumsum(filled.sum(1) > SPARE)
            enough, last = good[-1] >= need, level == LEVELS - 1
            stop = int(np.searchsorted(good, need)) + 1 if enough else groups
            g = seed + np.arange(stop, dtype=np.uint64) * _M2
            sums, filled = mix(sums.reshape(groups, subs)[:stop] + _SALT[:subs]), filled[:stop] | (last and not enough)
            for number, chosen in enumerate(combinations(range(subs), subs - SPARE)):
                made = mix(sums[:, chosen].sum(1, dtype=np.uint64) + g + np.uint64(number))
                out.append(made[filled[:, chosen].any(1)])
            if enough:
                break
    return np.unique(np.concatenate(out))


def _sample(docs: DataFrame) -> np.ndarray:
    """Hashes of the shingles that COMMON documents of a sample of about SAMPLE documents hold, sorted."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    few = docs.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set((text.as_py() or "").encode()).view(np.int64))], names=["h"])

    found = few.select("doc_id", "text").mapInArrow(run, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    return np.sort(np.array([r["h"] for r in found.collect()], np.int64).view(np.uint64))


def _infos(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(doc_id, text, h) to (doc_id, h, n, d1, d2, parity, sigs): the set's size, two digests that tell sets apart, its
    parity vector and its signatures (none without a doc_id)."""
    names = ["doc_id", "h", "n", "d1", "d2", "parity", "sigs"]

    def lists(rows: list[np.ndarray]) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *rows])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 250):
                part = b.slice(k, 250)
                n, d1, d2, odd, sigs = [], [], [], [], []
                for doc_id, text in zip(part.column(0), part.column(1), strict=True):
                    s = shingle_set((text.as_py() or "").encode())
                    n.append(len(s))
                    d1.append(s.sum(dtype=np.uint64))
                    d2.append(mix(s + _M1).sum(dtype=np.uint64))
                    bits = np.bincount((mix(s + _M2) % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
                    odd.append(np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64))
                    sigs.append(signatures(s, common).view(np.int64) if len(s) and doc_id.is_valid else np.empty(0, np.int64))
                d1, d2 = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (d1, d2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), d1, d2, lists(odd), lists(sigs)], names=names)

    return docs.mapInArrow(run, "doc_id bigint, h bigint, n bigint, d1 bigint, d2 bigint, parity array<bigint>, sigs array<bigint>")


def _met(reps: DataFrame) -> DataFrame:
    """(key, id, n, size, lead, lead_n) of the signatures that several classes share, the lead the smallest of these.

    Signatures are counted first, narrow and by partial aggregates; one that more than HOT classes share is dealt out by as
    many salts as its count holds HOT, its count and lead being known, so no task has more than some HOT rows of it."""
    rows = reps.select("id", "n", F.explode("sigs").alias("key"))
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("seen"), F.min(F.struct("id", "n")).alias("first"))
    hot = cut(counted.where(F.col("seen") > HOT))
    dealt = rows.join(few(hot, FEW), "key", "left")
    dealt = dealt.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.ceil(F.col("seen") / HOT)), F.lit(0)))
    bucket = Window.partitionBy("key", "salt")
    lead = F.coalesce("first", F.min(F.struct("id", "n")).over(bucket)).alias("lead")
    size = F.coalesce("seen", F.count(F.lit(1)).over(bucket)).alias("size")
    met = dealt.select("key", "id", "n", size, lead).where("size > 1")
    return cut(met.select("key", "id", "n", "size", F.col("lead.id").alias("lead"), F.col("lead.n").alias("lead_n")))


#: Rows up to which tables of ids, or of hot signatures, are broadcast.
FEW = 500_000


def _sifted(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose parity vectors allow a link: sets that link differ in (100 - SHARE) / (100 + SHARE) of the sum
    of their sizes at most. sets: (id, n, parity), a row per id."""
    pairs = cut(pairs)
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    own = cut(sets.join(few(cut(ids), FEW), "id"))
    side = lambda i: own.select(F.col("id").alias(i), F.col("n").alias(f"n_{i}"), F.col("parity").alias(f"p_{i}"))
    odd = F.aggregate(F.zip_with("p_a", "p_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where((100 + SHARE) * odd <= (100 - SHARE) * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _verifier(texts: DataFrame, reps: DataFrame):
    """(a, b) to the pairs whose sets link; texts: (doc_id, text), reps: (id, doc_id, h, n, parity) of the classes, h the
    text's hash. Each b's text goes to where a's set is made, once for each salt of a; rows arrive sorted, so that a
    task holds one set and one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now = None, None
        for batch in batches:
            a_out, b_out = [], []
            for a, salt, b, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                s = shingle_set((text.as_py() or "").encode())
                if b is None:
                    own, now = (a, salt), s
                    continue
                assert own == (a, salt), "a set's own row comes first"
                both = len(np.intersect1d(now, s, assume_unique=True))
                if 100 * both >= SHARE * (len(now) + len(s) - both):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(_sifted(pairs, reps.select("id", "n", "parity")).withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS))))
        own = pairs.select("a", "salt").distinct()
        wanted = own.select("a", "salt", F.lit(None).cast("bigint").alias("b")).unionByName(pairs)
        wanted = cut(wanted.withColumn("id", F.coalesce("b", "a")))
        ids = cut(wanted.select("id").distinct())
        where = cut(reps.select("id", "doc_id", "h").join(few(ids, FEW), "id"))
        keyed = cut(wanted.join(where, "id").select("a", "salt", "b", "doc_id", "h"))
        # texts are moved once; rows that repeat a doc_id and text only give a pair twice
        rows = texts.withColumn("h", F.xxhash64("text")).join(few(keyed, FEW), ["doc_id", "h"]).select("a", "salt", "b", "text")
        dealt = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return dealt.mapInArrow(run, "a bigint, b bigint")

    return verify


@scratch
def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, n_shingles, component_id: one row per row of docs.

    Null, empty and wordless texts have no shingles and link with nothing. A row with a null doc_id has its
    n_shingles, links with nothing and gets a null component_id; rows that share a doc_id are one node, with the links
    of all their texts. Equal sets are one class before signatures are dealt out, so thousands of copies cost one row
    each. Whole texts count, however long: a task holds one set at a time. Ties need no rule: a component's id is its
    smallest doc_id. Further columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    made = _infos(docs.select("doc_id", "text", F.xxhash64("text").alias("h")), _sample(docs))
    infos = cut(made.withColumn("uid", F.monotonically_increasing_id()))
    digests = ["n", "d1", "d2"]
    real = infos.where("n > 0 and doc_id is not null")
    classes = cut(real.groupBy(*digests).agg(F.min("uid").alias("id"), F.min("doc_id").alias("least")))
    named = real.select("uid", *digests).join(classes, digests).select("uid", "id")
    own = cut(infos.select("doc_id", "n", "uid").join(named, "uid", "left"))
    copies = cut(own.where("uid <> id").select("uid"))
    reps = real.join(few(copies, FEW), "uid", "left_anti").withColumnRenamed("uid", "id")

    met = _met(reps)
    near = lambda a, b: 100 * F.least(a("n"), b("n")) >= SHARE * F.greatest(a("n"), b("n"))
    half = PARITY // 64 // FOLDED
    folds = [reduce(lambda x, y: x.bitwiseXOR(y), [F.get("parity", F.lit(i + k * FOLDED)) for k in range(half)]).alias(f"p{i}") for i in range(FOLDED)]

    def with_comp(comps: DataFrame) -> DataFrame:
        rows = reps.join(comps, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"), *folds)
        return met.where("size > 2").select("key", "id", "n").join(rows, "id")

    def near_rest(a, b):
        odd = sum((F.bit_count(a(f"p{i}").bitwiseXOR(b(f"p{i}"))) for i in range(FOLDED)), F.lit(0))
        return near(a, b) & ((100 + SHARE) * odd <= (100 - SHARE) * (a("n") + b("n")))

    comps = cut(linked(met.drop("size"), near, _verifier(docs, reps), with_comp, near_rest))
    # rows that share a doc_id are one node: their classes are linked
    several = own.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a < last").select("doc_id", "a")
    same = cut(own.join(several, "doc_id").where("id <> a").select("a", F.col("id").alias("b")))
    if not same.isEmpty():
        comps = cut(components(comps.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(same)))
    grouped = classes.select("id", "least").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    first = grouped.groupBy("comp").agg(F.min("least").alias("component_id"))
    of = grouped.join(first, "comp").select("id", "component_id")
    out = own.join(of, "id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
