"""Best-fit packing by hierarchical residual packing.

Documents become token ids; longer ones are cut. Pieces of full length are sequences of their own. The others are
packed best-fit, decreasing, inside groups of bounded size; bins that are nearly full are final, the others go up a
tree as items of their filled length, several groups to one, and are packed again, until one group is left. Best-fit
leaves one bin at most that is half full or less, and two others never fit into one sequence; so of a group's others no
more than CLIMB, the emptiest, go up, which bounds every group whatever the number of documents. What moves between
rounds is (bin, length) pairs; each round is written to the shared folder.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillage.llm.common import cut

#: Tokens of a sequence; items of a group; groups that meet in one; up to how many free tokens a bin is nearly full;
#: bins of a group that go up.
LENGTH, GROUP, FAN_IN, NEARLY, CLIMB = 1024, 50_000, 8, 24, 4_096
END_ID = 2
#: The vocabulary of byte_bpe_50k.json, as ranks.
RANKS = "byte_bpe_50k.tiktoken"
#: The one added token of that file, which is one id wherever it stands in a text.
ADDED = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def encoder(ranks: str):
    """text -> bytes of its ids, little-endian unsigned 32-bit. The ranks are the tokenizer file's own vocabulary and
    merge order, so the ids are the same; this reader of them is several times as fast. Kept by worker, not by task."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=ADDED)

    def encode(text: str) -> bytes:
        return array("I", plain.encode(text, allowed_special=set(ADDED), disallowed_special=())).tobytes()

    return encode


def vocabulary_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) to (doc_id, piece, start, length, ids_crc32): the ids and END_ID, cut into pieces of `length`,
    of which the first takes the remainder. Null text: END_ID alone. vocabulary: a path that holds on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary or vocabulary_path())
        end = END_ID.to_bytes(4, "little")
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                start, stop, k = 0, (n - 1) % length + 1, 0
                while start < n:
                    rows.append((doc_id, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start, stop, k = stop, stop + length, k + 1
            cols = list(zip(*rows, strict=True)) or [()] * 5
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Best-fit decreasing: the bin of each item and its offset there. Ties go to the first item and the first bin."""
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free room
    rooms: list[int] = []  # rooms that have bins, ascending
    fill: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = open_[room].pop()
            if not open_[room]:
                rooms.pop(at)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if left := room - n:
            if not open_[left]:
                bisect.insort(rooms, left)
            open_[left].append(b)
    return bins, offsets


def _round(items: DataFrame, capacity: int) -> DataFrame:
    """(item, length, grp) packed within each grp: item, bin (the smallest item in it), at (offset there), fill, and
    whether the bin goes up."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("item", kind="stable").reset_index(drop=True)
        bins, at = best_fit(f["length"].tolist(), capacity)
        f["at"], f["b"] = at, bins
        by = f.groupby("b")
        f["bin"], f["fill"] = by["item"].transform("min"), by["length"].transform("sum")
        open_ = f.loc[f["fill"] < capacity - NEARLY, ["bin", "fill"]].drop_duplicates().sort_values(["fill", "bin"])
        f["up"] = f["bin"].isin(set(open_["bin"].head(CLIMB)))
        return f[["grp", "item", "bin", "at", "fill", "up"]]

    schema = "grp bigint, item bigint, bin bigint, at bigint, fill bigint, up boolean"
    return items.groupBy("grp").applyInPandas(run, schema)


def pack(lengths: DataFrame, capacity: int = LENGTH, group: int = GROUP, fan_in: int = FAN_IN) -> DataFrame:
    """(item, length), items distinct and 0 < length <= capacity, to (item, sequence_id, offset): gapless sequences
    of at most `capacity`, as few as the rounds of best-fit find. An empty table gives no rows."""
    n = lengths.where(F.col("length") < capacity).count()
    groups = max(1, -(-n // group))
    full = lengths.where(F.col("length") >= capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    now = cut(_round(lengths.where(F.col("length") < capacity).withColumn("grp", F.pmod(F.xxhash64("item"), F.lit(groups))), capacity))
    placed = now.select("item", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    while groups > 1:
        groups = -(-groups // fan_in)
        up = now.where("up").groupBy("bin").agg(F.max("fill").alias("length"), F.max("grp").alias("was"))
        up = up.select(F.col("bin").alias("item"), "length", F.floor(F.col("was") / fan_in).cast("bigint").alias("grp"))
        now = cut(_round(up, capacity))
        moved = now.select(F.col("item").alias("sequence_id"), F.col("bin").alias("to"), "at")
        placed = (
            placed.join(moved, "sequence_id", "left")
            .select("item", F.coalesce("to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("at", F.lit(0))).alias("offset"))
        )
    return full.unionByName(placed)


def pack_documents(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every row of docs.

    Null and empty texts are the one id END_ID; rows that repeat are packed as documents of their own; null ids are
    kept; ties go to the item that was read first; long texts are cut into pieces, none is dropped; further columns are
    ignored; an empty table gives no rows.
    """
    cuts = cut(pieces(docs, length, vocabulary).withColumn("item", F.monotonically_increasing_id()))
    return cuts.join(pack(cuts.select("item", "length"), length), "item").drop("item")
