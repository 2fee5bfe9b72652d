"""Phrase collocations from suffix automata of words.

A shard, some of a task's texts, is a set of runs of word numbers. The states of its generalised suffix automaton are
the classes of word strings that end at the same places; its suffix links form the trie of the reversed runs, bounded
here in depth. Sorting the end places by the words that lead up to them gives that trie level by level, each node with
the number of its end places, so numpy builds the automaton of a shard at once. Counts of all shards are then summed.

Three passes over the texts count words, pairs, and longer phrases. A phrase cannot be frequent unless all parts of it
are, so after each pass the frequent phrases set bits of a table of fixed size, and the next pass cuts its runs where a
part has no bit. Different phrases may share a bit, which costs work and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sillage.llm.common import cut, scratch

#: Words of a phrase at most; occurrences that a candidate needs; phrases of a language in the report; share of a
#: phrase's occurrences, in percent, that a longer one needs to replace it.
DEPTH, LEAST, TOP, SUBSUMED = 4, 30, 2000, 80
#: Words of a shard; bits of the table that is sent to all tasks (8 MB); parts that a language's ranking is dealt to.
SHARD, BITS, PARTS = 400_000, 1 << 26, 64
UNKNOWN = "und"
#: What ends a piece; what parts words.
_BREAKS, _BLANKS = "[.,;:!?\n-\r]+", "[ \t]+"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _word_hashes(langs: pa.Array, words: pa.Array) -> np.ndarray:
    both = pc.binary_join_element_wise(langs, words, "\n").to_numpy(zero_copy_only=False)
    return pd.util.hash_array(both, categorize=False)


def _place(parts: np.ndarray, size: int) -> np.ndarray:
    """The bit of phrases, of `size`, from the hashes of their words, one column a word."""
    h = np.zeros(len(parts), np.uint64)
    for i in range(parts.shape[1]):
        h = _mixed(h * _MIX + parts[:, i])
    return h % np.uint64(size)


def _has(bits: np.ndarray, parts: np.ndarray) -> np.ndarray:
    place = _place(parts, 64 * len(bits))
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


class Shard:
    """Texts as one flat array of word numbers. A number stands for a word of a language; -1 ends a run."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        texts = pc.replace_substring_regex(pc.ascii_lower(texts), _BREAKS, " \n ")
        split = pc.split_pattern_regex(texts, _BLANKS)
        coded = pc.dictionary_encode(split.flatten())
        names, word = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        ends = split.offsets.to_numpy()[1:] - split.offsets.to_numpy()[0]
        of = np.repeat(np.arange(len(texts)), np.diff(np.r_[0, ends]))
        breaks = pc.index_in(pa.array(["", "\n"]), names).fill_null(-1).to_pylist()
        empty = word == breaks[0]
        word, of = word[~empty], of[~empty]
        lang = pc.dictionary_encode(langs)
        key = lang.indices.to_numpy().astype(np.int64)[of] * len(names) + word
        number, keys = pd.factorize(key)
        self.words = names.take(pa.array(keys % max(1, len(names))))
        self.langs = lang.dictionary.take(pa.array(keys // max(1, len(names))))
        number[word == breaks[1]] = -1
        last = np.flatnonzero(np.diff(of)) + 1  # a text ends a run too
        self.numbers = np.insert(number.astype(np.int32), last, -1)

    def hashes(self) -> np.ndarray:
        return _word_hashes(self.langs, self.words)


def automaton(numbers: np.ndarray, depth: int, joined: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, phrases, counts) for each length up to `depth`: the nodes of the tree of suffix links at that depth, each
    with its words in reading order and the number of its end places. joined: for each place whether it continues the run
    of the place before; by default all places do that are not -1, nor follow one."""
    live = numbers >= 0
    if joined is None:
        joined = np.r_[False, live[1:] & live[:-1]]
    at = np.flatnonzero(live)
    since = np.arange(len(numbers)) - np.maximum.accumulate(np.where(joined, 0, np.arange(len(numbers))))
    size = np.minimum(since[at] + 1, depth)  # words of the run up to here
    back = np.full((len(at), depth + depth % 2), -1, np.int32)
    for d in range(depth):
        here = size > d
        back[here, d] = numbers[at[here] - d]
    keys = [(back[:, d].astype(np.int64) << 32) + back[:, d + 1] for d in range(0, back.shape[1], 2)]  # two words each
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    del keys
    back, size = back[order], size[order]
    for d in range(1, depth + 1):
        nodes = back[size >= d, :d]
        if not len(nodes):
            return
        start = np.flatnonzero(np.r_[True, (nodes[1:] != nodes[:-1]).any(1)])
        yield d, nodes[start, ::-1], np.diff(np.r_[start, len(nodes)])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Batches (lang, text) cut so that a shard's texts hold about 8 SHARD letters, or one text."""
    held, letters = [], 0
    for b in batches:
        start = 0
        sizes = pc.binary_length(b.column(1)).to_numpy()
        for i, n in enumerate(sizes.tolist()):
            letters += n
            if letters >= 8 * SHARD:
                held.append(b.slice(start, i + 1 - start))
                yield _shard(held)
                held, letters, start = [], 0, i + 1
        if start < b.num_rows:
            held.append(b.slice(start))
    if held:
        yield _shard(held)


def _shard(batches: list[pa.RecordBatch]) -> Shard:
    t = pa.Table.from_batches(batches).combine_chunks()
    return Shard(*(c.chunk(0) if c.num_chunks else pa.array([], pa.string()) for c in t.columns))


def _counts(texts: DataFrame, least: int, most: int, frequent=None) -> DataFrame:
    """(lang, words, phrase, f): all phrases of least to most words whose parts of least - 1 words have their bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _shards(batches):
            numbers, joined = s.numbers, None
            if frequent is not None and len(numbers):
                bits, h = frequent.value, s.hashes()
                if least == 2:
                    rare = ~_has(bits, h[:, None])
                    numbers = np.where((numbers >= 0) & ~rare[numbers], numbers, np.int32(-1))
                else:
                    joined = np.r_[False, (numbers[1:] >= 0) & (numbers[:-1] >= 0)]
                    at = np.flatnonzero(joined)
                    joined[at] = _has(bits, np.stack([h[numbers[at - 1]], h[numbers[at]]], 1))
            for d, phrases, n in automaton(numbers, most, joined):
                if d < least:
                    continue
                for i in range(0, len(n), 100_000):
                    part = phrases[i : i + 100_000]
                    named = [s.words.take(pa.array(part[:, j])) for j in range(d)]
                    phrase = pc.binary_join_element_wise(*named, " ") if d > 1 else named[0]
                    cols = [s.langs.take(pa.array(part[:, 0])), pa.array(np.full(len(part), d), pa.int32()), phrase, pa.array(n[i : i + 100_000], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["lang", "words", "phrase", "f"])

    found = texts.mapInArrow(run, "lang string, words int, phrase string, f bigint")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def _bits(phrases: DataFrame, size: int):
    """The table of bits of these phrases, sent to all tasks: `size` bits, however many phrases there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = np.empty(0, np.uint64)
            if b.num_rows:
                split = pc.split_pattern(b.column(1), " ")
                parts = [_word_hashes(b.column(0), pc.list_element(split, j)) for j in range(len(split[0]))]
                places = np.unique(_place(np.stack(parts, 1), size))
            word = (places >> np.uint64(6)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array((np.uint64(1) << (places & np.uint64(63))).view(np.int64))], names=["at", "bits"])

    rows = phrases.select("lang", "phrase").mapInArrow(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return phrases.sparkSession.sparkContext.broadcast(out)


def _first(words: Column, k: int | Column) -> Column:
    return F.array_join(F.slice(words, 1, k), " ")


def _scored(counts: DataFrame) -> DataFrame:
    """Candidates with l, r and score of their lowest cut; ties go to the first cut. Products are decimals."""
    w = F.split("phrase", " ")
    cuts = counts.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    rest = F.array_join(F.slice(w, F.col("k") + 1, F.col("words")), " ")
    cuts = cuts.withColumns({"first": _first(w, F.col("k")), "rest": rest})
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr("CAST(2000000 * CAST(a AS DECIMAL(20, 0)) AS DECIMAL(30, 0)) div CAST(l + r AS DECIMAL(20, 0))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b")
    return cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).groupBy("lang", "words", "phrase", "a").agg(best).select("lang", "words", "phrase", "a", "b.l", "b.r", "b.score")


def _longer(counts: DataFrame) -> DataFrame:
    """(lang, phrase, longest): the highest count of a longer candidate that holds the phrase. Such a candidate holds one
    that is a word longer and at least as frequent, so the links by the first and the last word tell: the suffix link,
    and that of the reversed string."""
    w = F.split("phrase", " ")
    by_suffix = F.array_join(F.slice(w, 2, F.col("words") - 1), " ")
    both = F.explode(F.array(by_suffix, _first(w, F.col("words") - 1)))
    return counts.where("words > 2").select("lang", both.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The first `top` of each language: of each of PARTS parts first, so that no task sees all of one."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    few = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)


@scratch
def top_phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, subsumed: int = SUBSUMED, bits: int = BITS) -> DataFrame:
    """(lang, text) to lang, rank, phrase, a, l, r, n, score: the collocations of each language.

    Null and empty texts have no words; a null lang is UNKNOWN; rows that repeat count each time; ties go by the phrase in
    byte order; a text may be of any length, as may a word; a shard holds one text at least; further columns are ignored; an
    empty table, or one without frequent phrases, gives no rows.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = cut(_counts(texts, 1, 1))
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    enough = F.col("f") >= least
    frequent = _bits(words.where(enough), bits)
    pairs = cut(_counts(texts, 2, 2, frequent).where(enough))
    frequent.unpersist()
    frequent = _bits(pairs, bits)
    longer = cut(_counts(texts, 3, DEPTH, frequent).where(enough))
    counts = words.where(enough).unionByName(pairs).unionByName(longer)
    held = _longer(counts)
    found = _scored(counts).join(held, ["lang", "phrase"], "left")
    found = found.where(F.col("longest").isNull() | (100 * F.col("longest") < subsumed * F.col("a")))
    return _ranked(found, top).join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))
