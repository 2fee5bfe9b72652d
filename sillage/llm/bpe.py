"""BPE encoding and decoding in batched merge rounds.

A tokenizer file gives the vocabulary, the merges and the added tokens. Texts are cut at the added tokens, normalised
and split into words; the distinct words of a batch become one flat array of symbols. In each round the neighbouring
symbols of all words are looked up at once by binary search over the sorted keys of the pairs, and each word merges its
pair of lowest rank, everywhere it occurs, from the left. Words without a pair leave the array. Since a merge of the
file comes after those that make its parts, that is the order in which one merge after the other would be made.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The tokenizer file that the query uses; the form of word that it splits a normalised text into.
FILE = "word_bpe_49k.json"
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Symbols of a word from which on a heap finds its lowest pair, as rounds over a long word would each read all of it.
LONG = 512
#: Words that a worker remembers; characters of texts that are encoded together.
KEPT, CHUNK = 400_000, 4_000_000
_NONE = np.iinfo(np.int64).max


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else one from U+0100 on, in order."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class Bpe:
    """Encoder and decoder of a tokenizer file with word ends (`end_of_word_suffix`)."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.added.values()])
        self.tokens = [""] * self.size
        for token, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = token
        letters = _byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.final = np.array([vocab.get(c + suffix, -1) for c in letters], np.int64)
        made_at = {a + b: rank for rank, (a, b) in enumerate(model["merges"])}
        if any(made_at.get(part, -1) > rank for rank, pair in enumerate(model["merges"]) for part in pair):
            raise ValueError(f"{path}: a merge comes before one that makes a part of it")
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        keys = np.array([a * self.size + b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([c for _, _, c in pairs], np.int64)  # by rank
        found = sorted(self.added, key=len, reverse=True)
        self._added = regex.compile("(" + "|".join(map(regex.escape, found)) + ")") if found else None
        self._names = pa.array(self.tokens, pa.string())
        self._forget()

    def words(self, text: str) -> list[str]:
        """The words of a text, normalised; an added token is one by itself, wherever it stands."""
        if self._added is None or not self._added.search(text):
            return self._split(text)
        out: list[str] = []
        for i, part in enumerate(self._added.split(text)):
            out += [part] if i % 2 else self._split(part)
        return out

    def _split(self, text: str) -> list[str]:
        if text.isascii() or not any(unicodedata.category(c) == "Cn" for c in set(text)):
            return WORD.findall(_normal(text))
        normal = self._library().normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self._library().pre_tokenizer.pre_tokenize_str(normal)]

    @lru_cache(maxsize=1)  # noqa: B019  # a worker holds few encoders
    def _library(self):
        """The file as the tokenizers library reads it: letters newer than this Python's tables are split as it does."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _rank(self, key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, given as their bytes, one after the other, and how many each has."""
        lengths = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols, of = self.inner[raw], np.repeat(np.arange(len(words)), lengths)
        last = np.cumsum(lengths)[lengths > 0] - 1
        symbols[last] = self.final[raw[last]]
        here = symbols >= 0  # a byte that the vocabulary lacks is left out
        symbols, of = symbols[here], of[here]
        done = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for i in np.flatnonzero(lengths >= LONG):
            ids = self._merge_long(symbols[of == i])
            done.append((np.full(len(ids), i), ids))
        rest = lengths[of] < LONG
        symbols, of = symbols[rest], of[rest]
        rank = self._pair_ranks_at(symbols, of, np.arange(len(symbols)))
        while len(symbols):
            start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.r_[start, len(symbols)]))
            live = best != _NONE
            done.append((of[~live], symbols[~live]))
            symbols, of, rank, best = symbols[live], of[live], rank[live], best[live]
            at = np.flatnonzero(rank == best)
            # a symbol that repeats matches with both neighbours: every second match of a run counts, from the left
            first = np.r_[True, np.diff(at) > 1] if len(at) else np.empty(0, bool)
            run = at[first][np.cumsum(first) - 1] if len(at) else at
            at = at[(at - run) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, of, rank = symbols[stay], of[stay], rank[stay]
            new = at - np.arange(len(at))  # each merge before this one took a place
            new = np.r_[new, np.maximum(new - 1, 0)]
            rank[new] = self._pair_ranks_at(symbols, of, new)
        of, ids = map(np.concatenate, zip(*done))
        return ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))

    def _pair_ranks_at(self, symbols: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the pair that starts at each of these places; none at the end of a word."""
        out = np.full(len(at), _NONE)
        inside = np.flatnonzero(at + 1 < len(symbols))
        inside = inside[of[at[inside]] == of[at[inside] + 1]]
        out[inside] = self._rank(symbols[at[inside]] * self.size + symbols[at[inside] + 1])
        return out

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The same for one word of any length: a heap of (rank, place), stale entries skipped."""
        now, n = symbols.tolist(), len(symbols)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self._rank(symbols[:-1] * self.size + symbols[1:])
        heap = [(int(ranks[i]), int(i)) for i in np.flatnonzero(ranks != _NONE)]
        heapq.heapify(heap)
        pair_rank = self._pair_ranks()
        while heap:
            rank, i = heapq.heappop(heap)
            j = nxt[i]
            if now[i] < 0 or j >= n or pair_rank.get(now[i] * self.size + now[j]) != rank:
                continue
            now[i], now[j] = int(self.made[rank]), -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for a, b in ((prev[i], i), (i, nxt[i])):
                if a >= 0 and b < n and (found := pair_rank.get(now[a] * self.size + now[b])) is not None:
                    heapq.heappush(heap, (found, a))
        return np.array([s for s in now if s >= 0], np.int64)

    @lru_cache(maxsize=1)  # noqa: B019  # a worker holds few encoders
    def _pair_ranks(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.ranks.tolist()))

    def _forget(self) -> None:
        """Of the words known so far, only the added tokens stay known."""
        self._index = {token: n for n, token in enumerate(self.added)}
        self._ids, self._count = np.array([*self.added.values()], np.int64), np.ones(len(self.added), np.int64)
        self._text = pa.array([*self.added], pa.string())

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not known yet, all at once. A worker's memory of words is bounded by KEPT and by
        the words of one chunk of texts."""
        new = [w for w in words if w not in self._index]
        if len(self._index) + len(new) > KEPT:
            self._forget()
            new = [w for w in words if w not in self._index]
        if not new:
            return
        ids, count = self.merge([w.encode("utf-8", "surrogatepass") for w in new])
        tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), self._names.take(pa.array(ids)))
        self._index.update(zip(new, range(len(self._index), len(self._index) + len(new))))
        self._ids, self._count = np.r_[self._ids, ids], np.r_[self._count, count]
        self._text = pa.concat_arrays([self._text, pc.binary_join(tokens, " ")])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        return [np.frombuffer(ids, "<u4") for ids, _ in self.both(texts)]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens of ids joined by spaces, as a file without a decoder has it; ids out of range are left out."""
        return " ".join([self.tokens[i] for i in ids if 0 <= i < self.size])

    def both(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """The ids of each text as bytes, little-endian unsigned 32-bit, and the text that they decode to."""
        split = [self.words(t) for t in texts]
        self.learn(set().union(*split))
        known = self._index
        at = np.array([known[w] for ws in split for w in ws], np.int64)
        text = np.repeat(np.arange(len(texts)), [len(ws) for ws in split])
        some = self._count[at] > 0
        at, text = at[some], text[some]
        n, start = self._count[at], np.r_[0, np.cumsum(self._count)][at]
        ids = self._ids[np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if len(at) else at
        flat = ids.astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(text, n, len(texts))).astype(np.int64)
        words = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(text, minlength=len(texts)))], pa.int32()), self._text.take(pa.array(at)))
        return [(flat[a:b], d) for a, b, d in zip(np.r_[0, ends].tolist(), ends.tolist(), pc.binary_join(words, " ").to_pylist())]


def _normal(text: str) -> str:
    """NFC, lower case letter by letter: a final sigma is no case of its own. White space is dropped by WORD."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def file_path(name: str = FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, column: str = "text", path: str | None = None) -> DataFrame:
    """docs with `ids` (array of ids of the whole text) and `decoded` (what they decode to) in place of columns of
    these names. Null counts as the empty text; rows, repeated ones too, stay as they are; an empty table gives no rows."""
    rest = [c for c in docs.columns if c not in ("ids", "decoded")]
    schema = docs.select(*rest).schema.add("ids", T.ArrayType(T.LongType())).add("decoded", T.StringType())
    at = rest.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path or file_path())
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            for i, j in _chunks(texts):
                done = bpe.both(texts[i:j])
                ids = pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x, _ in done], pa.list_(pa.int64()))
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array([d for _, d in done], pa.string())], names=[*rest, "ids", "decoded"])

    return docs.select(*rest).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids, little-endian unsigned 32-bit), decoded_sha256 (of the decoded text,
    UTF-8): one row per row of docs, computed from whole texts.

    Null and empty texts, and texts of white space only, have no ids; null and repeated doc_ids are kept; there are no
    ties; very long texts and words cost in proportion to their length, but for a logarithm; further columns are
    ignored; an empty table gives no rows. path: a tokenizer file at a path that holds on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path or file_path())
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in _chunks(texts):
                rows = [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for x, d in bpe.both(texts[i:j])]
                n, a, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(a), pa.array(c)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)
