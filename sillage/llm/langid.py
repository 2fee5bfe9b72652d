"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary, fit by expectation maximisation over all
segmentations of the words of all labelled documents. A text's likelihood under a language is the product over its
words of the sum over all segmentations, which a forward pass computes for all languages and many words at once.
The fit's expectations are taken by tasks, whose sums alone come to the driver. Scoring is map-only: a worker holds a block of texts and the scores of the words it met first.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillage.llm.common import cut, drop_cut

#: Rounds of expectation maximisation; the counts that each piece has beforehand; words whose scores a worker keeps;
#: texts of a block.
ROUNDS, PRIOR, KEPT, BLOCK = 4, 0.1, 250_000, 256
#: Letters, with START, up to which a word is summed in plain probabilities (each at least some 1e-11 a letter), and the
#: least sum that is taken from these.
SHORT, TINY = 25, 1e-280
#: Sums (word, position, language) that a table of the forward pass holds; letters from which on a word is summed by
#: itself, in a window (when scoring) or by parts of so many letters (when fitting); languages that a model may have.
CELLS, LONG, LANGUAGES = 2_000_000, 400, 1_000
VOCABULARY = "piece_bpe_32k.model"
UNKNOWN, START = "und", "▁"
#: Parts of a use that are told apart when tasks' sums meet.
FINE = 1 << 24
#: Log probability of a character that is no piece; log likelihood by letter below which no learned language explains a
#: text: those of a learned language have -1 to -3, those in a script that the vocabulary lacks come near ODD.
ODD, FOREIGN = -14.0, -6.0
_WORD = re.compile(r"[^\W\d_]+").findall
#: What stands between words of ASCII letters.
_APART = {c: " " for c in range(128) if not chr(c).isalpha()}


def words_of(text: str) -> list[str]:
    """Runs of letters, lower case."""
    text = text.lower()
    if text.isascii():
        return text.translate(_APART).split()
    return [w for w in _WORD(text) if w.isalpha() or any(map(str.isalpha, w))]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces(dict):
    """Each piece's number, -1 for strings that only begin pieces."""

    @cached_property
    def trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Steps (string << 21 | next character) in order, the string that each leads to, and its number."""
        place = {"": 0} | {p: k for k, p in enumerate(self, 1)}
        steps = np.array([place[p[:-1]] << 21 | ord(p[-1]) for p in self], np.int64)
        order = np.argsort(steps)
        return steps[order], order + 1, np.fromiter(self.values(), np.int64, len(self))[order]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[Pieces, int]:
    """The pieces and their number."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = Pieces()
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and any(map(str.isalpha, p)) or p == START:
            pieces.setdefault(p, len(pieces))
    n = len(pieces)
    for p in list(pieces):
        for k in range(1, len(p)):
            pieces.setdefault(p[:k], -1)
    return pieces, n


def lattice(words: list[str], pieces: Pieces, n: int, begins: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All edges (word, start, end, piece) of the words by start, then end, START before each (or those that begin one), and
    the words' lengths. Characters that are no piece are edges of the piece n. All words take a step of the trie at once."""
    words = [START + w if begins is None or begins[k] else w for k, w in enumerate(words)]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    width = int(sizes.max()) if len(sizes) else 0
    chars = np.array(words, f"<U{max(1, width)}").view(np.uint32).reshape(len(words), max(1, width)).T.astype(np.int64)
    steps, leads, numbers = pieces.trie
    found = [[np.zeros(0, np.int64)] for _ in range(4)]
    for i in range(width):
        w = np.flatnonzero(sizes > i)
        key = chars[i][w]
        for j in range(i + 1, width + 1):
            at = np.searchsorted(steps, key)
            at[at == len(steps)] = 0
            known = steps[at] == key
            p = np.where(known, numbers[at], -1)
            if j == i + 1:
                of, p = w, np.where(p < 0, n, p)
            else:
                of, p = w[p >= 0], p[p >= 0]
            for out, x in zip(found, (of, np.full(len(of), i), np.full(len(of), j), p)):
                out.append(x)
            known &= sizes[w] > j
            w, at = w[known], at[known]
            if not len(w):
                break
            key = leads[at] << 21 | chars[j][w]
    return (*(np.concatenate(x) for x in found), sizes)


def _passes(s: np.ndarray, e: np.ndarray) -> list[slice]:
    """Edges of one start and end, by start: within one lot no word comes twice, and all that ends where it starts is in
    lots before it."""
    cuts = np.flatnonzero((np.diff(s) != 0) | (np.diff(e) != 0)) + 1
    ends = [0, *cuts.tolist(), len(s)]
    return [slice(a, b) for a, b in zip(ends, ends[1:]) if a < b]


def _short(sizes: np.ndarray) -> bool:
    return bool(len(sizes)) and int(sizes.max()) <= SHORT


def _sums(edges, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """forward() in plain probabilities, which words of SHORT letters do not exhaust; sums by position and word."""
    w, s, e, p, sizes = edges
    alpha = np.zeros((sizes.max() + 1, len(sizes), prob.shape[1]))
    alpha[0] = 1
    for lot in _passes(s, e):
        a, b, c = w[lot], int(s[lot.start]), int(e[lot.start])
        alpha[c][a] += alpha[b].take(a, 0) * prob.take(p[lot], 0)
    return alpha, alpha[sizes, np.arange(len(sizes))]


def likelihoods(edges, logp: np.ndarray) -> np.ndarray:
    """Log likelihoods by word and language, as forward() has them."""
    if _short(edges[4]):
        total = _sums(edges, np.exp(logp))[1]
        if (total > TINY).all():
            return np.log(total)
    return forward(edges, logp)[1]


def forward(edges, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scaled sums by word and position, log likelihoods by word and language). logp: piece by language."""
    w, s, e, p, sizes = edges
    langs = logp.shape[1]
    alpha = np.full((len(sizes), sizes.max() + 1 if len(sizes) else 1, langs), -np.inf)
    alpha[:, 0] = 0
    for lot in _passes(s, e):
        a, b, c = w[lot], int(s[lot.start]), int(e[lot.start])
        alpha[a, c] = np.logaddexp(alpha[a, c], alpha[a, b] + logp[p[lot]])
    return alpha, alpha[np.arange(len(sizes)), sizes]


def expected(edges, logp: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Expected uses of each piece by language (forward and backward), counts: word by language."""
    w, s, e, p, sizes = edges
    if _short(sizes):
        prob = np.exp(logp)
        alpha, total = _sums(edges, prob)
        if (total > TINY).all():
            beta, use = np.zeros_like(alpha), np.empty((len(w), prob.shape[1]))
            beta[sizes, np.arange(len(sizes))] = counts / total
            for lot in reversed(_passes(s, e)):
                a, b, c = w[lot], int(s[lot.start]), int(e[lot.start])
                part = beta[c].take(a, 0) * prob.take(p[lot], 0)
                beta[b][a] += part
                use[lot] = alpha[b].take(a, 0) * part
            return np.stack([np.bincount(p, use[:, k], n + 1) for k in range(logp.shape[1])], axis=1)
    alpha, total = forward(edges, logp)
    beta = np.full_like(alpha, -np.inf)
    beta[np.arange(len(sizes)), sizes] = 0
    for lot in reversed(_passes(s, e)):
        a, b, c = w[lot], int(s[lot.start]), int(e[lot.start])
        beta[a, b] = np.logaddexp(beta[a, b], beta[a, c] + logp[p[lot]])
    use = np.exp(alpha[w, s] + logp[p] + beta[w, e] - total[w]) * counts[w]
    return np.stack([np.bincount(p, use[:, k], n + 1) for k in range(logp.shape[1])], axis=1)


def lots(words: list[str], langs: int) -> Iterator[np.ndarray]:
    """The words' numbers by length, in lots whose tables hold CELLS sums at most (or one word's)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        width = (sizes[order[at:]] + 2) * langs * np.arange(1, len(order) - at + 1)  # sizes ascend: the last word is the widest
        stop = at + max(1, int(np.searchsorted(width, CELLS, "right")))
        yield order[at:stop]
        at = stop


def uses(words: list[str], counts: np.ndarray, logp: np.ndarray, path: str) -> np.ndarray:
    """Expected uses of each piece by language, from words and their counts by language. Words of more than LONG letters are
    summed by parts, so that a table is bounded; all their letters count, and only the first part has START, so a long word
    gives the pieces what a whole one does but for those across its seams."""
    pieces, n = vocabulary(path)
    parts = [(w[k : k + LONG], i, k == 0) for i, w in enumerate(words) for k in range(0, max(1, len(w)), LONG)]
    words, begins, counts = [w for w, _, _ in parts], [b for _, _, b in parts], counts[[i for _, i, _ in parts]]
    out = np.zeros((n + 1, counts.shape[1]))
    for lot in lots(words, counts.shape[1]):
        for k in range(0, len(lot), 5000):
            part = lot[k : k + 5000]
            out += expected(lattice([words[i] for i in part], pieces, n, [begins[i] for i in part]), logp, counts[part], n)
    return out


def maximise(langs: int, path: str, used: Callable[[np.ndarray], np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities, piece by language, by expectation maximisation; used: from these to the expected uses."""
    _, n = vocabulary(path)
    logp = np.full((n + 1, langs), -np.log(n))
    logp[n] = ODD
    for _ in range(rounds):
        use = used(logp) + PRIOR
        logp = np.log(use) - np.log(use.sum(0))
        logp[n] = ODD  # a foreign character tells as little under every language
    return logp


def fit_counts(words: list[str], counts: np.ndarray, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """The same from words and their counts by language that are at hand."""
    return maximise(counts.shape[1], path, lambda logp: uses(words, counts, logp, path), rounds)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, sample: int | None = None, path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages and the model, from documents (doc_id, text, lang) that are not held out, have a language and a
    text: from all of them, or with `sample` from about so many of each language, whole, chosen by a hash of doc_id. More
    than LANGUAGES languages are an error."""
    given, path = path, path or vocabulary_path()
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((1, 0))
    share = F.lit(0)
    for lang in langs if sample else ():
        share = F.when(F.col("lang") == lang, int(min(1.0, sample / sizes[lang]) * (1 << 20))).otherwise(share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, BLOCK):
                by: dict[str, Counter] = {}
                part = b.slice(k, BLOCK)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    by.setdefault(lang, Counter()).update(words_of(text.as_py()))
                for lang, found in by.items():
                    cols = [pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["lang", "word", "n"])

    learnt = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share) if sample else known
    each = learnt.select("lang", "text").mapInArrow(count, "lang string, word string, n bigint").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    table = each.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("lang", "n"))).alias("by"))  # LANGUAGES at most
    table = cut(table.repartition(docs.sparkSession.sparkContext.defaultParallelism, "word").sortWithinPartitions("word"))
    place = {x: k for k, x in enumerate(langs)}

    def used(logp: np.ndarray) -> np.ndarray:
        """The tasks' sums of uses, as whole numbers of 1 / FINE, which add up alike in any order."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(logp.shape, np.int64)
            for b in batches:
                words, by = b.column(0).to_pylist(), b.column(1)
                counts = np.zeros((len(words), len(langs)))
                told = by.flatten()
                at = np.repeat(np.arange(len(words)), np.diff(by.offsets.to_numpy()))
                counts[at, [place[x] for x in told.field("lang").to_pylist()]] = told.field("n").to_numpy()
                if words:
                    out += np.rint(FINE * uses(words, counts, logp, given or vocabulary_path())).astype(np.int64)
            p, k = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(out[p, k])], names=["piece", "lang", "n"])

        found = table.mapInArrow(run, "piece int, lang int, n bigint").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(logp.shape)
        out[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy() / FINE
        return out

    logp = maximise(len(langs), path, used)
    drop_cut(table)
    return langs, logp


class Scorer:
    """Log likelihoods of texts by language; keeps the scores of the first KEPT words it meets."""

    def __init__(self, logp: np.ndarray, path: str) -> None:
        self.logp, (self.pieces, self.n) = logp, vocabulary(path)
        self.place: dict[str, int] = {}
        self.scores = np.zeros((1024, logp.shape[1]))

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: log likelihoods, number of letters, one more for each word."""
        split = [words_of(t) for t in texts]
        place = self.place
        new = list({w for ws in split for w in ws if w not in place})
        base = len(place)
        more = {w: base + k for k, w in enumerate(new)}
        made = np.concatenate([np.zeros((0, self.logp.shape[1])), *(self.words(new[k : k + 20_000]) for k in range(0, len(new), 20_000))])
        if base + len(new) <= KEPT:
            if base + len(new) > len(self.scores):
                self.scores = np.concatenate([self.scores[:base], made, np.zeros((base + len(new), self.logp.shape[1]))])
            self.scores[base : base + len(new)] = made
            place.update(more)
            table, get = self.scores, place.__getitem__
        else:
            table = np.concatenate([self.scores[:base], made])

            def get(w: str) -> int:
                k = place.get(w)
                return more[w] if k is None else k

        out = np.array([table[np.fromiter(map(get, ws), np.int64, len(ws))].sum(0) for ws in split]).reshape(len(texts), self.logp.shape[1])
        return out, np.array([sum(map(len, ws)) + len(ws) for ws in split])

    def words(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), self.logp.shape[1]))
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        for lot in lots([words[k] for k in short], self.logp.shape[1]):  # words of like lengths share a table
            at = [short[k] for k in lot]
            for part in (at[k : k + 2000] for k in range(0, len(at), 2000)):
                out[part] = likelihoods(lattice([words[k] for k in part], self.pieces, self.n), self.logp)
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self.long(w)
        return out

    def long(self, word: str) -> np.ndarray:
        """One word of any length, with a window of sums as wide as the longest piece."""
        pieces, window = self.pieces, [np.zeros(self.logp.shape[1])]
        word = START + word
        most = 64
        for e in range(1, len(word) + 1):
            acc = np.full(self.logp.shape[1], -np.inf)
            for back in range(1, min(e, most) + 1):
                p = pieces.get(word[e - back : e])
                if p is not None and p >= 0 or back == 1:
                    acc = np.logaddexp(acc, window[-back] + self.logp[p if p is not None and p >= 0 else self.n])
            window = [*window[-most:], acc]
        return window[-1]


_SCORERS: dict = {}


def identify(
    docs: DataFrame, langs: list[str], logp: np.ndarray, path: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """(doc_id, text) to doc_id, held_out, lang_pred, score (the language's share of the likelihoods, 0 to 1), fit (the
    log likelihood under it by letter); with keep, to those columns, lang_pred, score and fit.

    Null text, a text without letters, or a model without languages: lang_pred `und`, score and fit 0. Ties go to the first
    language by name. Repeated rows are judged alike; whole texts count, however long; without keep, further columns
    are ignored whatever their names; an empty table gives no rows.
    """
    key = (tuple(langs), hashlib.sha256(logp.tobytes()).hexdigest())
    rows = docs.select(keep) if keep else docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), held_out().alias("held_out"))
    passed = keep or ["doc_id", "held_out"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(passed).schema.fields)
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = path or vocabulary_path()
        scorer = _SCORERS.get((key, where)) or Scorer(logp, where)
        _SCORERS.clear()
        _SCORERS[key, where] = scorer
        for b in batches:
            for k in range(0, b.num_rows, BLOCK):
                part = b.slice(k, BLOCK)
                texts = [t or "" for t in part.column(at).to_pylist()]
                pred, score, fit = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                if langs:
                    found, n = scorer.texts(texts)
                    top = found.max(1, keepdims=True)
                    share = 1 / np.exp(found - top).sum(1)
                    pred = [langs[i] if m else UNKNOWN for i, m in zip(found.argmax(1), n, strict=True)]
                    score = np.where(n > 0, share, 0.0)
                    fit = np.where(n > 0, top[:, 0] / np.maximum(n, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in passed), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(fit, pa.float64())],
                    names=[*passed, "lang_pred", "score", "fit"],
                )

    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, fit double")


def detect(docs: DataFrame, sample: int | None = None, path: str | None = None) -> DataFrame:
    """fit() on docs (doc_id, text, lang), then identify() all of them."""
    langs, logp = fit(docs, sample, path)
    return identify(docs, langs, logp, path)
