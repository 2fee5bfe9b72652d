import zlib
import numpy as np
import zlib
import pytest

from sillage.llm import langid


def segmentations(word, pieces, n):
    if not word:
        return [()]
    out = []
    for k in range(1, len(word) + 1):
        p = pieces.get(word[:k])
        if p is not None and p >= 0:
            out += [(p, *rest) for rest in segmentations(word[k:], pieces, n)]
        elif k == 1:
            out += [(n, *rest) for rest in segmentations(word[1:], pieces, n)]
    return out


def test_forward_sums_all_segmentations():
    path = langid.vocabulary_path()
    pieces, n = langid.vocabulary(path)
    words = ["the", "thing", "über", "éàü", "x", "zqxjv", "日本"]
    logp = np.log(np.random.default_rng(0).dirichlet(np.ones(n + 1), 2).T)
    edges = langid.lattice(words, pieces, n)
    got = langid.forward(edges, logp)[1]
    use = np.zeros((n + 1, 2))
    for i, w in enumerate(words):
        segs = segmentations(langid.START + w, pieces, n)
        for k in range(2):
            each = np.array([logp[list(s), k].sum() for s in segs])
            total = np.logaddexp.reduce(each)
            assert got[i, k] == pytest.approx(total)
            for s, x in zip(segs, each, strict=True):
                np.add.at(use[:, k], list(s), np.exp(x - total))
    assert np.allclose(langid.expected(edges, logp, np.ones((len(words), 2)), n), use)
    assert np.allclose([langid.Scorer(logp, path).long(w) for w in words], got)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = langid.detect(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 20 and sum(r["lang_pred"] == r["lang"] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_edges(spark):
    train = [(i, t, x) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 20)]
    rows = [*train, (100, None, "en"), (101, "", "fr"), (102, "123 ?!", None), (103, "le " * 30_000, None), (104, "a" * 3000, None), (None, "the dog", None)]
    got = {r["doc_id"]: r for r in langid.detect(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all((got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0) for k in (100, 101, 102))
    assert got[103]["lang_pred"] == "fr" and got[None]["lang_pred"] == "en" and got[104]["lang_pred"] in ("en", "fr")


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.detect(df).first()["lang_pred"] == "und"
    assert langid.detect(df.limit(0)).count() == 0


def test_lots_are_bounded():
    words = ["a" * n for n in (1, 3, 400, 2, 5000, 399, 7)] + ["b"] * 1000
    found = list(langid.lots(words, 4))
    assert sorted(k for lot in found for k in lot) == list(range(len(words)))
    assert all(len(lot) == 1 or (max(len(words[k]) for k in lot) + 2) * 4 * len(lot) <= langid.CELLS for lot in found)


def test_fit_with_a_very_long_word():
    import tracemalloc

    tracemalloc.start()
    logp = langid.fit_counts(["la", "maison", "xz" * 500_000], np.array([[3.0, 0], [2, 0], [0, 1]]), langid.vocabulary_path(), rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(np.exp(logp[:-1]).sum(0), 1, atol=0.2) and peak < 1 << 30


def test_long_words_score_as_short_ones_do(monkeypatch):
    r = np.random.default_rng(1)
    pieces, n = langid.vocabulary(langid.vocabulary_path())
    logp = np.log(r.random((n + 1, 2)))
    scorer = langid.Scorer(logp, langid.vocabulary_path())
    words = ["maison" * k for k in (1, 5, 20)]
    want = scorer.words(words)
    monkeypatch.setattr(langid, "LONG", 10)
    assert np.allclose(scorer.words(words), want)


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(k, f"le chat {k} dort sur la table" if k % 2 else f"the cat {k} sleeps on the table", "fr" if k % 2 else "en", "x", 2.0, True) for k in range(40)]
    rows += rows[:2]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double, held_out boolean")
    out = langid.detect(df).collect()
    assert len(out) == 42 and {(r["doc_id"] % 2, r["lang_pred"]) for r in out} == {(0, "en"), (1, "fr")}


def test_long_words_give_the_pieces_what_short_ones_do():
    """A word of several parts has one start piece, as the words that it is made of would not."""
    pieces, n = langid.vocabulary(langid.vocabulary_path())
    word = "harbour" * 200
    one = langid.lattice([word[:400], word[400:800]], pieces, n, [True, False])
    assert one[4].tolist() == [401, 400]
    both = langid.fit_counts([word, "wind"], np.array([[1.0, 0.0], [0.0, 1.0]]), langid.vocabulary_path())
    start = pieces[langid.START]
    assert both.shape == (n + 1, 2) and np.isfinite(both).all() and both[start, 0] < -2


def test_fit_tells_foreign_scripts(spark):
    rows = [(i, "the boats came back at noon and nobody saw the storm", "en") for i in range(40)] + [(1000, "港の船は正午に戻った誰も嵐を見なかった", None), (1002, "boats and storms", None), (1003, None, None)]
    got = {r["doc_id"]: r["fit"] for r in langid.detect(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1000] < langid.FOREIGN and got[1002] > langid.FOREIGN and got[1003] == 0


def test_fit_learns_from_every_document(spark):
    """Far more documents than a sample would take, of which each has a word of its own."""
    docs = [(i, f"gemeinsam wort{chr(97 + i % 26) * (1 + i % 7)}x {'haus' if i % 2 else 'maison'} eigen{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}", "de" if i % 2 else "fr") for i in range(1200)]
    docs += [(5000, None, "de"), (5001, "text", None), (5002, "gemeinsam " * 3 + "x" * 30, "fr")]
    langs, logp = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    by = {}
    for i, text, lang in docs:
        if text and lang and zlib.crc32(str(i).encode()) % 5:
            for w in langid.words_of(text):
                by.setdefault(w, [0, 0])[langs.index(lang)] += 1
    words = sorted(by)
    want = langid.fit_counts(words, np.array([by[w] for w in words], float), langid.vocabulary_path())
    assert np.abs(logp - want).max() < 1e-4


def test_plain_sums_are_the_logarithmic_ones():
    pieces, n = langid.vocabulary(langid.vocabulary_path())
    r = np.random.default_rng(5)
    logp = np.log(r.dirichlet(np.full(n + 1, 0.02), 3).T + 1e-11)
    words = ["a", "maison", "äöü", "жук", "internationalisation", "zq" * 12]
    counts = r.random((len(words), 3)) * 1e6
    edges = langid.lattice(words, pieces, n)
    short, few = langid.expected(edges, logp, counts, n), langid.likelihoods(edges, logp)
    was, langid.SHORT = langid.SHORT, 0
    try:
        whole = langid.expected(edges, logp, counts, n)
        assert np.allclose(short, whole, rtol=1e-9) and np.allclose(few, langid.likelihoods(edges, logp), rtol=1e-12)
    finally:
        langid.SHORT = was


def test_lattice_takes_the_steps_of_all_words_at_once():
    """No piece is looked up by itself, and the edges are those of a plain search, by start, then end."""
    pieces, n = langid.vocabulary(langid.vocabulary_path())
    words, begins = ["maison", "a", "äöü", "жук", "日本語", "internationalisation", "zq" * 300], [True, False, True, True, True, False, True]
    want = []
    for k, word in enumerate(words):
        word = langid.START * begins[k] + word
        for i in range(len(word)):
            for j in range(i + 1, len(word) + 1):
                p = pieces.get(word[i:j])
                if p is None or p < 0:
                    want += [(i, j, k, n)] if j == i + 1 else []
                else:
                    want.append((i, j, k, p))

    class Whole(langid.Pieces):
        def get(self, *_):
            raise AssertionError("one by one")

    w, s, e, p, sizes = langid.lattice(words, Whole(pieces), n, begins)
    assert list(zip(*(x.tolist() for x in (s, e, w, p)))) == sorted(want)
    assert sizes.tolist() == [len(x) + b for x, b in zip(words, begins)]
    assert [len(x) for x in langid.lattice([], pieces, n)] == [0] * 5


def test_words_of_plain_and_other_texts():
    assert langid.words_of("Don't a_b c9d\x00E\u212a") == ["don", "t", "a", "b", "c", "d", "ek"]
    assert langid.words_of("\u00c9t\u00e9 a_b c9d \u00b2 x\u00b2") == ["\u00e9t\u00e9", "a", "b", "c", "d", "x\u00b2"]
