"""Empty tables, nulls, repeated rows and clashing column names, where the operator's own tests do not have them."""

import corpus_pipeline
import pytest
from sillage.llm import media, mixing, packing
from tests.llm.test_pipeline import SCHEMA

ODD = SCHEMA + ", size long, n int, at string, row string, words string, length int, key string, e string, lang_pred string, score double, copies int, id long"
OTHERS = (9, 8, "at", "row", "words", 7, "key", "e", "xx", 0.5, 3, 6)
ROWS = [(1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27), (2, "un deux trois quatre cinq six", "fr", "b", 29), (3, None, None, None, None),
        (None, "seven eight nine", None, "a", 16), (4, "", "en", None, 0), (5, "lang " * 20_000, "en", "a", 100_000)]


def odd(spark, rows=ROWS):
    return spark.createDataFrame([r + OTHERS for r in rows], ODD)


def plain(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_packing(spark):
    pieces = lambda df: sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packing.pack_documents(df).collect())
    got = pieces(odd(spark))
    assert got == pieces(odd(spark).select("doc_id", "text"))
    assert [d for d, *_ in got].count("1") == 2 and ("3", 0, 0, 1) in [x[:4] for x in got] and ("4", 0, 0, 1) in [x[:4] for x in got]
    assert pieces(odd(spark, [])) == []


def test_media(spark):
    got = plain(media.text_media(odd(spark)))
    assert got == plain(media.text_media(odd(spark).select("doc_id", "text"))) and len(got) == len(ROWS)
    assert plain(media.text_media(odd(spark, []))) == []


def test_mixing(spark):
    out = mixing.digest(odd(spark)).collect()
    assert len(out) == len(ROWS) and sorted(r["size"] for r in out) == [0, 0, 3, 6, 6, 6, 20_000]
    assert all(r["taken"] <= 2 * r["size"] for r in out)
    assert plain(mixing.digest(odd(spark, []))) == []


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, tmp_path, name, stage):
    for rows in (ROWS, []):
        odd(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/d")
        out = stage(spark, spark.read.parquet(f"{tmp_path}/d"), str(tmp_path))
        assert name == "best_fit_packing" or out.columns == corpus_pipeline.COLUMNS
        found = out.collect()
        assert bool(found) == bool(rows)
        if rows and name == "language_id":
            assert {r["doc_id"] for r in found} == {1, 2, None, 5}


def test_texts_of_a_repeated_id_stay(spark):
    rows = [(1, "a b c d e f g", "en", "x", 1), (1, "h i j k l m n", "en", "y", 2), (1, "a b c d e f g", "en", "w", 3), (2, "a b c d e f g", "en", "x", 4), (3, "h i j k l m n", "en", "x", 4)]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a b c d e f g", "en", "w", 3), (1, "h i j k l m n", "en", "y", 2)]
