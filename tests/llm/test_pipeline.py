import random
from collections import Counter

import corpus_pipeline
from sillage.llm import mixing
from tests.llm.test_lines import brute as plain_lines
from tests.llm.test_shingles import brute as plain_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    r = random.Random(8)
    words = {x: ["".join(r.choice(a) for _ in range(r.randrange(2, 9))) for _ in range(200)] for x, a in (("en", "abcdefgh"), ("fr", "éèçùilmn"))}
    line = lambda x, n: " ".join(r.choice(words[x]) for _ in range(n))
    common = line("en", 70)
    rows = []
    for d in range(40):
        x = r.choice(["en", "fr"])
        text = "\n".join(line(x, r.choice([4, 20, 80])) for _ in range(r.randrange(1, 5))) + (f"\n{common}" if d % 4 == 0 else "")
        rows.append((d, text, x, f"s{d % 3}", len(text)))
    near = rows[1][1].split(" ")
    near[2] = "other"
    rows += [(50, rows[0][1], "en", "s1", 1), (51, " ".join(near), "en", None, 2), (52, "123 456", None, "s0", 7), (53, None, None, "s0", 0), (54, "", "en", "s0", 0)]
    return rows


def test_stage_by_stage(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        seen.append([r.asDict() for r in docs.collect()])
        assert k == 4 or docs.columns == corpus_pipeline.COLUMNS
    known, dedup, unique, mixed, packed = seen
    assert {r["doc_id"] for r in known} == {d for d, t, *_ in rows if t and any(map(str.isalpha, t))}

    want = {d: t for d, t in plain_lines([(r["doc_id"], r["text"]) for r in known]).items() if t.strip()}
    assert {r["doc_id"]: r["text"] for r in dedup} == want and 50 not in want
    assert all(r["n_chars"] == len(r["text"]) for r in dedup)

    sets = plain_sets([(r["doc_id"], r["text"]) for r in dedup])
    assert {r["doc_id"] for r in unique} == {d for d, (_, c) in sets.items() if d == c}

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.read.parquet(f"{tmp_path}/2.parquet")).collect()}
    assert Counter(r["doc_id"] for r in mixed) == Counter({d: n for d, n in copies.items() if n})

    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(r["doc_id"] for r in mixed)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def test_near_duplicates_are_dropped_without_a_shuffle_of_texts(spark):
    rows = [(k, " ".join(f"word{k % 5}x{i}" for i in range(40)), "en", "web", 1) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        assert sorted(r["doc_id"] for r in out.collect()) == [0, 1, 2, 3, 4]
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
