import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sillage.llm import repair
from sillage.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows):
    """rows: (role, text, fault). Uniform-cost search by (cost, letters) over the initials themselves: plain, slow."""
    legal = re.compile("(s?(ua)*u?)?")
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, initials, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, letters, out
        if (i, initials[-2:], letters) in done:
            continue
        done.add((i, initials[-2:], letters))
        nexts = [(3, "I", i, r[0], (f"{r}:",)) for r in ("user", "assistant")] if letters[-2:] != "II" else []
        if i < len(rows):
            role, text, fault = rows[i]
            nexts.append((4, "D", i + 1, "", ()))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1] in ("s", "u", "a"):
                    nexts.append((more, "K", i + 1, role[0], (f"{role}:{text}",)))
                nexts += [(3 + more, "R", i + 1, r[0], (f"{r}:{text}",)) for r in ("user", "assistant")]
        for c, letter, j, initial, line in nexts:
            if legal.fullmatch(initials + initial):
                heapq.heappush(heap, (cost + c, letters + letter, j, initials + initial, out + line))


def plain(rows):
    """(role, text) after damage, in order, with turns: what the query returns but for conv_id."""
    seen, faults = set(), []
    for turn, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, letters, out = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults)])
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest())


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        mine += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def found(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS[1:]) for r in df.collect()}


def test_edits_against_search():
    r = random.Random(5)
    roles = ["system", "user", "assistant", "tool", "", "superuser"]
    for _ in range(400):
        rows = [(r.choice(roles), "x.", r.choice(["", "", "", "blank", "truncated"])) for _ in range(r.randrange(7))]
        codes = bytes(
            (repair._INITIALS.index(x[0][0]) if x[0] and x[0][0] in "sua" else 0) | {"": 0, "blank": 4, "truncated": 8}[x[2]] for x in rows
        )
        assert repair.edits(codes) == cheapest(rows)[:2], rows


def test_long_conversation():
    codes = bytes([1] + [2, 3] * 50_000 + [2, 2, 3, 12, 3, 0])
    cost, audit = repair.edits(codes)
    assert len(audit) >= len(codes) and audit.startswith("KKKK") and cost > 0


def test_query_against_search(spark, tmp_path):
    r = random.Random(7)
    texts = ["Yes.", "No?", "ok", " ", "", None, "a b!", "Yes. ", "long " * 30 + "one", "long " * 30 + "two."]
    rows = []
    for conv in [None, *range(120)]:
        for turn in range(r.randrange(6)):
            rows.append((conv, r.choice([turn, turn, turn, turn + 3]), r.choice(["user", "assistant", "system", "tool", None, ""]), r.choice(texts)))
    rows += [(500, None, "user", "Hi."), (500, None, "assistant", "Hi."), (501, 10**12, "user", "far."), (501, -5, "user", "near.")]
    spark.createDataFrame(rows, SCHEMA).withColumn("phase", F.lit("clash")).write.parquet(f"{tmp_path}/conversations.parquet")
    out = QUERIES["op13_conversation_repair"](spark, str(tmp_path))
    assert sorted(out.columns) == sorted(COLUMNS)
    assert found(out) == {c: plain(x) for c, x in damaged(rows).items()}


def test_given_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op13_conversation_repair"](spark, sf_dir)) == {c: plain(x) for c, x in damaged(rows).items()}


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair_digests(none).count() == 0 and repair.repair_turns(none).count() == 0
    ids = spark.createDataFrame([(3,), (3,), (None,)], "conv_id bigint")
    assert found(repair.repair_digests(none, ids)) == {k: (0, 0, 0, 0, 0, 0, "", EMPTY) for k in (3, None)}


def test_turns_and_one_hot_conversation(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "tool", "x")] + [(2, t, "user", "same text.") for t in range(3000)]
    out = repair.repair_turns(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "position").collect()
    one = [tuple(r)[2:] for r in out if r["conv_id"] == 1]
    assert one == [("K", "", "user", "Hi."), ("D", "duplicate", None, None), ("R", "truncated", "assistant", "x")]
    two = [r for r in out if r["conv_id"] == 2]
    assert sum(r["fault"] == "duplicate" for r in two) == 2999 and [r["edit"] for r in two].count("D") >= 2999


@pytest.mark.parametrize(
    "codes, cost, audit", [(b"", 0, ""), (bytes([2, 3]), 0, "KK"), (bytes([1]), 4, "D"), (bytes([2]), 3, "KI"), (bytes([3]), 3, "IK"), (bytes([4]), 4, "D")]
)
def test_small(codes, cost, audit):
    assert repair.edits(codes) == (cost, audit)
