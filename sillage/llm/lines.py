"""Line dedup: near-equal lines over all documents, one occurrence of each group kept.

Lines are normalised and equal ones counted once. A line's SimHash is the majority of its longer words' hashes, bit by bit,
summed by a generated-code aggregation with eight counters to a long. Lines whose SimHashes differ in at most CLOSE
bits agree on a block or a combination of blocks of them (pigeonhole). An edited word flips more bits than that, so
lines also meet where they share one of the word n-grams that they pick, the least under each of some masks, and their
SimHashes differ in at most DISTANCE bits. All such pairs are verified by the edit similarity of their words, first of
one symbol for each word, then of the words themselves, and the first occurrence in each connected group stays.
DataFrame operations only.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sillage.llm.common import cut, few, scratch
from sillage.llm.dedup_links import Near, linked

#: Bits in which the SimHashes of linked lines may differ; least edit similarity of
#: their words, 1 - distance / longer length, in %.
DISTANCE, SIMILARITY = 24, 80
#: Bits up to which lines meet by blocks of their SimHashes; the others meet by the n-grams that they pick.
CLOSE = 3
#: Masks by which the hashes of n-grams are ordered; each picks one, so near lines pick a common one. Their last eight
#: bits are 0, as those of an n-gram's hash hold its weight.
MASKS = tuple((k * 0x9E3779B97F4A7C15 & (1 << 64) - 256) - (1 << 63) for k in range(1, 13))
#: Letters of an n-gram of two or three words from which on, and steps of letters by which, its hash is halved under every
#: mask, STEPS times at most: n-grams of long words, which fewer lines share by chance, are picked before others.
LETTERS_OF, STEPS = {2: (6, 2), 3: (9, 3)}, 4
#: Words from which on a line can differ from another and reach SIMILARITY; below which it has pairs of words as
#: n-grams, up to which pairs as well, as the shorter of two near lines may have fewer words: else threes.
LEAST, PAIRS, BOTH = 5, 20, 24
#: Letters from which on a word counts in the SimHash of a line that has such words: the short, frequent ones would
#: give unrelated lines like hashes.
LETTERS = 4
#: Longs of 64 positions each, on which lines are told apart by their longer words before their texts are fetched.
ODD = ("odd0", "odd1", "odd2", "odd3")
#: Longs of 64 positions each, on which lines are told apart by all their words where large buckets are left with several
#: components.
BAG = tuple(f"bag{i}" for i in range(8))
#: Blocks that a SimHash is cut into and blocks that must agree, by the number of distinct lines up to which so many
#: bits keep buckets small. Every choice finds the same pairs.
BLOCKS = ((1 << 22, 4, 1), (1 << 29, 5, 2), (1 << 62, 6, 3))


#: Rows up to which a table of keys, ids or line addresses is broadcast, some 30 bytes each.
FEW = 500_000
#: Members from which on a bucket, usually of some dozens, is a family of near copies; up to which all pairs of a bucket of
#: an n-gram are compared.
HOT, ALL = 256, 64
#: Lines that go up to which their numbers are broadcast: 4 bytes each, and some 40 for each row that has any.
MARKED = 1_000_000


def cleaned(rows: DataFrame) -> DataFrame:
    """rows with text replaced by clean: lower case, white space within lines as single blanks. In two projections, so
    that the lower case is made once."""
    rest = [c for c in rows.columns if c != "text"]
    low = rows.select(*rest, F.lower("text").alias("low"))
    odd = F.contains("low", F.lit("  "))
    for c in "\t\x0b\f\r":
        odd = odd | F.contains("low", F.lit(c))
    return low.select(*rest, F.when(odd, F.regexp_replace("low", r"[\t\x0B\f\r ]+", " ")).otherwise(F.col("low")).alias("clean"))


#: Words of a chunk: as many as seven bits can count, so that sums stay positive.
CHUNK = 127


def _packed(h: Column) -> list[Column]:
    """Sums of the bits of h, eight to a long: byte j of sum i counts bit 8 j + i, up to CHUNK words."""
    lanes = F.lit(0x0101010101010101)
    return [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(lanes)).alias(f"s{i}") for i in range(8)]


def _majority(n: Column) -> Column:
    """The bits that more than half of n words have, from packed sums of several chunks."""
    out = F.lit(0).cast("bigint")
    for bit in range(64):
        count = F.sum(F.shiftrightunsigned(F.col(f"s{bit % 8}"), 8 * (bit // 8)).bitwiseAND(255))
        out = out.bitwiseOR(F.when(2 * count > n, F.lit(1 << bit if bit < 63 else -(1 << 63))).otherwise(F.lit(0)))
    return out


def _chunk_majority(n: Column) -> Column:
    """The same for one chunk, all bytes of a counter at once: with 127 - n / 2 added, a byte reaches 128 where more
    than half of the n words have the bit. The highest byte is added by itself, as sums must not overflow."""
    more = 127 - F.shiftright(n, 1)
    out = F.lit(0).cast("bigint")
    for i in range(8):
        low = (F.col(f"s{i}").bitwiseAND(0x00FFFFFFFFFFFFFF) + more * 0x0001010101010101).bitwiseAND(0x0080808080808080)
        high = F.when(F.shiftrightunsigned(F.col(f"s{i}"), 56) + more >= 128, F.lit(-(1 << 63))).otherwise(F.lit(0))
        out = out.bitwiseOR(F.shiftrightunsigned(low.bitwiseOR(high), 7 - i))
    return out


def _gram(weight: str, *words: str | Column) -> Column:
    """The hash of an n-gram, with its weight at the bits that come last once it is shifted by that."""
    return F.expr(f"shiftleft({weight}, {weight})").cast("bigint").bitwiseOR(F.xxhash64(*words).bitwiseAND(F.lit(-256)))


def _weight(n: int, letters: Column) -> Column:
    """1 to STEPS + 1, by the letters of an n-gram of n words."""
    least, step = LETTERS_OF[n]
    return F.least(F.greatest(F.floor((letters - least) / step).cast("int"), F.lit(0)), F.lit(STEPS)) + 1


def _order(gram: str, mask: int) -> Column:
    """By what a mask orders n-grams."""
    return F.call_function("shiftrightunsigned", F.col(gram).bitwiseXOR(F.lit(mask)), F.col(f"{gram}_weight"))


def _picks() -> Column:
    """The hashes of the n-grams that each of MASKS puts first."""
    weight = lambda p: F.col(p).bitwiseAND(F.lit(7)).cast("int")
    own = F.array_distinct(F.array(*[F.call_function("shiftleft", F.col(f"p{i}"), weight(f"p{i}")).bitwiseXOR(F.lit(m)) for i, m in enumerate(MASKS)]))
    return F.when(F.col("p0").isNotNull(), own).alias("picks")


def simhashes(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text) to (row, doc_id, line, h, sim, words, odd0 to odd3, picks) of the lines that are not blank: hash,
    SimHash, number of words, on which of 256 positions an odd number of the longer words falls (ODD; an edit changes two
    at most), and the n-grams that it picks of each, as often as rows repeat; picks are null for lines of fewer than LEAST words.
    The words of a line meet, by chunks, in the task that reads them; packed sums are shuffled, no text."""
    # copy: rows that repeat a doc_id and text must not meet in a counter
    apart = docs.select("row", "doc_id", "text", F.monotonically_increasing_id().alias("copy"))
    # outer: else the optimizer adds filters that make the arrays once more
    lines = F.posexplode_outer(F.transform(F.split("clean", "\n"), lambda x: F.trim(x))).alias("line", "norm")
    each = cleaned(apart).select("row", "copy", "doc_id", lines).where("norm <> ''")
    short = ~F.col("norm").rlike(f"[^ ]{{{LETTERS}}}")
    split = each.select("row", "copy", "doc_id", "line", F.xxhash64("norm").alias("h"), short.alias("short"), F.split("norm", " ").alias("all"))
    counted = split.select("row", "copy", "doc_id", "line", "h", "short", F.size("all").alias("words"), "all")
    word = counted.select("row", "copy", "doc_id", "line", "h", "short", "words", "all", F.posexplode_outer("all").alias("pos", "w"))
    counts = (F.length("w") >= LETTERS) | F.col("short")
    following = [F.get("all", F.col("pos") + i) for i in (1, 2)]
    # n-grams begin with a word that counts; in lines of few words these are too few, and pairs may also end with one
    either = counts | (F.length(following[0]) >= LETTERS)
    letters = F.length("w") + F.length(following[0])
    weights = [_weight(2, letters).alias("pair_weight"), _weight(3, letters + F.coalesce(F.length(following[1]), F.lit(0))).alias("three_weight")]
    word = word.where(counts | (F.col("words") < PAIRS))
    word = word.select("row", "copy", "doc_id", "line", "h", "words", "pos", "w", counts.alias("counts"), either.alias("either"), following[0].alias("w1"), following[1].alias("w2"), *weights)
    pair = F.when((F.col("words") >= LEAST) & (F.col("words") < BOTH) & F.col("either"), _gram("pair_weight", "w", "w1"))
    three = F.when((F.col("words") >= PAIRS) & F.col("counts"), _gram("three_weight", "w", "w1", "w2"))
    hashed = F.when(F.col("counts"), F.xxhash64("w")).otherwise(F.lit(0).cast("bigint")).alias("w")
    long = F.length("w") >= LETTERS
    chunk = F.expr(f"pos div {CHUNK}").cast("int").alias("chunk")
    word = word.select("row", "copy", "doc_id", "line", "h", "words", chunk, hashed, F.col("counts").cast("int").alias("n"), long.alias("long"), pair.alias("pair"), three.alias("three"), "pair_weight", "three_weight")
    picks = [F.min(F.least(_order("pair", m), _order("three", m))).alias(f"p{i}") for i, m in enumerate(MASKS)]
    bit = F.expr("shiftleft(1L, cast(w & 63 as int))")
    odds = [F.bit_xor(F.when(F.col("long") & (F.shiftright("w", 6).bitwiseAND(3) == i), bit).otherwise(F.lit(0).cast("bigint"))).alias(o) for i, o in enumerate(ODD)]
    # few keys and sums: a generated aggregation stays small enough to be compiled
    rest = [F.sum("n").alias("n"), *odds, *[F.max(c).alias(c) for c in ("row", "doc_id", "h", "words")]]
    chunks = word.groupBy("copy", "line", "chunk").agg(*rest, *_packed(F.col("w")), *picks)
    one = chunks.where(F.col("words") <= CHUNK).select("row", "doc_id", "line", "h", _chunk_majority(F.col("n").cast("int")).alias("sim"), "words", *ODD, _picks())
    several = chunks.where(F.col("words") > CHUNK).groupBy("copy", "line")
    several = several.agg(*[F.max(c).alias(c) for c in ("row", "doc_id", "h", "words")], _majority(F.sum("n")).alias("sim"), *[F.bit_xor(o).alias(o) for o in ODD], *[F.min(f"p{i}").alias(f"p{i}") for i in range(len(MASKS))])
    several = several.select("row", "doc_id", "line", "h", "sim", "words", *ODD, _picks())
    return one.unionByName(several)


def _character(number: Column) -> Column:
    """The hexadecimal UTF-8 of one of 786,432 characters."""
    at = lambda shift: F.shiftright(number, shift).bitwiseAND(63)
    return F.hex(F.lit(0xF1808080) + F.shiftright(number, 18) * (1 << 24) + at(12) * (1 << 16) + at(6) * (1 << 8) + at(0))


def _string(hexes: Column) -> Column:
    return F.unhex(F.array_join(hexes, "")).cast("string")


def symbols(norm: Column) -> Column:
    """A normal line with one character for each word, one of 786,432 by a hash, so that edits are of words."""
    return _string(F.transform(F.split(norm, " "), lambda w: _character(F.pmod(F.xxhash64(w), F.lit(3 << 18)))))


def _keys(n: int) -> Column:
    """The buckets of a SimHash: one for each choice of blocks."""
    _, blocks, agree = next(x for x in BLOCKS if n <= x[0])
    ends = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, choice in enumerate(combinations(range(blocks), agree)):
        if agree == 1:  # a small number, which shuffles well compressed
            start, width = ends[choice[0]], ends[choice[0] + 1] - ends[choice[0]]
            keys.append(F.shiftrightunsigned("sim", start).bitwiseAND((1 << width) - 1) + (number << 32))
        else:
            mask = sum((1 << ends[i + 1]) - (1 << ends[i]) for i in choice)
            hashed = F.xxhash64(F.lit(number), F.col("sim").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
            keys.append(hashed.bitwiseAND((1 << 63) - 1))
    return F.explode(F.array(*keys)).alias("key")


def similar(pairs: DataFrame) -> DataFrame:
    """The pairs whose symbols x and y have an edit similarity of SIMILARITY % at least."""
    most = F.expr(f"cast(floor((100 - {SIMILARITY}) * greatest(length(x), length(y)) / 100) as int)")
    return pairs.withColumn("most", most).where(F.expr("levenshtein(x, y, most) >= 0")).drop("most")


def _exact(pairs: DataFrame) -> DataFrame:
    """(a, b, v, w) with the lines v and w to the pairs that are similar by their words: each word is its place among
    the pair's distinct ones, so unlike words never count as equal."""
    of = F.array_distinct(F.concat(F.split("v", " "), F.split("w", " ")))
    number = lambda c: _string(F.transform(F.split(c, " "), lambda x: _character(F.array_position("of", x))))
    # cut: else the optimizer moves the comparison below and has the strings, and "of" for each word of them, made anew
    return similar(cut(pairs.withColumn("of", of).select("a", "b", number("v").alias("x"), number("w").alias("y"))))


def _confirmed(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, x, y, v, w), those whose symbols x and y are similar and whose words are: where a pair has as many
    distinct symbols as words, unlike words have unlike symbols; the few others are compared again."""
    distinct = lambda x, y, by: F.size(F.array_distinct(F.concat(F.split(x, by), F.split(y, by))))
    sure = distinct("x", "y", "") == distinct("v", "w", " ")
    told = similar(pairs).select("a", "b", sure.alias("sure"), "v", "w")
    text = lambda c: F.when(~F.col("sure"), F.col(c)).alias(c)
    told = cut(told.select("a", "b", "sure", text("v"), text("w")))
    return told.where("sure").select("a", "b").unionByName(_exact(told.where("not sure")).select("a", "b"))


def _blocks(rows: DataFrame, n: int, near: Near) -> tuple[DataFrame, DataFrame]:
    """(id, sim, ...) of n rows to the pairs (a, b) near each other that share a bucket of HOT rows at most and differ in
    CLOSE bits at most, and to the rows (key, id, sim, ...) of other buckets. Rows of larger buckets are first put into
    those of the finest blocks."""
    columns = rows.columns
    close = (F.bit_count(F.col("x.sim").bitwiseXOR(F.col("y.sim"))) <= CLOSE) & near(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))
    pairs = None
    for size in (n, BLOCKS[-1][0]):
        keyed = rows.select(*columns, _keys(size))
        hot = few(cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key")), FEW)
        cold = keyed.join(hot, "key", "left_anti")
        met = cold.alias("x").join(cold.alias("y"), "key").where(close & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        pairs = met if pairs is None else pairs.unionByName(met)
        rest = keyed.join(hot, "key", "left_semi")
        if hot.isEmpty():
            break
        rows = cut(rest.drop("key").distinct())
    return pairs.distinct(), rest


def _bags(texts: DataFrame) -> DataFrame:
    """(id, v) to (id, bag0 to bag7): on which of 512 positions an odd number of the words of v falls (BAG)."""
    word = texts.select("id", F.explode(F.split("v", " ")).alias("w")).select("id", F.xxhash64("w").alias("w"))
    bit = F.expr("shiftleft(1L, cast(w & 63 as int))")
    return word.groupBy("id").agg(*[F.bit_xor(F.when(F.shiftright("w", 6).bitwiseAND(len(BAG) - 1) == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(o) for i, o in enumerate(BAG)])


def _met(able: DataFrame) -> DataFrame:
    """(id, picks) to (key, n, id) of the n-grams that n lines pick, n > 1. Most are of one line or of two or three, whose
    ids the counts themselves hold (least, greatest and the exclusive or of all), so only the others are looked up again."""
    one = able.select("id", F.explode("picks").alias("key"))
    counted = one.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.bit_xor("id").alias("all"))
    counted = cut(counted.where("n > 1"))
    third = F.expr("low ^ high ^ all")
    ids = F.when(F.col("n") == 2, F.array("low", "high")).otherwise(F.array("low", "high", third))
    small = counted.where("n <= 3").select("key", "n", F.explode(ids).alias("id"))
    more = cut(counted.where("n > 3").select("key", "n"))
    return small.unionByName(one.join(few(more, FEW), "key").select("key", "n", "id"))


@scratch
def mark_lines(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text) to (row, gone): for each row with lines that go, their numbers, ascending."""
    lines = cut(simhashes(docs))
    at = F.struct(F.col("doc_id"), F.col("row"), F.col("line"), F.col("words"), *ODD, F.col("picks"))
    classes = lines.groupBy("h", "sim").agg(F.min(at).alias("at"))  # 128 bits tell lines apart
    classes = cut(classes.select(F.monotonically_increasing_id().alias("id"), "at", "sim"))
    n_classes = classes.count()

    def sifted(a, b, positions) -> Column:
        longer, shorter = F.greatest(a("words"), b("words")), F.least(a("words"), b("words"))
        edits = F.floor((100 - SIMILARITY) * longer / 100)
        odd = sum((F.bit_count(a(o).bitwiseXOR(b(o))) for o in positions), F.lit(0))
        # of as many edits, those that make lengths differ change one position, others two at most
        return (longer - shorter <= edits) & (odd <= 2 * edits - (longer - shorter))

    def near(a, b) -> Column:
        return sifted(a, b, ODD) & (F.bit_count(a("sim").bitwiseXOR(b("sim"))) <= DISTANCE)

    def near_by(positions) -> Near:
        """The same in buckets of n-grams and of blocks, which say in how many bits their lines may differ."""
        return lambda a, b: sifted(a, b, positions) & (F.bit_count(a("sim").bitwiseXOR(b("sim"))) <= a("bits"))

    def norms(ids: DataFrame) -> DataFrame:
        """(id) to (id, v), the normal lines."""
        wanted = cut(classes.select("id", "at.doc_id", "at.row", "at.line").join(few(ids, FEW), "id"))
        found = docs.alias("docs").join(few(wanted, FEW).alias("wanted"), F.expr("docs.doc_id <=> wanted.doc_id")).where("docs.row = wanted.row")
        own = cleaned(found.select("id", F.get(F.split("text", "\n"), F.col("line")).alias("text")).dropDuplicates(["id"]))
        return own.select("id", F.trim("clean").alias("v"))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        ids = cut(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
        texts = cut(norms(ids).select("id", "v", symbols(F.col("v")).alias("x")))
        side = lambda i, **to: texts.select(F.col("id").alias(i), *[F.col(c).alias(k) for k, c in to.items()])
        return _confirmed(pairs.join(side("a", x="x", v="v"), "a").join(side("b", y="x", w="v"), "b"))

    able = classes.where("at.picks is not null").select("id", "sim", "at.words", *[f"at.{o}" for o in ODD], "at.picks")  # others only equal each other
    sides = able.select("id", "sim", "words", *ODD)
    met = cut(_met(able.select("id", "picks")).join(sides, "id"))
    # buckets of up to ALL lines are compared whole, at ALL / 2 comparisons for a line; others by way of leaders
    x, y = (met.where(F.col("n") <= ALL).select(*[F.col(c).alias(c if c == "key" else f"{to}_{c}") for c in ("key", *sides.columns)]) for to in "xy")
    pairs = x.join(y, "key").where((F.col("x_id") < F.col("y_id")) & near(lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}")))
    pairs = pairs.select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct()
    close, blocks = _blocks(sides, n_classes, near)
    grams = met.where(F.col("n") > ALL).drop("n").withColumn("bits", F.lit(DISTANCE))
    large = cut(grams.unionByName(blocks.withColumn("bits", F.lit(CLOSE))))
    compared = [c for c in large.columns if c not in ("key", "id")]
    lead = large.groupBy("key").agg(F.min(F.struct("id", *compared)).alias("lead"))
    lead = cut(lead.select("key", F.col("lead.id").alias("lead"), *[F.col(f"lead.{c}").alias(f"lead_{c}") for c in compared]))

    def with_comp(comps: DataFrame) -> DataFrame:
        # linked lines are in one or in neighbouring classes of length; each two of these are a bucket
        length = F.floor(F.log(F.col("words").cast("double")) / math.log(100 / SIMILARITY) + 1e-9)
        parts = F.explode(F.array(F.xxhash64("key", length), F.xxhash64("key", length + 1))).alias("key")
        return large.select(parts, "id", "sim", "words", "bits").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    closer = lambda ids: _bags(norms(ids))
    comps = cut(linked(large.join(few(lead, FEW), "key"), near_by(ODD), verify, with_comp, near_by(BAG), hot=HOT, also=pairs.unionByName(close), closer=closer))
    kept = classes.join(comps, "id", "left").groupBy(F.coalesce("comp", "id").alias("comp")).agg(F.min(F.struct("at.doc_id", "at.row", "at.line")).alias("at"))
    gone = cut(lines.select("row", "line").join(kept.select("at.row", "at.line"), ["row", "line"], "left_anti"))
    return gone.groupBy("row").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with text less the lines that repeat or nearly repeat an earlier one, and n_lines and
    n_kept added (columns of these names are replaced). Earlier is by doc_id, then a hash of the row, then the line.

    Blank lines stay where they are and count as kept. Null text stays null, with no lines; empty text has one, blank.
    Rows that repeat a doc_id and text count as one document: each keeps the same lines. A null doc_id sorts first.
    A document all of whose lines are dropped has an empty text. Lines count whole, however long. An empty table gives
    no rows.
    """
    base = docs.select([c for c in docs.columns if c not in ("n_lines", "n_kept", "__row", "__gone", "__flags")])
    rows = base.withColumn("__row", F.xxhash64("doc_id", "text"))
    marks = mark_lines(rows.select(F.col("__row").alias("row"), "doc_id", "text")).withColumnsRenamed({"row": "__row", "gone": "__gone"})
    few_marks = marks.agg(F.coalesce(F.sum(F.size("__gone")), F.lit(0))).first()[0] <= MARKED
    joined = rows.join(F.broadcast(marks) if few_marks else marks, "__row", "left")
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    # one flag for each line up to the last that goes; a column used more than once is made once for each row
    gap = lambda x, i: x - F.coalesce(F.get("__gone", i - 1), F.lit(-1)) - 1
    flags = F.flatten(F.transform("__gone", lambda x, i: F.concat(F.array_repeat(F.lit(0), gap(x, i)), F.array(F.lit(1)))))
    stays = F.filter(F.split("text", "\n"), lambda x, i: F.coalesce(F.get("__flags", i), F.lit(0)) == 0)
    gone = F.coalesce(F.aggregate("__flags", F.lit(0), lambda n, x: n + x), F.lit(0))
    less = F.when(F.col("__flags").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    out = joined.withColumn("__flags", flags).withColumns({"n_lines": lines, "n_kept": lines - gone, "text": less})
    return out.select(*base.columns, "n_lines", "n_kept")
