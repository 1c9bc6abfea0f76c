"""Fuzzy line de-duplication.

Lines are normalised to words (lower case; ASCII signs other than letters and digits
part words).  Equal normalised lines are one; of
different ones two link when their 63-bit SimHashes over words differ in at most
``BITS`` bits and their edit similarity over words (one less the edit distance of
the word sequences over the longer's words) is ``SIMILAR`` or more.  Each connected
group of lines keeps one occurrence: the first by document id, then line number.

SimHash counts the words that have a bit, for all bits, seven counters in each of 9
numbers, added up where the lines are read; words beyond ``PARTED`` count in a part of
their own, and the few lines of several parts are added up after that.  Lines meet in
the ``2 ** (BITS + 1) - 1`` tables of a covering (see ``covering``): each compares about
33 of the bits, and two hashes within ``BITS`` bits agree in one table at least.  Each
table is dealt once; lines alone in their bucket, nearly all, go there.  In a bucket of
up to ``CROWD`` lines all pairs are compared; in a larger one every line meets the two
extreme ones, and the rest when components are known.  Of the near pairs
each line first tries one; after the links found are merged, only lines of different
components are tried, so a group of near copies never tries all its pairs.  Texts are
no part of any of these shuffles: only those lines of near pairs are read again for
the edit distance.

Everything is DataFrame code; sums, minima and counts are aggregated before the
shuffle, and a line that fills a third of the corpus is one row after that.

Defined results: null texts have no lines; blank lines (nothing left after
normalising) and lines of rows with a null id are kept; repeated rows of a document
count as one; an empty table stays empty; a line may have any number of words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelode.session import cut_lineage, shuffles_go_early

from .common import if_small, stored
from .components import components
from .covering import masks, signed

BITS = 3
SIMILAR = 0.8
GROUPS, EACH, WIDTH = 9, 7, 9          # numbers, counters in each, bits of a counter
PART = (1 << WIDTH) - 1                # a whole counter
PARTED = 256                           # words of a part of a line, fewer than a counter holds
CROWD = 24                             # lines of a bucket that are compared pairwise
IDS = 1_000_000       # keys or ids of this many rows at most are broadcast (eight bytes each)


def words_of(line: Column) -> Column:
    """The words of a line as compared."""
    return F.array_remove(F.split(F.lower(line), r"[^a-z0-9\x{80}-\x{10ffff}]+"), "")


def _counters() -> list[Column]:
    """Sums over word hashes ``h``: for every bit, the number of words that have it."""
    spread = F.lit(sum(1 << (WIDTH - 1) * i for i in range(EACH)))      # bit i of the i-th copy lies at WIDTH * i
    mask = F.lit(sum(1 << WIDTH * i for i in range(EACH)))
    bits = [F.shiftrightunsigned("h", EACH * i).bitwiseAND(F.lit((1 << EACH) - 1).cast("long")) for i in range(GROUPS)]
    return [F.sum((x * spread).bitwiseAND(mask)).alias(f"c{i}") for i, x in enumerate(bits)]


def _majority() -> Column:
    """63 bits: bit i is set when more than half of the words have it."""
    # three counters at a time have room for a carry, which those above half make with this
    lanes = sum(1 << 2 * WIDTH * i for i in range(EACH // 2))
    lift = F.lit(PART) - F.floor(F.col("words") / 2)
    out = F.lit(0).cast("long")
    for i in range(GROUPS):
        seven = F.shiftrightunsigned(F.col(f"c{i}").bitwiseAND(F.lit(PART << WIDTH * (EACH - 1))), WIDTH * (EACH - 1)) + lift
        seven = F.shiftleft(F.shiftrightunsigned(seven, WIDTH), EACH - 1)
        for odd in (0, 1):
            three = F.shiftrightunsigned(f"c{i}", WIDTH * odd).bitwiseAND(F.lit(PART * lanes)) + lift * F.lit(lanes)
            three = F.shiftrightunsigned(three, WIDTH).bitwiseAND(F.lit(lanes))
            for k in range(EACH // 2):
                bit = F.shiftrightunsigned(three, 2 * (WIDTH - 1) * k).bitwiseAND(F.lit(1 << 2 * k).cast("long"))
                seven = seven.bitwiseOR(F.shiftleft(bit, odd))
        out = out.bitwiseOR(F.shiftleft(seven, EACH * i))
    return out


def _majority_of(parts: DataFrame, *line: str) -> DataFrame:
    """``line``, words and hash of the lines with several parts, whose sums may be of any size."""
    counts = [F.sum(F.shiftrightunsigned(f"c{i}", WIDTH * k).bitwiseAND(F.lit(PART).cast("long"))) for i in range(GROUPS) for k in range(EACH)]
    words = F.sum("words")
    bits = [F.when(c * 2 > words, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(counts)]
    return parts.groupBy(*line).agg(words.alias("words"), reduce(Column.bitwiseOR, bits).alias("hash"))


def _buckets() -> Column:
    """All keys of a hash: of each table, by the bits it compares."""
    return F.array(*[F.xxhash64(F.lit(t), F.col("hash").bitwiseAND(signed(m))) for t, m in enumerate(masks(BITS))])


def _rows(docs: DataFrame, name: str) -> DataFrame:
    return docs.where(F.col("text").isNotNull() & F.col(name).isNotNull()).select(F.col(name).alias("id"), F.col("text").cast("string").alias("text"))


def lines_of(docs: DataFrame, name: str = "doc_id") -> DataFrame:
    """id, row (a number for every row), line number, words and key (hash of the words) of every line.

    Lines without words are among them; a condition on ``words`` would have every line split twice.
    """
    rows = _rows(docs, name).withColumn("row", F.monotonically_increasing_id())
    lines = rows.select("id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("id", "row", "line_no", words_of(F.col("line")).alias("words")).select("*", F.xxhash64("words").alias("key"))


def _hashed(docs: DataFrame, name: str) -> DataFrame:
    """id, line_no, key, size (words) and SimHash of every line; those of repeated rows of a document come as often."""
    line = ["id", "row", "line_no", "key"]
    # outer, as the other one has lines filtered first by their number of words, which splits them twice
    words = lines_of(docs, name).select(*line, F.posexplode_outer("words").alias("at", "word")).where(F.col("word").isNotNull())
    parts = words.select(*line, F.shiftright("at", PARTED.bit_length() - 1).alias("part"), F.xxhash64("word").alias("h")).groupBy(*line, "part").agg(
        F.count(F.lit(1)).alias("words"), *_counters())
    # one condition on both columns: on ``part`` alone it would move below the sums, which would be made twice
    whole = F.col("words") + F.col("part") * PARTED < PARTED
    given = ["id", "line_no", "key", F.col("words").cast("int").alias("size"), "hash"]
    return parts.where(whole).withColumn("hash", _majority()).select(*given).unionAll(_majority_of(parts.where(~whole), *line).select(*given))


def _near(a: str, b: str) -> Column:
    """The cheap part of the test: hashes within ``BITS`` bits, lengths that allow the similarity."""
    bits = F.bit_count(F.col(f"{a}.hash").bitwiseXOR(F.col(f"{b}.hash"))) <= BITS
    return bits & (F.least(f"{a}.size", f"{b}.size") >= F.greatest(f"{a}.size", f"{b}.size") * SIMILAR - 1e-9)


def _signs(words: Column) -> Column:
    """The word sequence with one character (of 16,384, by hash) for each word, for the built-in edit distance."""
    digits = F.transform(words, lambda w: F.hex(F.xxhash64(w).bitwiseAND(F.lit(0x3FFF).cast("long")).bitwiseOR(F.lit(0x4000).cast("long"))))
    return F.decode(F.unhex(F.array_join(digits, "")), "UTF-16BE")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of keys whose edit similarity is high enough."""
    keys = if_small(cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()), IDS)
    texts = texts.join(keys, "key", "left_semi")
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("signs").alias("ta")), "a").join(
        texts.select(F.col("key").alias("b"), F.col("signs").alias("tb")), "b")
    most = both.withColumn("most", F.floor(F.greatest(F.char_length("ta"), F.char_length("tb")) * (1 - SIMILAR) + 1e-9).cast("int"))
    return cut_lineage(most.where(F.expr("levenshtein(ta, tb, most)").between(F.lit(0), F.col("most"))).select("a", "b"))


def _label(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("comp", F.coalesce("root", "key")).drop("root")


def _across(many: DataFrame, comps: DataFrame) -> DataFrame:
    """Near pairs of different components in one bucket; the largest component of a bucket is not paired with itself."""
    rows = cut_lineage(_label(many, comps))
    groups = (
        rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("bucket")
        .agg(F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("k")).where(F.col("k") > 1)
        .select("bucket", F.col("top.comp").alias("main")))
    full = cut_lineage(rows.join(groups, "bucket"))
    a, b = full.where(F.col("comp") != F.col("main")).alias("a"), full.alias("b")
    once = (F.col("b.comp") == F.col("b.main")) | (F.col("a.key") > F.col("b.key"))
    met = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.comp") != F.col("b.comp")) & once & _near("a", "b"))
    return met.select(F.greatest("a.key", "b.key").alias("a"), F.least("a.key", "b.key").alias("b")).distinct()


def _texts(pairs: DataFrame, docs: DataFrame, keyed: DataFrame, name: str) -> DataFrame:
    """key and signs of the lines in the pairs, each from one place that holds it."""
    wanted = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    places = cut_lineage(keyed.join(if_small(wanted, IDS), "key").select("at.id", "at.line_no", "key"))
    # stored with the words, which the steps below would each make again
    found = cut_lineage(_rows(docs, name).join(if_small(places, IDS), "id").select(
        "key", words_of(F.get(F.split("text", "\n"), F.col("line_no"))).alias("words")))
    return cut_lineage(
        found.where(F.xxhash64("words") == F.col("key")).select("key", _signs(F.col("words")).alias("signs"))
        .groupBy("key").agg(F.first("signs").alias("signs")))


def _crowded(keyed: DataFrame) -> DataFrame:
    """bucket, key, hash, size and c (lines in the bucket) of all lines that are not alone there."""
    entries = keyed.select(F.explode(_buckets()).alias("bucket"), "key")
    met = entries.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).where(F.col("c") > 1)
    return stored(met.join(keyed.select("key", "hash", "size"), "key"))


def _met(crowded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The near pairs (a, b) of lines, and the rows of buckets of which only the pairs with an extreme line are among them."""
    few, many = crowded.where(F.col("c") <= CROWD), crowded.where(F.col("c") > CROWD)
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.key") > F.col("y.key")) & _near("x", "y")).select(
        F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    line = F.struct("key", "hash", "size")
    ends = many.groupBy("bucket").agg(F.array(F.min(line), F.max(line)).alias("ends")).select("bucket", F.explode("ends").alias("y"))
    stars = many.select("bucket", line.alias("x")).join(ends, "bucket").where((F.col("x.key") != F.col("y.key")) & _near("x", "y")).select(
        F.greatest("x.key", "y.key").alias("a"), F.least("x.key", "y.key").alias("b"))
    return cut_lineage(pairs.unionAll(stars).distinct()), many


def links(docs: DataFrame, keyed: DataFrame, name: str = "doc_id") -> DataFrame:
    """(node, root) of all normalised lines that link with a different one."""
    near, many = _met(_crowded(keyed))
    texts = _texts(near, docs, keyed, name)
    tried = cut_lineage(near.groupBy("a").agg(F.min("b").alias("b")))
    found = _verified(tried, texts)
    comps = cut_lineage(components(found))
    pairs = cut_lineage(_apart(near, comps).join(tried, ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        found, tried = found.unionAll(_verified(pairs, texts)), tried.unionAll(pairs)
        comps = cut_lineage(components(found))
    pairs = cut_lineage(_across(many, comps).join(tried, ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        found = found.unionAll(_verified(pairs, _texts(pairs, docs, keyed, name)))
        comps = cut_lineage(components(found))
    return comps


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs of different components."""
    a = _label(pairs.select(F.col("a").alias("key"), "b"), comps).select(F.col("key").alias("a"), "b", F.col("comp").alias("of_a"))
    return _label(a.select(F.col("b").alias("key"), "a", "of_a"), comps).where("comp != of_a").select("a", F.col("key").alias("b"))


def dropped_lines(docs: DataFrame, name: str = "doc_id") -> DataFrame:
    """id and line number of every occurrence that goes: all of a group but its first."""
    shuffles_go_early(docs.sparkSession)
    docs = docs.select(name, "text")
    hashed = stored(_hashed(docs, name))
    keyed = stored(hashed.groupBy("key").agg(
        F.min(F.struct("id", "line_no")).alias("at"), F.max(F.struct("id", "line_no")).alias("last"), F.first("hash").alias("hash"), F.first("size").alias("size")))
    comps = if_small(links(docs, keyed, name).select(F.col("node").alias("key"), "root"))
    linked = cut_lineage(keyed.join(comps, "key").select("key", "at", "root"))
    firsts = linked.groupBy("root").agg(F.min("at").alias("stays"))
    same = keyed.where("at != last").join(comps, "key", "left_anti").select("key", F.col("at").alias("stays"))
    repeated = linked.join(firsts, "root").select("key", "stays").unionAll(same)
    return hashed.join(repeated, "key").where(F.struct("id", "line_no") != F.col("stays")).select("id", "line_no").distinct()


def summary(docs: DataFrame, name: str = "doc_id") -> DataFrame:
    """Of every row: its id, number of lines, and the numbers of those that go (counted from 0)."""
    gone = dropped_lines(docs, name).groupBy(F.col("id").alias(name)).agg(F.array_sort(F.collect_list("line_no")).alias("dropped"))
    counted = docs.select(name, F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    return counted.join(gone, name, "left").select(name, "n_lines", F.coalesce("dropped", none).alias("dropped"))


def clean(docs: DataFrame, name: str = "doc_id") -> DataFrame:
    """The documents, with all their columns, without the lines that go."""
    gone = dropped_lines(docs, name).groupBy(F.col("id").alias("__id")).agg(F.collect_list("line_no").alias("__gone"))
    lines = F.split(F.col("text"), "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    marked = docs.join(gone, docs[name] == gone["__id"], "left")
    return marked.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left)).select(*docs.columns)
