"""Benchmark decontamination by SimHash of item-sized windows (DataFrame functions only).

Words are runs of letters and digits of the lower-cased text; shingles are five
words (all words of a shorter item). A document is contaminated where a window as
long as an item has a weighted shingle similarity of SIMILARITY or more to it.

1. Windows. A window that similar holds more than 1 - SIMILARITY of the item's
   shingle weight, hence one of any shingles of the item that weigh more than that
   together. Each item chooses such shingles, the ones with the longest words, and the
   longest word of each as anchor. Words of documents are looked up among the
   anchors; where the whole shingle agrees, every item-sized window that contains it is a
   candidate, wherever in the item the shingle stands. Taken are those with as many shingles
   of the item as SIMILARITY asks at least (8/9 of a window of the item's size). No window that could pass is lost.
2. Fingerprints. Equal windows are one. Each gets a SimHash of BITS bits of its weighted shingles.
3. Multi-index Hamming join. Fingerprints are cut into BLOCKS blocks; two within RADIUS
   bits differ by at most RADIUS // BLOCKS bits in some block (pigeonhole), so the items are
   indexed under all block values within that many bits and windows probe with
   their own: every pair within RADIUS is met. Pairs within RADIUS go on.
4. The weighted shingle similarity of each pair is computed exactly from the words.

Step 1 only spares work: without it all windows would be fingerprinted, with the same result. A pair at SIMILARITY differs in
19 of 128 bits on average (deviation 4); RADIUS lies seven deviations off, and unlike texts differ in 64.

Null or empty text: no window. Items without words match nothing; equal items all match, and so do all windows that tie. Very long texts
are read whole. Repeated document rows give each match once for a doc_id. Extra columns are ignored, whatever their names.
Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small, written

SIMILARITY = 0.8
SHINGLE = 5
BITS = 128
BLOCKS = 16
RADIUS = 47
#: Rows of the items' index (under 64 bytes each) up to which it is broadcast: that of about 700 items.
INDEX_ROWS = 400_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text; a text without words gives an empty list."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def _run(words: Column, start: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def shingles_of(words: Column) -> Column:
    """All shingles of a list of words, repeated ones too."""
    n = F.size(words)
    return F.when(n == 0, F.array().cast("array<string>")).when(n < SHINGLE, F.array(F.array_join(words, " "))).otherwise(F.transform(F.sequence(F.lit(1), n - (SHINGLE - 1)), lambda i: _run(words, i, SHINGLE)))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, words, shingles of the items that have words."""
    rows = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    return rows.withColumn("shingles", shingles_of(F.col("words"))).distinct()


def anchors_of(items: DataFrame) -> DataFrame:
    """word, gram, offset, n_gram, n_words, weight, theirs: where a chosen shingle of an item begins before its anchor word, and the hashes of the item's shingles.

    Distinct over items: the same passage in many items gives its rows once.
    """
    rows = items.select("words", F.posexplode("shingles").alias("at", "gram"), F.size("shingles").alias("weight"))
    parts = F.split("gram", " ")
    lengths = F.transform(parts, F.length)
    offset = F.array_position(lengths, F.array_max(lengths)) - 1
    rows = rows.withColumn("offset", offset.cast("int")).withColumn("word", F.element_at(parts, F.col("offset") + 1)).withColumn("n_gram", F.size(parts))
    # Shingles in the order of their longest word; by word, as each word serves up to five of them.
    key = F.sha2(F.array_join("words", " "), 256)
    lists = rows.groupBy(key.alias("key")).agg(F.first("words").alias("words"), F.first("weight").alias("weight"), F.sort_array(F.collect_list(F.struct((-F.length("word")).alias("rank"), "word", "at", "gram", "offset", "n_gram"))).alias("all"))
    enough = F.floor((1 - SIMILARITY) * F.col("weight") + 1e-9).cast("int") + 1
    theirs = F.sort_array(F.transform(F.array_distinct(F.col("all.gram")), lambda s: F.xxhash64(s)))
    chosen = lists.select(F.size("words").alias("n_words"), "weight", theirs.alias("theirs"), F.explode(F.slice("all", 1, enough)).alias("g"))
    return chosen.select("g.word", "g.gram", "g.offset", "g.n_gram", "n_words", "weight", "theirs").distinct()


def windows_of(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """doc_id, start (in words), words: all item-sized windows that hold a chosen shingle of an item of their size."""
    rows = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    hits = rows.select("doc_id", "words", F.posexplode("words").alias("p", "word")).join(small(anchors), "word")
    same = _run(F.col("words"), F.greatest(F.col("p") - F.col("offset") + 1, F.lit(1)), F.col("n_gram")) == F.col("gram")
    hits = hits.filter((F.col("p") >= F.col("offset")) & same)
    # Words that some window around the shingle holds, and which of their shingles are the item's.
    n, at = F.size("words"), F.col("p") - F.col("offset")
    first = at - (F.col("n_words") - F.col("n_gram"))
    low = F.greatest(first, F.lit(0))
    near = F.slice("words", low + 1, F.least(at + F.col("n_words"), n) - low)
    hits = hits.select("doc_id", "words", "n_words", "weight", "theirs", n.alias("n"), at.alias("last"), first.alias("first"), low.alias("low"), shingles_of(near).alias("near"))
    hits = hits.withColumn("own", F.transform("near", lambda s: F.array_contains(F.col("theirs"), F.xxhash64(s)).cast("int")))
    # At the ends of a text the window is as much of the item's size as there is.
    begin = lambda s: F.greatest(s, F.lit(0))
    length = lambda s: F.least(s + F.col("n_words"), F.col("n")) - begin(s)

    def enough(s: Column) -> Column:
        size = F.greatest(length(s) - (SHINGLE - 1), F.lit(1))
        held = F.aggregate(F.slice("own", begin(s) - F.col("low") + 1, size), F.lit(0), lambda acc, x: acc + x)
        return held >= (F.col("weight") + size) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6

    starts = F.filter(F.sequence(F.col("first"), F.col("last")), enough)
    hits = hits.select("doc_id", "words", "n_words", "n", F.explode(starts).alias("s"))
    return hits.select("doc_id", begin(F.col("s")).alias("start"), F.slice("words", begin(F.col("s")) + 1, length(F.col("s"))).alias("window")).distinct()


def simhash(shingles: Column) -> Column:
    """Array of BITS // 64 numbers: a bit is set if more than half of the shingle weight has it set.

    Bits j and j + 32 of all hashes are counted in one number, in fields of 32 bits each.
    """
    fields = F.lit((1 << 32) + 1)
    half = F.floor(F.size(shingles) / 2)

    def word(seed: int) -> Column:
        hashes = F.transform(shingles, lambda s: F.xxhash64(F.lit(seed), s))
        out = F.lit(0).cast("long")
        for j in range(32):
            votes = F.aggregate(F.transform(hashes, lambda h: F.shiftrightunsigned(h, j).bitwiseAND(fields)), F.lit(0).cast("long"), lambda acc, x: acc + x)  # noqa: B023
            won = F.shiftrightunsigned(votes + (F.lit((1 << 30) - 1) - half) * fields, 30).bitwiseAND(fields)
            out = out.bitwiseOR(F.shiftleft(won, j))
        return out

    return F.array(*[word(k) for k in range(BITS // 64)])


def blocks_of(print_: Column) -> Column:
    """The block values of a fingerprint."""
    width = BITS // BLOCKS
    return F.array(*[F.shiftrightunsigned(print_[i * width // 64], i * width % 64).bitwiseAND(F.lit((1 << width) - 1)).cast("int") for i in range(BLOCKS)])


def hamming(a: Column, b: Column) -> Column:
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(BITS // 64)), F.lit(0))


def probes(width: int = BITS // BLOCKS, most: int = RADIUS // BLOCKS) -> list[int]:
    """All masks of at most `most` bits of a block."""
    return [m for m in range(1 << width) if bin(m).count("1") <= most]


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of lesser over sum of greater weights of two shingle lists, a weight being the number of occurrences."""
    both = F.array_intersect(a, b)
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    shared = F.when(plain, F.size(both)).otherwise(F.aggregate(both, F.lit(0), lambda acc, s: acc + F.least(F.size(F.filter(a, lambda x: x == s)), F.size(F.filter(b, lambda x: x == s)))))
    return shared / (F.size(a) + F.size(b) - shared)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, start, n_words, item_id, similarity of every window that passes."""
    items = written(items_of(benchmark), "leak-items")
    found = written(windows_of(docs, written(anchors_of(items), "leak-anchors")), "leak-windows")
    texts = found.select("window").distinct().select(F.xxhash64("window").alias("w"), F.col("window").alias("words"), shingles_of(F.col("window")).alias("shingles"))
    prints = written(texts.withColumn("print", simhash(F.col("shingles"))), "leak-prints")
    masks = F.array(*map(F.lit, probes()))
    plain_items = written(items.select("item_id", "shingles", simhash(F.col("shingles")).alias("print")), "leak-item-prints")
    index = plain_items.select("item_id", F.col("print").alias("item_print"), F.posexplode(blocks_of(F.col("print"))).alias("i", "own"))
    index = index.select("item_id", "item_print", "i", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("own")))).alias("v"))
    probe = prints.select("w", "print", F.posexplode(blocks_of(F.col("print"))).alias("i", "v"))
    near = probe.join(small(index, plain_items.count() * BLOCKS * len(probes()), INDEX_ROWS), ["i", "v"])
    near = near.filter(hamming(F.col("print"), F.col("item_print")) <= RADIUS).select("w", "item_id").distinct()
    pairs = near.join(prints.select("w", "words", "shingles"), "w").join(small(plain_items.select("item_id", F.col("shingles").alias("theirs"))), "item_id")
    similarity = weighted_similarity(F.col("shingles"), F.col("theirs"))
    passed = pairs.select("words", "item_id", similarity.alias("similarity")).filter(F.col("similarity") >= SIMILARITY - 1e-9)
    out = found.join(passed, F.col("window") == F.col("words"))
    return out.select("doc_id", F.col("start").cast("long").alias("start"), F.size("window").cast("long").alias("n_words"), "item_id", "similarity")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones; all columns stay."""
    leak = fresh("leak", docs)
    leaks = written(matches(docs, benchmark).select(F.col("doc_id").alias(leak)).distinct(), "leak-docs")
    return docs.join(small(leaks), F.col("doc_id").eqNullSafe(F.col(leak)), "left_anti")
