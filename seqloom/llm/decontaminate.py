"""Benchmark decontamination, in DataFrame functions only.

A document holds a benchmark item if a window of the item's size has a similarity
of 0.8 to it: that of their five-word shingles weighted by occurrence (sum of
minima over sum of maxima). Every window that can reach it is compared exactly.
The best window's 64-bit SimHash of words, and how many of its bits differ from the
item's, is given with the match but decides nothing: at 0.8 about 10 of 64 bits are
expected to differ, far more where words repeat, so each radius loses matches.

Words are maximal runs of letters and digits in lower case, so punctuation that
sticks to a passage does not hide it.

Scale. The pass over the corpus is one narrow scan that looks up shingles of the
benchmark, broadcast only if they were counted and are few, and a shuffled join
otherwise. For each document and item the places of shared shingles are gathered.
A window starts at one of them (moving it up to its first shared shingle loses
nothing) and has so many of them as the threshold asks for; places that are too
few in a window's length never meet the texts again.

Defined cases: null and empty texts match nothing; a window that would run past
the document's end is moved back, or is the whole document where that is
shorter; of equal windows the first that starts with a shared shingle is given;
items of fewer than five words are no evidence and match nothing; items
that repeat each get their rows; an empty benchmark or table gives no rows; a very
long text is one row, whose words are one array; other columns, of any name, are
ignored by ``contaminated`` and kept by ``clean``. Null item ids and doc ids are
carried as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import BOX, KEY, Shelf, boxed, keyed

SHINGLE, THRESHOLD = 5, 0.8
#: The most benchmark shingles, of 24 bytes each, that are broadcast.
BROADCAST_ROWS = 1_000_000
#: A sum of hash bits holds three counters of 22 bits: bits j, j + 22 and j + 44 of a word's hash.
_LANES, _WIDTH = 22, 22
_LANE_MASK = 1 | 1 << _WIDTH | 1 << 2 * _WIDTH


def word_ids(text: Column) -> Column:
    """A hash for each normalised word."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _with_shingles(df: DataFrame, ids: str = "ids", name: str = "shingles") -> DataFrame:
    """Adds the hashes of five consecutive words, built up from two and four, for each start; none for fewer words.

    In steps, so that no expression is evaluated more than once.
    """
    two = df.withColumn("_2", F.zip_with(ids, F.slice(ids, 2, 1 << 30), lambda a, b: F.xxhash64(a, b)))
    four = two.withColumn("_4", F.zip_with("_2", F.slice("_2", 3, 1 << 30), lambda a, b: F.xxhash64(a, b)))
    five = four.withColumn("_5", F.zip_with("_4", F.slice(ids, 5, 1 << 30), lambda a, b: F.xxhash64(a, b)))
    return five.withColumn(name, F.slice("_5", 1, F.greatest(F.size(ids) - (SHINGLE - 1), F.lit(0)))).drop("_2", "_4", "_5")


def fingerprint(ids: Column) -> Column:
    """64-bit SimHash of word hashes: each bit is the majority of the words' bits, counted for up to 4,194,303 words."""
    votes = ids
    zero = F.struct(*[F.lit(0).cast("long").alias(f"s{j}") for j in range(_LANES)])
    sums = F.aggregate(
        votes,
        zero,
        lambda a, h: F.struct(*[(a[f"s{j}"] + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_LANE_MASK))).alias(f"s{j}") for j in range(_LANES)]),
        lambda a: F.struct(a.alias("sums"), F.size(votes).alias("n")),
    )
    return sums


def _bits(sums: Column) -> Column:
    def bit(k: int) -> Column:
        lane, slot = k % _LANES, k // _LANES
        count = F.shiftrightunsigned(sums["sums"][f"s{lane}"], _WIDTH * slot).bitwiseAND(F.lit((1 << _WIDTH) - 1 if slot < 2 else (1 << 64 - 2 * _WIDTH) - 1))
        return F.shiftleft((count * 2 > sums["n"]).cast("long"), k)

    return reduce(lambda a, b: a.bitwiseOR(b), [bit(k) for k in range(64)])


def _starts(at: Column, n: Column, size: Column, threshold: float) -> Column:
    """Starts of the windows that hold enough of the sorted places to reach the threshold, moved back where they would run past the end."""
    width = F.least(n, size) - (SHINGLE - 1)
    # Shares of o in two multisets of a and b: o / (a + b - o) >= t where o >= (a + b) t / (1 + t).
    least = F.ceil((n - (SHINGLE - 1) + width) * (threshold / (1 + threshold)) - 1e-9).cast("int")
    enough = F.filter(at, lambda p, i: F.get(at, i + least - 1) - p < width)
    return F.array_distinct(F.transform(enough, lambda p: F.greatest(F.lit(0), F.least(p, size - n))))


def _occurrences(df: DataFrame, name: str) -> DataFrame:
    """A multiset as a set: each repeat is numbered, so set sizes are sums of weights. In steps, so that nothing is sorted twice."""
    ordered = F.col("ordered")
    return df.withColumn("ordered", F.sort_array(name)).withColumn(name, F.transform(ordered, lambda x, i: F.xxhash64(x, i + 1 - F.array_position(ordered, x)))).drop("ordered")


def matches(docs: DataFrame, benchmark: DataFrame, shelf: Shelf, threshold: float = THRESHOLD) -> DataFrame:
    """_k, doc_id, item_id, start, n_words, hamming, similarity: each document's best window for each item. ``docs`` has the row key."""
    ids = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("item", F.monotonically_increasing_id()).withColumn("ids", word_ids(F.col("text"))).filter(F.size("ids") >= SHINGLE)
    items = ids.select("item", "item_id", F.size("ids").alias("n"), "ids", fingerprint(F.col("ids")).alias("sums"))
    items = shelf.put(_with_shingles(items).select("item", "item_id", "n", _bits(F.col("sums")).alias("bits"), "shingles"), "items")
    grams = shelf.put(items.select("item", "n", F.explode_outer(F.array_distinct("shingles")).alias("gram")), "grams")
    # Repeats count too: both what is looked up and the items' own lists are broadcast, or neither.
    few = (items.agg(F.sum(F.size("shingles"))).first()[0] or 0) <= BROADCAST_ROWS
    lookup = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    # The outer form makes Spark add no filter that would evaluate the shingles again; its null rows find no partner.
    here = _with_shingles(docs.select(KEY, word_ids(F.col("text")).alias("ids"))).select(KEY, F.size("ids").alias("size"), F.posexplode_outer("shingles").alias("p", "gram"))
    shared = here.join(lookup(grams), "gram").groupBy(KEY, "item", "n", "size").agg(F.sort_array(F.collect_list("p")).alias("at"))
    places = shared.select(KEY, "item", "n", _starts(F.col("at"), F.col("n"), F.col("size"), threshold).alias("starts")).filter(F.size("starts") > 0)
    hits = shelf.put(places.groupBy(F.col(KEY).alias("key")).agg(F.collect_list(F.struct("item", "n", "starts")).alias("places")), "hits", free=True)
    texts = docs.select(KEY, "doc_id", "text")
    found = texts.join(hits.hint("shuffle_hash"), texts[KEY] == hits["key"]).select(KEY, "doc_id", word_ids(F.col("text")).alias("ids"), "places")
    each = _with_shingles(found).select(KEY, "doc_id", "ids", "shingles", F.inline_outer("places")).select(KEY, "doc_id", "ids", "shingles", "item", "n", F.explode_outer("starts").alias("start"))
    width = F.least(F.col("n"), F.size("ids")) - (SHINGLE - 1)
    windows = each.select(KEY, "doc_id", "item", "n", "start", F.slice("ids", F.col("start") + 1, F.col("n")).alias("words"), F.slice("shingles", F.col("start") + 1, width).alias("shingles"))
    marked = _occurrences(windows, "shingles")
    weighed = _occurrences(items.select("item", "item_id", "bits", F.col("shingles").alias("other")), "other")
    common = marked.join(lookup(weighed), "item").withColumn("common", F.size(F.array_intersect("shingles", "other")))
    scored = common.withColumn("similarity", F.col("common") / (F.size("shingles") + F.size("other") - F.col("common"))).filter(F.col("similarity") >= threshold)
    best = scored.groupBy(KEY, "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("minus_start"), "n", "doc_id", "item_id", "bits", "words")).alias("b"))
    summed = best.select(KEY, "b.*").withColumn("sums", fingerprint(F.col("words"))).drop("words")
    hamming = F.bit_count(_bits(F.col("sums")).bitwiseXOR(F.col("bits"))).cast("int")
    return summed.select(KEY, "doc_id", "item_id", (-F.col("minus_start")).cast("long").alias("start"), F.col("n").cast("long").alias("n_words"), hamming.alias("hamming"), "similarity")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, start, n_words, hamming, similarity: one row for each document and each item it holds."""
    shelf = Shelf(docs.sparkSession, "decontaminate")
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "decontaminate")
    return matches(rows, benchmark, shelf, threshold).drop(KEY)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows and columns given, without the documents that hold an item."""
    shelf = Shelf(docs.sparkSession, "decontaminate")
    rows = keyed(boxed(docs, "doc_id", "text"), "decontaminate")
    found = shelf.put(matches(rows.select(KEY, F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, shelf, threshold).select(F.col(KEY).alias("held")).distinct(), "held", free=True)
    return rows.join(found.hint("shuffle_hash"), rows[KEY] == found["held"], "left_anti").select(f"{BOX}.*")
