"""Document fingerprints: SimHash, in DataFrame functions only.

A text's terms are its pairs of neighbouring words (and its last word alone), weighted by
how often they occur. A term's 64-bit hash votes for or against each bit of the
fingerprint; a bit is set where more than half of the votes are for it. Two texts whose
term vectors meet at an angle a differ in a/pi of the bits on average, so the cosine of
that angle, as the bits tell it, is given as their likeness (0 from a right angle on).

All fingerprints within a Hamming radius are found by permuted block tables: the bits are
cut into blocks, more than the radius, and each table puts some of the blocks first.
Fingerprints within the radius differ in at most that many blocks, so they agree in all
others, and meet under the leading blocks of at least one table; a pair counts in the first
table that has it. Six blocks and a radius of three give twenty tables led by 31 to 33 bits.

Scale. Votes are sums by row, made where the row is; 32 sums hold two counters each, which
is enough for texts of 2**31 words. Texts are dealt once, by their row; a text's successor
sends over the characters that it is asked for. The order of all rows comes from sums by
ranges of it. Tables hold each distinct fingerprint once with its count, so copies, however
many, are one entry; the count of neighbours is summed where pairs are found.

Defined cases: a null text is empty, and an empty text has no terms and the fingerprint 0; very
long texts are one row and are used whole; rows are ordered by doc_id, null ones last, and
rows of one doc_id by their place in the input, so repeated rows follow each other; a single row is its own successor; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import order
from ._shared import KEY, WORD, Shelf, keyed

BITS, RADIUS, BLOCKS, EVERY = 64, 3, 6, 50
_LANES = 32
_PAIR = 1 | 1 << _LANES


def with_terms(df: DataFrame, text: str, name: str = "hashes") -> DataFrame:
    """Replaces a text by the hashes of its terms: each pair of neighbouring words, and the last word. In steps, so that nothing is evaluated twice."""
    rest = [c for c in df.columns if c != text]
    split = df.select(*rest, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    return split.select(*rest, F.zip_with("words", F.slice("words", 2, 1 << 30), lambda a, b: F.xxhash64(a, b)).alias(name))


def _signed(low: Column) -> Column:
    """Bits of a number that may need the sign."""
    return F.when(low, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))


def fingerprints(df: DataFrame, by: list[str], hashes: str) -> DataFrame:
    """by, fingerprint (a long) for each group of rows; ``hashes`` is the array of term hashes of a row. Rows without terms give 0."""
    each = df.select(*by, F.explode_outer(hashes).alias("h"))
    votes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(_PAIR))).alias(f"v{j}") for j in range(_LANES)]
    summed = each.groupBy(*by).agg(F.count("h").alias("n"), *votes)
    bit = lambda j, k: F.shiftleft(_signed(2 * F.shiftrightunsigned(f"v{j}", _LANES * k).bitwiseAND(F.lit((1 << _LANES) - 1)) > F.col("n")), j + _LANES * k)
    made = [bit(j, k) for k in range(2) for j in range(_LANES)]
    # Or-ed in pairs, so that the expression stays shallow.
    while len(made) > 1:
        made = [a.bitwiseOR(b) for a, b in zip(made[::2], made[1::2])]
    return summed.select(*by, F.coalesce(made[0], F.lit(0).cast("long")).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """The cosine of the angle that the differing bits tell, from 0 to 1."""
    return F.greatest(F.lit(0.0), F.cos(F.bit_count(a.bitwiseXOR(b)) * (3.141592653589793 / BITS)))


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """The leading bits of each table, as signed 64-bit masks: all choices of as many blocks as agree for sure."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("there must be more blocks than bits of the radius, and at most 64")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    one = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(one, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near(asked: DataFrame, held: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """a, b, bits, for every fingerprint a of ``asked`` and b of ``held`` (column ``fingerprint``, distinct) that differ in at most ``radius`` bits; equal ones too."""
    masks = block_masks(radius, blocks)
    tables = F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("t", "mask")
    cut = lambda df, n: df.select(F.col("fingerprint").alias(n), tables).select(n, "t", F.col(n).bitwiseAND(F.col("mask")).alias("lead"))
    x, y = cut(asked, "a"), cut(held, "b").withColumnsRenamed({"t": "u", "lead": "head"})
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.array_position(F.array(*[differ.bitwiseAND(F.lit(m)) for m in masks]), F.lit(0).cast("long"))
    on = (F.col("t") == F.col("u")) & (F.col("lead") == F.col("head")) & (F.bit_count(differ) <= radius) & (first == F.col("t") + 1)
    return x.join(y, on).select("a", "b", F.bit_count(differ).alias("bits"))


def fingerprinted(docs: DataFrame, radius: int = RADIUS, every: int = EVERY) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near for each row.

    The edited text has the last third of its characters replaced by the first as many
    characters of the next document, in descending order of doc_id; the first document
    follows the last. n_near: the other rows whose fingerprint lies within the radius, for
    rows whose doc_id is divisible by ``every``; null for the rest.
    """
    shelf = Shelf(docs.sparkSession, "simhash")
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "simhash")
    sized = rows.select(KEY, "doc_id", F.length("text").cast("long").alias("n_chars"))
    placed = shelf.put(order.ordinals(sized, [F.desc_nulls_last("doc_id"), F.col(KEY)], "at"), "order")
    total = placed.count()
    follows = placed.select(F.col(KEY).alias("next"), "at")
    asks = placed.select(F.col(KEY).alias("asker"), F.floor(F.col("n_chars") / 3).alias("part"), F.pmod(F.col("at") + 1, F.lit(max(total, 1))).alias("at"))
    asks = shelf.put(asks.join(follows, "at").select("asker", "part", "next"), "asks")
    # Texts are dealt by row once, and joined twice where they lie.
    dealt = rows.select(KEY, "text").repartition(KEY)
    heads = dealt.join(asks.select(F.col("next").alias(KEY), "asker", "part"), KEY).select(F.col("asker").alias(KEY), "part", F.substr("text", F.lit(1), F.col("part").cast("int")).alias("head"))
    both = dealt.join(heads, KEY).withColumn("edited", F.concat(F.substr("text", F.lit(1), (F.length("text") - F.col("part")).cast("int")), "head"))
    versions = both.select(KEY, F.explode(F.array(F.struct(F.lit(False).alias("changed"), F.col("text").alias("text")), F.struct(F.lit(True).alias("changed"), F.col("edited").alias("text")))).alias("v")).select(KEY, "v.*")
    hashed = with_terms(versions.select(KEY, "changed", F.when(F.col("changed"), F.sha2("text", 256)).alias("sha"), "text"), "text")
    printed = shelf.put(fingerprints(hashed, [KEY, "changed", "sha"], "hashes"), "prints", free=True)
    pick = lambda changed, c: F.max(F.when(F.col("changed") == changed, F.col(c)))
    paired = printed.groupBy(KEY).agg(pick(False, "fingerprint").alias("own"), pick(True, "fingerprint").alias("other"), pick(True, "sha").alias("edited_sha256"))
    marked = shelf.put(placed.join(paired, KEY).select(KEY, "doc_id", "n_chars", "at", "own", "other", "edited_sha256"), "marked")
    after = marked.select(F.pmod(F.col("at") - 1, F.lit(max(total, 1))).alias("at"), F.col("own").alias("following"))
    held = shelf.put(marked.groupBy(F.col("own").alias("fingerprint")).agg(F.count("*").alias("rows"), F.count_if(F.col("doc_id") % every == 0).alias("asking")), "held")
    pairs = near(held.filter("asking > 0").select("fingerprint"), held.select("fingerprint"), radius)
    counted = pairs.join(held.select(F.col("fingerprint").alias("b"), "rows"), "b").groupBy("a").agg((F.sum("rows") - 1).alias("n_near"))
    text = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    joined = marked.join(after, "at").join(counted, F.col("own") == F.col("a"), "left")
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", text("own").alias("fingerprint"), text("other").alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
        F.when(F.col("doc_id") % every == 0, F.col("n_near")).alias("n_near"),
    )
