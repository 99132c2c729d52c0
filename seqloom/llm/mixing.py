"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Targets. Sources share all words in proportion to their weights; a source stops
at ``cap`` times its size and what is over goes to the others by weight, until
none is above.

Rates. Of all document rates between 0 and ``cap`` that meet the targets, entropy
balancing takes those of the least relative entropy to one copy of each document:
``min(cap, exp(u * size))``, with one multiplier u for each source. Newton's method on
the convex dual finds the multipliers. Each step sums words and their derivative over
all documents, folded by source and size, in one aggregation; a bracket around each
multiplier guards the steps where many rates stop at the cap.

Copies. Rates are rounded to whole copies by source and size: whole parts first, then
the parts left over by cumulative rounding in order of size. What a source then lacks
or has too much goes to, or comes from, documents of the size that leaves the least,
in five rounds; the last two may also move a document that was rounded by another copy. Which documents of one size get the extra copy is decided by a hash of id and
text, so reruns agree however the rows are dealt.

Scale. Texts are read once, to count words and hash them; the rest works on counts.
No source, size or group of copies is one task's: sums over documents are combined
before the shuffle, sizes are summed up by ranges of 1,024, sources are ranked within
ranges of their names, documents of a size are dealt to 1,024 lots by hash, and equal
rows, which have one hash, are folded first and dealt again by their place in the scan.

Defined cases: null and empty texts have size 0, and nothing is taken of them;
null is a source of its own, the last; repeated rows are documents of their own, and
where they differ in copies it does not matter which; a very long document is one row,
whose words are counted in the scan; an empty table gives an empty mix; other columns,
of any name, are kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import BOX, KEY, Shelf, boxed, keyed, n_words, quoted

CAP, WEIGHTS, LOTS = 3, (1, 2, 3), 1024
#: Sources are ranked in so many ranges of names; sizes are summed up by ranges of so many.
RANGES, SPAN = 32, 1024
#: Source rows, of some 100 bytes each, that are broadcast; more are joined.
FEW_SOURCES = 100_000
_FIRST = Window.unboundedPreceding


def _same(*pairs: tuple[str, str]) -> Column:
    made = F.lit(True)
    for a, b in pairs:
        made &= F.col(a).eqNullSafe(F.col(b))
    return made


def targets(sizes: DataFrame, shelf: Shelf, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """The rows with weight and target. ``sizes`` has one row for each source, with source_size; weights repeat in code-point order, null last."""
    named = sizes.withColumn("last", F.col("source").isNull()).repartitionByRange(RANGES, "last", "source").withColumn("range", F.spark_partition_id())
    named = shelf.put(named.withColumn("at", F.row_number().over(Window.partitionBy("range").orderBy("last", "source"))), "named")
    before = Window.orderBy("range").rowsBetween(_FIRST, -1)
    starts = named.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))  # at most RANGES rows
    turn = F.col("start") + F.col("at") - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    listed = shelf.put(named.join(F.broadcast(starts), "range").withColumn("weight", weight).drop("range", "at", "start", "last"), "listed")
    total = float(listed.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        # Sources above their cap at this level stay there, as the level only grows.
        over = (F.col("weight") * level > cap * F.col("source_size")) if capped >= 0 else F.lit(False)
        held = listed.agg(F.sum(F.when(over, F.col("source_size"))).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("free"), F.count(F.when(over, 1)).alias("n")).first()
        if held["n"] == capped or not held["free"]:
            break
        capped = held["n"]
        level = (total - cap * float(held["held"] or 0)) / held["free"]
    stops = float(cap) * F.col("source_size")
    # Where every source is at its cap no level is left.
    return listed.withColumn("target", F.least(stops, F.col("weight") * F.lit(level)) if capped >= 0 and held["free"] else stops)


def balance(groups: DataFrame, wanted: DataFrame, shelf: Shelf, cap: float = CAP, tolerance: float = 1e-10, steps: int = 80) -> DataFrame:
    """source, size, n, rate. ``groups`` has source, size (above 0) and n documents; ``wanted`` has source, source_size, target.

    The gradient of the dual is the sum over a source's documents of size * rate, less the
    target. It is solved on the scale of its logarithm, where the sum of exponentials is
    nearly straight, so few steps are needed.
    """
    spans = groups.groupBy("source").agg(F.sum("n").alias("documents"), F.min("size").alias("least"))
    open_ = wanted.filter((F.col("target") > 0) & (F.col("target") < F.lit(float(cap) * (1 - 1e-12)) * F.col("source_size")))
    state = open_.join(spans.withColumnRenamed("source", "s"), _same(("source", "s"))).select("source", "target", (F.col("source_size") / F.col("documents")).alias("scale"), F.col("source_size"), "least")
    least = F.col("least") / F.col("scale")
    state = state.select("source", "target", "scale", F.least(F.log(F.col("target") / F.col("source_size")) / least, F.lit(0.0)).alias("lo"), (F.lit(_log(cap)) / least).alias("hi"), F.lit(0.0).alias("u"))
    state = shelf.put(state, "dual-0")
    for step in range(1, steps + 1):
        near = F.broadcast(state) if _few(state) else state
        z = F.col("size") / F.col("scale")
        both = groups.withColumnRenamed("source", "g").join(near, _same(("g", "source"))).withColumn("free", F.col("u") * z < _log(cap))
        rate = F.when(F.col("free"), F.exp(F.col("u") * z)).otherwise(F.lit(float(cap)))
        words = F.col("n") * F.col("size") * rate
        kept = [F.first(c).alias(c) for c in ("target", "scale", "lo", "hi", "u")]
        sums = both.groupBy("source").agg(F.sum(words).alias("words"), F.sum(F.when(F.col("free"), words * z).otherwise(0.0)).alias("slope"), *kept)
        off = F.log(F.col("words") / F.col("target"))
        sums = sums.withColumn("off", off).withColumn("lo", F.when(off < 0, F.col("u")).otherwise(F.col("lo"))).withColumn("hi", F.when(off > 0, F.col("u")).otherwise(F.col("hi")))
        newton = F.col("u") - F.col("off") * F.col("words") / F.col("slope")
        after = F.when(F.col("off") == 0, F.col("u")).when((F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = shelf.put(sums.select("source", "target", "scale", "lo", "hi", after.alias("u"), "off"), f"dual-{step}")
        shelf.drop(f"dual-{step - 1}")
        off = state.agg(F.max(F.abs("off"))).first()[0]
        state = state.drop("off")
        if off is None or off <= tolerance:
            break
    ends = wanted.select("source", "target", "source_size").join(state.select(F.col("source").alias("s"), "scale", "u"), _same(("source", "s")), "left").drop("s")
    ends = shelf.put(ends, "multipliers")
    tilt = F.col("u") * F.col("size") / F.col("scale")
    rate = F.when(F.col("u").isNotNull(), F.when(tilt < _log(cap), F.exp(tilt)).otherwise(F.lit(float(cap)))).when(F.col("target") > 0, F.lit(float(cap))).otherwise(F.lit(0.0))
    near = F.broadcast(ends) if _few(ends) else ends
    return groups.withColumnRenamed("source", "g").join(near, _same(("g", "source"))).select("source", "size", "n", rate.alias("rate"))


def _log(x: float) -> Column:
    return F.log(F.lit(float(x)))


def _few(table: DataFrame) -> bool:
    return table.count() <= FEW_SOURCES


def _extra(groups: DataFrame, wanted: DataFrame, shelf: Shelf, cap: float, rounds: int = 5) -> DataFrame:
    """source, size, n, whole, extra: each of the group's documents gets ``whole`` copies and ``extra`` of them one more. ``groups`` has the rates."""
    split = groups.withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn("part", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)) * F.col("n")).withColumn("span", F.expr(f"size div {SPAN}"))
    split = shelf.put(split, "split")
    sums = split.groupBy("source", "span").agg(F.sum("part").alias("sum"))
    sums = sums.select(F.col("source").alias("s"), F.col("span").alias("r"), F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("span").rowsBetween(_FIRST, -1)), F.lit(0.0)).alias("start"))
    within = F.coalesce(F.sum("part").over(Window.partitionBy("source", "span").orderBy("size").rowsBetween(_FIRST, -1)), F.lit(0.0))
    upto = split.withColumn("within", within).join(sums, _same(("source", "s"), ("span", "r")))
    begin = F.col("start") + F.col("within")
    extra = F.floor(begin + F.col("part") + 0.5 + 1e-9) - F.floor(begin + 0.5 + 1e-9)
    given = shelf.put(upto.select("source", "size", "n", "whole", F.least(F.greatest(extra, F.lit(0)), F.when(F.col("whole") < int(cap), F.col("n")).otherwise(0)).cast("long").alias("extra")), "rounded-0")
    for turn in range(1, rounds + 1):
        taken = given.groupBy("source").agg(F.sum(F.col("size") * (F.col("whole") * F.col("n") + F.col("extra"))).alias("taken"))
        gaps = wanted.select(F.col("source").alias("w"), "target").join(taken, _same(("w", "source"))).select("w", (F.round("target").cast("long") - F.col("taken")).alias("gap")).filter("gap != 0")
        held = F.col("whole") * F.col("n") + F.col("extra")
        if turn <= rounds - 2:
            room = F.when(F.col("gap") > 0, F.when(F.col("whole") < int(cap), F.col("n") - F.col("extra")).otherwise(0)).otherwise(F.col("extra"))
        else:
            room = F.when(F.col("gap") > 0, int(cap) * F.col("n") - held).otherwise(held)
        fit = F.expr("abs(gap) div size")
        asked = given.join(gaps, _same(("source", "w"))).withColumn("times", F.explode(F.array(F.least(room, fit), F.least(room, fit + 1))))
        left = F.abs(F.abs("gap") - F.col("times") * F.col("size"))
        best = asked.withColumn("left", left).filter("left < abs(gap)").groupBy("source").agg(F.min(F.struct("left", "times", "size", F.signum("gap").cast("long").alias("sign"))).alias("b"))
        flips = shelf.put(best.select(F.col("source").alias("s"), F.col("b.size").alias("z"), (F.col("b.times") * F.col("b.sign")).alias("more")), f"flips-{turn}")
        total = given.join(flips, _same(("source", "s"), ("size", "z")), "left").withColumn("total", held + F.coalesce("more", F.lit(0)))
        given = shelf.put(total.select("source", "size", "n", F.expr("total div n").alias("whole"), F.expr("total % n").alias("extra")), f"rounded-{turn}")
    return given


def _share(extra: str, n: str, of: str) -> Column:
    """extra * n / of, rounded down, in whole numbers of any size."""
    return F.expr(f"cast(cast({extra} AS decimal(20,0)) * ({n}) div {of} AS bigint)")


def copies(rows: DataFrame, shelf: Shelf, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """_k, doc_id, size, source, source_size, target, copies. ``rows`` has the row key, doc_id, source and text."""
    name = ("source", "size", "h", "doc_id")
    sized = shelf.put(rows.select(KEY, "doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("h")), "sized", free=True)
    lot = F.pmod("h", F.lit(LOTS)).cast("int").alias("lot")
    entries = shelf.put(sized.groupBy(*name).agg(F.count("*").alias("m")).select(*name, "m", lot), "entries")
    lots = shelf.put(entries.groupBy("source", "size", "lot").agg(F.sum("m").alias("n")), "lots")
    groups = shelf.put(lots.groupBy("source", "size").agg(F.sum("n").alias("n")), "groups")
    sources = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    wanted = shelf.put(targets(sources, shelf, weights, cap), "wanted")
    given = _extra(balance(groups.filter("size > 0"), wanted, shelf, cap), wanted, shelf, cap)
    # Extra copies go to a group's lots in proportion, by cumulative rounding, and within a lot in order of hash.
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("lot").rowsBetween(_FIRST, -1)), F.lit(0))
    placed = lots.withColumn("before", before).join(given.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("n").alias("all"), "whole", "extra"), _same(("source", "s"), ("size", "z")))
    more = _share("extra", "before + n", "all") - _share("extra", "before", "all")
    placed = shelf.put(placed.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("lot").alias("l"), "whole", more.alias("more")), "placed")
    ahead = F.coalesce(F.sum("m").over(Window.partitionBy("source", "size", "lot").orderBy("h", "doc_id").rowsBetween(_FIRST, -1)), F.lit(0))
    dealt = entries.filter("size > 0").withColumn("ahead", ahead).join(placed, _same(("source", "s"), ("size", "z"), ("lot", "l")))
    dealt = dealt.withColumn("some", F.least(F.greatest(F.col("more") - F.col("ahead"), F.lit(0)), F.col("m")))
    dealt = shelf.put(dealt.select(*(F.col(c).alias(f"e_{c}") for c in name), "whole", "m", "some"), "dealt")
    same = _same(*((c, f"e_{c}") for c in name))
    # Of equal rows some may get one more: at most one such entry in a lot. Their places in the scan are dealt to lots again.
    torn = sized.join(dealt.filter("some > 0 AND some < m"), same).withColumn("lot", F.pmod(F.xxhash64(KEY), F.lit(LOTS)).cast("int"))
    torn = shelf.put(torn.select(KEY, *name, "lot", "m", "some"), "torn")
    parts = torn.groupBy(*name, "lot", "m", "some").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*name).orderBy("lot").rowsBetween(_FIRST, -1)), F.lit(0)))
    parts = parts.select(*(F.col(c).alias(f"p_{c}") for c in (*name, "lot")), (_share("some", "before + n", "m") - _share("some", "before", "m")).alias("more"))
    ranked = torn.withColumn("rank", F.row_number().over(Window.partitionBy(*name, "lot").orderBy(KEY)))
    chosen = shelf.put(ranked.join(parts, _same(*((c, f"p_{c}") for c in (*name, "lot")))).filter("rank <= more").select(F.col(KEY).alias("chosen")), "chosen")
    joined = sized.join(dealt, same, "left").join(chosen, sized[KEY] == chosen["chosen"], "left")
    extra = F.when(F.col("some") == F.col("m"), 1).when(F.col("chosen").isNotNull(), 1).otherwise(0)
    counted = joined.select(KEY, "doc_id", "size", "source", F.coalesce(F.col("whole") + extra, F.lit(0)).cast("long").alias("copies"))
    ends = wanted.select(F.col("source").alias("s"), "source_size", "target")
    return counted.join(F.broadcast(ends) if _few(ends) else ends, _same(("source", "s"))).drop("s")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row."""
    shelf = Shelf(docs.sparkSession, "mixing")
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"), "mixing")
    return copies(rows, shelf, weights, cap).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """The rows of which the mix takes copies, with the columns given, how many copies, and the words they hold.

    Columns named copies or taken, in any case, are replaced.
    """
    shelf = Shelf(docs.sparkSession, "mixing")
    kept = docs.select(*(quoted(c) for c in docs.columns if c.lower() not in ("copies", "taken")))
    rows = keyed(boxed(kept, "doc_id", "source", "text"), "mixing")
    made = copies(rows.select(KEY, F.col("doc_id").cast("long").alias("doc_id"), "source", "text"), shelf, weights, cap).filter("copies > 0")
    counted = shelf.put(made.select(F.col(KEY).alias("held"), "copies", (F.col("copies") * F.col("size")).alias("taken")), "copies", free=True)
    return rows.select(KEY, BOX).join(counted.hint("shuffle_hash"), F.col(KEY) == F.col("held")).select(f"{BOX}.*", "copies", "taken")
