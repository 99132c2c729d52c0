"""Weights of the balanced condition as one operation: strata, merges of sparse ones, common support, weights, and their check.

What is decided is decided on counts by stratum: contexts (those known from training, and
'other') times bins, a table that does not grow with the rows. Decisions go back to the rows as a broadcast table of
that size. Rows of strata that are dropped stay, with weight 1 and ``kept`` false.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .weights import balanced, bin_of, known_or_other, standard

STEPS = 12


@dataclass(frozen=True)
class Limits:
    """Least support of a stratum, ceiling of a weight, and what the check asks for."""

    positives: int = 20
    backgrounds: int = 20
    clip: float = 5.0
    ess: float = 0.5
    smd: float = 0.1
    context: float = 0.02


def merge_plan(counts: dict[tuple[str, int, int], tuple[int, int]], positives: int, backgrounds: int, steps: int = STEPS) -> dict[tuple[str, int, int], tuple[str, int, int] | None]:
    """Where each stratum (context, q, t) with its positives and backgrounds goes; None: out.

    One at a time, the stratum with the fewest positives (then backgrounds, then by name) that lacks support joins the
    next lower q, or at q 0 the next lower t, of its context, whether that is held or not. It goes out at the lowest of both, and where its
    whole context lacks support. After ``steps`` changes what is left stays as it is.
    """
    name = lambda k: f"{k[0]}|q{k[1]}|t{k[2]}"
    goes: dict[tuple[str, int, int], tuple[str, int, int] | None] = {k: k for k in counts}
    held = dict(counts)
    for _ in range(steps):
        poor = [k for k, (p, b) in held.items() if p < positives or b < backgrounds]
        if not poor:
            break
        worst = min(poor, key=lambda k: (*held[k], name(k)))
        context, q, t = worst
        whole = [sum(v[i] for k, v in held.items() if k[0] == context) for i in (0, 1)]
        to = None
        if whole[0] >= positives and whole[1] >= backgrounds:
            to = (context, q - 1, t) if q else (context, q, t - 1) if t else None
        p, b = held.pop(worst)
        if to:
            there = held.get(to, (0, 0))
            held[to] = (there[0] + p, there[1] + b)
        goes = {k: to if v == worst else v for k, v in goes.items()}
    return goes


def strata(df: DataFrame, gc_edges: list[float], tpm_edges: list[float], contexts: list[str]) -> DataFrame:
    """Adds ctx, q, t: context ('other' where unknown) and right-closed bins of gc and log1p_tpm; null where one of these is."""
    known = known_or_other(F.col("context"), F.col("context").isin(*contexts))
    edges = lambda c, cuts: F.when(F.col(c).isNotNull(), bin_of(F.col(c), [F.lit(e) for e in cuts]))
    return df.withColumn("ctx", known).withColumn("q", edges("gc", gc_edges)).withColumn("t", edges("log1p_tpm", tpm_edges))


def _smd(x: Column) -> list[Column]:
    """Weight, first and second moment by class."""
    own = lambda y, v: F.sum(F.when(F.col("label") == y, F.col("w") * v))
    return [own(y, v) for y in (1, 0) for v in (F.lit(1.0), x, x * x)]


def _gap(sums: list[float]) -> float | None:
    """The standardised difference of weighted means, with variances by total weight less one, pooled."""
    (a, sa, qa), (b, sb, qb) = sums[:3], sums[3:]
    if None in sums or a <= 1 or b <= 1:
        return None
    spread = lambda w, s, q: (q / w - (s / w) ** 2) * w / (w - 1)
    pooled = ((spread(a, sa, qa) + spread(b, sb, qb)) / 2) ** 0.5
    return (sa / a - sb / b) / pooled if pooled > 0 else 0.0


def checked(df: DataFrame, limits: Limits = Limits(), residual: tuple[str, ...] = ()) -> dict[str, object]:
    """Effective sample size, balance of gc, log1p_tpm and context, whether all are within the limits, and the balance of further columns, which decides nothing."""
    names = ["gc", "log1p_tpm", *residual]
    parts = [c.alias(f"m{i}_{j}") for i, n in enumerate(names) for j, c in enumerate(_smd(F.col(n).cast("double")))]
    row = df.agg(F.count("*").alias("n"), F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("ss"), *parts).first()
    gaps = {n: _gap([row[f"m{i}_{j}"] for j in range(6)]) for i, n in enumerate(names)}
    own = lambda y: F.sum(F.when(F.col("label") == y, F.col("w")).otherwise(0.0))
    # A row for each context: those known, and 'other'.
    shares = df.groupBy("ctx").agg(own(1).alias("p"), own(0).alias("b")).collect()
    total = [sum(r[c] for r in shares) for c in ("p", "b")]
    context = max((abs(r.p / total[0] - r.b / total[1]) for r in shares), default=None) if all(total) else None
    ess = row.s**2 / row.ss / row.n if row.n and row.ss else None
    within = lambda x, most: x is not None and abs(x) <= most
    passed = {"ess": ess is not None and ess >= limits.ess, "gc": within(gaps["gc"], limits.smd), "log1p_tpm": within(gaps["log1p_tpm"], limits.smd), "context": within(context, limits.context)}
    return {"rows": row.n, "ess": ess, "smd": {n: gaps[n] for n in ("gc", "log1p_tpm")}, "context": context, "passed": passed, "all_passed": all(passed.values()), "residual": {n: gaps[n] for n in residual}}


def weighted(df: DataFrame, gc_edges: list[float], tpm_edges: list[float], contexts: list[str], limits: Limits = Limits(), residual: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, dict[str, object]]:
    """Training rows (label, gc, log1p_tpm, context) with stratum, kept, w0 and w1; the table of strata and where they went; the check of w1 on the rows kept.

    w0 is by class, w1 by class within strata, each with mean one (w1 over the rows kept).
    """
    spark = df.sparkSession
    rows = strata(standard(df).withColumnRenamed("w", "w0"), gc_edges, tpm_edges, contexts)
    counted = rows.filter("q IS NOT NULL AND t IS NOT NULL").groupBy("ctx", "q", "t").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("b")).collect()
    plan = merge_plan({(r.ctx, r.q, r.t): (r.p, r.b) for r in counted}, limits.positives, limits.backgrounds)
    text = lambda k: None if k is None else f"{k[0]}|q{k[1]}|t{k[2]}"
    mapping = spark.createDataFrame([(*k, text(k), text(v)) for k, v in sorted(plan.items())], "ctx string, q int, t int, stratum string, becomes string")
    moved = rows.join(F.broadcast(mapping.select("ctx", "q", "t", F.col("becomes").alias("stratum"))), ["ctx", "q", "t"], "left")
    of = lambda f, y, c: f(F.when(F.col("label") == y, F.col(c)))
    apart = lambda c: (of(F.max, 1, c) < of(F.min, 0, c)) | (of(F.max, 0, c) < of(F.min, 1, c))
    ranges = moved.filter("stratum IS NOT NULL").groupBy("stratum").agg(F.coalesce(apart("gc") | apart("log1p_tpm"), F.lit(False)).alias("apart"))
    marked = moved.join(F.broadcast(ranges), "stratum", "left").withColumn("kept", F.col("stratum").isNotNull() & ~F.coalesce("apart", F.lit(False)))
    w1 = balanced(marked.filter("kept"), clip=limits.clip)
    qc = checked(w1, limits, residual)
    whole = w1.withColumnRenamed("w", "w1").unionByName(marked.filter("NOT kept").withColumn("w1", F.lit(1.0)))
    fate = mapping.join(F.broadcast(ranges), mapping["becomes"] == ranges["stratum"], "left").select(mapping["stratum"], "becomes", F.coalesce("apart", F.lit(False)).alias("no_common_support"))
    return whole.drop("apart", "q", "t"), fate, qc
