"""Nucleotide strings as column expressions; all stay inside the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGU"


def to_rna(s: Column) -> Column:
    return F.translate(F.upper(s), "T", "U")


def reverse_complement(s: Column) -> Column:
    """Keeps the alphabet: RNA if there is a U, else DNA."""
    rna = F.reverse(F.translate(s, "ACGU", "UGCA"))
    return F.when(F.contains(s, F.lit("U")), rna).otherwise(F.reverse(F.translate(s, "ACGT", "TGCA")))


def orient(s: Column, strand: Column) -> Column:
    return F.when(strand == "-", reverse_complement(s)).otherwise(s)


def is_canonical(s: Column) -> Column:
    return ~s.rlike("[^ACGU]")


def base_count(s: Column, base: str) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(base), F.lit("")))).cast("long")


def gc(s: Column) -> Column:
    return (base_count(s, "G") + base_count(s, "C")) / F.length(s)


def slice_checked(s: Column, start: Column, end: Column) -> Column:
    """[start, end) in upper case; null where any of it is outside, or where it is empty."""
    inside = (start >= 0) & (end <= F.length(s)) & (end > start)
    return F.when(inside, F.upper(F.substr(s, (start + 1).cast("int"), (end - start).cast("int"))))


def kmers(s: Column, k: int) -> Column:
    """All overlapping k-mers in order; none for shorter strings."""
    return F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substr(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def dinucleotide_count(s: Column, pair: str) -> Column:
    return F.size(F.filter(kmers(s, 2), lambda x: x == pair)).cast("long")


def one_hot(s: Column) -> Column:
    return F.transform(F.split(s, ""), lambda c: F.array(*[(c == b).cast("int") for b in BASES]))
