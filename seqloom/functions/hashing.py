"""Hashes that both engines compute alike, as column expressions."""

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\u001f"


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts."""
    text = F.concat_ws(SEPARATOR, *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def window_id(*parts: Column) -> Column:
    return F.concat(F.lit("W_"), F.md5(F.concat_ws(SEPARATOR, *[p.cast("string") for p in parts])))


def hash_split(key: Column, train: float = 0.70, validation: float = 0.15) -> Column:
    """train, validation or test by the hash of a key, so that a component never straddles splits."""
    u = hash_unit(key)
    return F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test")


def row_hash(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in columns]), 256)


def keyed_hash(*parts: Column, seed: int = 0, bits: int = 64) -> Column:
    """BLAKE2b of the parts as text, with the seed as salt, in big-endian bytes: the same in any process, made in Arrow batches. Null parts read None."""

    @F.pandas_udf("binary")
    def digests(texts: pd.Series) -> pd.Series:
        salt = seed.to_bytes(8, "big")
        return texts.map(lambda t: hashlib.blake2b(t.encode(), digest_size=bits // 8, salt=salt).digest())

    return digests(F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]))


def as_number(digest: Column) -> Column:
    """A digest of up to 64 bits as a whole number, in a decimal, as longs have a sign."""
    return F.conv(F.hex(digest), 16, 10).cast("decimal(20,0)")


def keyed_unit(*parts: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the first 64 bits."""
    return as_number(keyed_hash(*parts, seed=seed)).cast("double") / F.lit(float(1 << 64))
