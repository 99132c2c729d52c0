"""Fingerprints against one-process versions."""

import hashlib
import math
import random

import pytest
import xxhash
from test_corpus_operators import prose

from seqloom.llm import simhash


def words(text):
    return bytes(c if c not in b"\t\n\x0b\x0c\r" else 32 for c in text.encode()).split(b" ")


def fingerprint(text):
    parts = [w for w in words(text) if w]
    votes, n = [0] * 64, len(parts)
    for a, b in zip(parts, [*parts[1:], None]):
        h = xxhash.xxh64_intdigest(a, seed=42)
        h = h if b is None else xxhash.xxh64_intdigest(b, seed=h)
        for j in range(64):
            votes[j] += h >> j & 1
    return sum(1 << j for j in range(64) if 2 * votes[j] > n)


def like(a, b):
    return max(0.0, math.cos(math.pi * (a ^ b).bit_count() / 64))


def brute(rows, radius=3):
    """Rows in descending order of id, null last; repeated ids in the order given."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t or "" for _, t in order]
    prints, out = [fingerprint(t) for t in texts], []
    for at, (i, _) in enumerate(order):
        own, nxt = texts[at], texts[(at + 1) % len(texts)]
        part = len(own) // 3
        edited = own[: len(own) - part] + nxt[:part]
        other, following = fingerprint(edited), prints[(at + 1) % len(texts)]
        near = sum((prints[at] ^ p).bit_count() <= radius for p in prints) - 1 if i is not None and i % 50 == 0 else None
        out.append((i, len(own), hashlib.sha256(edited.encode()).hexdigest(), f"{prints[at]:016x}", f"{other:016x}", round(like(prints[at], other), 9), round(like(prints[at], following), 9), near))
    return sorted(out, key=str)


def rounded(df):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9), r[7]) for r in df.collect()), key=str)


def test_same_as_one_process(spark):
    rng = random.Random(9)
    texts = [prose(rng.randrange(1, 120), rng) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(200 + 50 * i, texts[0]) for i in range(6)] + [(600 + 50 * i, texts[3] + f" w{i}") for i in range(8)]
    rows += [(None, "none"), (150, None), (151, ""), (152, " \t\n"), (153, "wörd €uro 𝄞 x"), (154, "one"), (155, prose(6000, rng))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS at", "2 AS _k", "3 AS fingerprint", "4 AS part")
    got = rounded(simhash.fingerprinted(df.repartition(5)))
    assert got == brute(rows)
    assert any((r[7] or 0) > 3 for r in got)


def test_repeated_rows_and_small_tables(spark):
    schema = "doc_id long, text string"
    assert simhash.fingerprinted(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(1, "a b c d e f")], [(1, "a b c")] * 3, [(None, None), (None, None)]):
        assert rounded(simhash.fingerprinted(spark.createDataFrame(rows, schema).coalesce(1))) == brute(rows)


@pytest.mark.parametrize(("radius", "blocks"), [(3, 6), (0, 1), (2, 4), (5, 7)])
def test_tables_find_all_within_the_radius(spark, radius, blocks):
    rng = random.Random(radius)
    known = {rng.getrandbits(64) for _ in range(30)}
    known |= {x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(radius + 3))) for x in list(known) for _ in range(6)}
    known |= {0, 1 << 63, (1 << 64) - 1}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in known], "fingerprint long")
    got = sorted(map(tuple, simhash.near(df, df, radius, blocks).collect()))
    want = sorted((signed(a), signed(b), (a ^ b).bit_count()) for a in known for b in known if (a ^ b).bit_count() <= radius)
    assert got == want


def test_masks_need_more_blocks_than_bits():
    assert len(simhash.block_masks()) == 20
    with pytest.raises(ValueError):
        simhash.block_masks(4, 4)
