"""The source of genomic text: gzip by content, byte ranges, filters, contigs in linear time."""

import gzip
import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from seqloom.functions import hashing
from seqloom.sources import genomic, readers

GTF = "#comment\n" + "".join(
    f'chr{1 + i % 3}\tx\t{kind}\t{10 * i + 1}\t{10 * i + 9}\t.\t+\t.\tgene_id "g{i}.2"; gene_type "{"coding" if i % 2 else "other"}"; gene_name "n{i}";\n' for i in range(40) for kind in ("gene", "transcript", "exon")
)
PEAKS = "track name=x\n" + "".join(f"{'chr' if i % 4 else 'un'}{i % 3}\t{i}\t{i + 5}\tp{i}\t1\t.\t2.5\t1\t1\t3\n" for i in range(50)) + "chr1\tbad\t7\tp\nchr2\n\n"


@pytest.fixture(params=["plain.gz", "packed.txt"])
def write(tmp_path, request):
    def put(name, text):
        path = tmp_path / f"{name}-{request.param}"
        path.write_bytes(gzip.compress(text.encode()) if request.param.startswith("packed") else text.encode())
        return str(path)

    return put


@pytest.mark.parametrize("size", [37, 1 << 20])
def test_tables(spark, write, size):
    gtf, peaks = write("gtf", GTF), write("peaks", PEAKS)
    lines = [x.split("\t") for x in GTF.splitlines() if x[0] != "#"]
    got = sorted(genomic.table(spark, gtf, range=size).collect(), key=lambda r: r.at)
    assert [r.fields for r in got] == lines
    genes = genomic.genes(spark, gtf, ["coding"], range=size)
    assert sorted((r.gene_id, r.feature, r.start) for r in genes.collect()) == sorted((f"g{i}.2", k, 10 * i) for i in range(1, 40, 2) for k in ("gene", "exon"))
    assert genomic.genes(spark, gtf, range=size).count() == 80
    got = genomic.peaks(spark, peaks, range=size)
    assert sorted((r.chrom, r.start, r.signal, r.summit_offset) for r in got.collect()) == sorted((f"chr{i % 3}", i, 2.5, 3) for i in range(50) if i % 4)
    assert {r.chrom for r in genomic.peaks(spark, peaks, ["chr1"], range=size).collect()} == {"chr1"}


def test_filters_reach_the_source(spark, write):
    rows = genomic.table(spark, write("gtf", GTF)).filter((F.col("chrom") == "chr2") & F.col("feature").isin("gene", "exon") & (F.size("fields") > 3))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "chr2" not in plan.split("RelationV2")[0] and rows.count() == 26


def test_a_folder(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for i in range(3):
        (tmp_path / "d" / f"f{i}").write_text(f"chr{i}\t1\t2\n")
    (tmp_path / "d" / "_SUCCESS").write_text("")
    assert sorted(r.chrom for r in genomic.table(spark, str(tmp_path / "d")).collect()) == ["chr0", "chr1", "chr2"]
    assert genomic.table(spark, f"file://{tmp_path}/d").count() == 3


@pytest.mark.parametrize(("size", "piece"), [(50, 16), (1 << 20, 1 << 16)])
def test_contigs(spark, write, size, piece):
    rng = random.Random(4)
    contigs = {name: "".join(rng.choice("ACGTn") for _ in range(n)) for name, n in (("chr1", 700), ("chr2", 0), ("chr3", 32), ("chr4", 333))}
    text = "junk\n" + "".join(f">{name} about it\n" + "".join(f"{s[i : i + 60]}\r\n" for i in range(0, len(s), 60)) for name, s in contigs.items())
    chunks = genomic.contig_chunks(spark, write("fa", text), 32, range=size, piece=piece)
    rows = chunks.collect()
    for name, s in contigs.items():
        own = sorted((r.bin, r.start, r.sequence) for r in rows if r.contig == name)
        assert own == [(i // 32, i, s[i : i + 32].upper()) for i in range(0, len(s), 32)]
    wanted = spark.createDataFrame([(1, "chr1", 30, 130), (2, "chr1", 690, 701), (3, "chr3", 0, 32), (4, "no", 0, 3)], "id long, contig string, start long, end long")
    got = {r.id: r.sequence for r in readers.fetch(chunks, wanted, 32).collect()}
    assert got == {1: contigs["chr1"][30:130].upper(), 2: None, 3: contigs["chr3"].upper(), 4: None}


def test_a_long_contig_takes_linear_time(spark, tmp_path):
    times = []
    for mb in (16, 64):
        path = tmp_path / f"{mb}.fa"
        line = b"ACGTTGCAAC" * 6 + b"\n"
        path.write_bytes(b">chr1\n" + line * (mb * 1024 * 1024 // 61))
        began = time.time()
        row = genomic.contig_chunks(spark, str(path), range=8 << 20).agg(F.sum(F.length("sequence")).alias("n"), F.count("*").alias("chunks")).first()
        times.append(time.time() - began)
        assert row.n == mb * 1024 * 1024 // 61 * 60
    assert times[1] < 4 * times[0] + 10


def test_keyed_hash(spark):
    df = spark.createDataFrame([("chr1", 5), ("", 0), (None, 7)], "a string, b long")
    rows = df.select(hashing.as_number(hashing.keyed_hash(F.col("a"), F.col("b"))).alias("x"), hashing.as_number(hashing.keyed_hash(F.col("a"), F.col("b"), seed=17, bits=32)).alias("y"), hashing.keyed_unit(F.col("a"), F.col("b"), seed=3).alias("u")).collect()
    number = lambda a, b, seed, bits: int.from_bytes(hashlib.blake2b(f"{a}\x1f{b}".encode(), digest_size=bits // 8, salt=seed.to_bytes(8, "big")).digest(), "big")
    want = [("chr1", 5), ("", 0), ("None", 7)]
    assert [(int(r.x), int(r.y)) for r in rows] == [(number(a, b, 0, 64), number(a, b, 17, 32)) for a, b in want]
    assert [r.u for r in rows] == pytest.approx([number(a, b, 3, 64) / 2**64 for a, b in want], rel=1e-15)
