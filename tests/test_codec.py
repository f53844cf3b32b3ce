"""Streams, blocks, records and archives round-trip; damage is an error; the adaptive model finds repeats."""

import numpy as np
import pytest

from strandlake.plans import adaptive, codec
from strandlake.plans.codec import (Options, Reader, archive, archive_fasta, archive_report, decode_block, decode_blocks, decode_fasta, decode_identifiers, decode_qualities, decode_record, decode_symbols, encode_block, encode_identifiers, encode_qualities, encode_record, encode_symbols, read_archive, read_bytes, report_text, shares, write_archive)

RNG = np.random.default_rng(9)


@pytest.mark.parametrize("n", [0, 1, 7, 3000, 20_000])
@pytest.mark.parametrize("size,order,sides", [(1, 0, 1), (4, 0, 1), (4, 3, 1), (4, 8, 1), (40, 2, 8), (256, 1, 1), (5, 0, 8)])
def test_symbols(n, size, order, sides):
    side = RNG.integers(0, sides, n)
    x = np.minimum(size - 1, (RNG.geometric(0.4, n) - 1 + side) // 1)
    x[n // 2 :] = x[: n - n // 2]
    data = encode_symbols(x, size, order, side if sides > 1 else None, sides)
    assert (decode_symbols(Reader(data), side if sides > 1 else None) == x).all()
    if n == 20_000 and size == 40:
        assert len(data) < len(encode_symbols(x, size, 0))


def test_shares():
    assert shares(np.zeros(3, int), 10).tolist() == [3, 3, 4] and shares(np.array([1, 0, 10**9]), 16).tolist() == [1, 0, 15]


IDS = [
    [f"RUN7:{i % 4}:{1000 + i % 97}:{i}#0/1" for i in range(500)],
    [f"{w}.{i:06d} x" for i in range(300) for w in ("SRR1", "ERR22")],
    ["123456789012345678901234567890", "12345678901234567890", "000000000000000001", "0", "00", "", "é٣ 7", "a\x01b"],
    ["", "", ""],
    ["same"] * 40,
    [str(10**18 - 1), str(10**18), "9" * 18, "0" * 18 + "1"] * 5,
    [],
]


@pytest.mark.parametrize("ids", IDS)
def test_identifiers(ids):
    assert decode_identifiers(encode_identifiers(ids), len(ids)) == ids


def test_numbered_identifiers_are_small():
    assert len(encode_identifiers(IDS[0])) * 10 < sum(map(len, IDS[0]))


QUALS = [["IIIIFFFF", "", "I" * 400, "#,:F", "FFFF"], ["I" * 31, "I" * 32, "I" * 62, "I" * 63], ["日本", "II"], [], ["", ""], ["!~" * 50] * 30]


@pytest.mark.parametrize("quals", QUALS)
def test_qualities(quals):
    assert decode_qualities(encode_qualities(quals), [len(q) for q in quals]) == quals


@pytest.mark.parametrize("mode", codec.MODES)
def test_block(mode):
    seqs = ["".join(RNG.choice([*"ACGTN"], 300)) for _ in range(20)] + ["", "N" * 50, "acgtn", "ACGT", "RYK-*é"]
    rows = [f"r{i}" for i in range(len(seqs))], seqs, ["".join(RNG.choice([*"IF:#"], len(s))) for s in seqs], ["" if i % 3 else f"plus {i}" for i in range(len(seqs))]
    assert decode_block(*encode_block(*rows, mode)) == tuple(rows)
    assert decode_block(*encode_block([], [], [], [], mode)) == ([], [], [], [])


@pytest.mark.parametrize("mode", codec.MODES)
@pytest.mark.parametrize("sequence", ["", "A", "ACGT" * 16, "ACGT" * 16 + "N", "N", "acgu" * 100, "GATTACA" * 900])
def test_single_records(mode, sequence):
    data = encode_record("a header", sequence, Options(mode))
    assert decode_record(data) == ("a header", sequence)
    if sequence == "ACGT" * 16:  # two bits a base
        assert len(codec.encode_bases(np.tile(np.arange(4), 16), mode, 8)) == 2 + 16 and len(data) < len(sequence)
    for i in (0, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            decode_record(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])
    with pytest.raises(ValueError):
        decode_record(data[:-3])


def genome(n, inverted):
    g = RNG.integers(0, 4, n)
    half = g[: n // 2].copy()
    half[RNG.random(n // 2) < 0.03] = 0
    g[n - n // 2 :] = 3 - half[::-1] if inverted else half
    return g


@pytest.mark.parametrize("inverted", [False, True])
def test_adaptive_finds_copies(inverted):
    g = genome(30_000, inverted)
    data = adaptive.encode_bases(g)
    assert (adaptive.decode_bases(data, len(g)) == g).all()
    assert 8 * len(data) / len(g) < 1.6 < 8 * len(encode_symbols(g, 4, 3)) / len(g)


def test_adaptive_parts():
    counts = np.array([[9, 8, 0, 0], [600, 500, 1, 0]])
    adaptive.forget(counts, np.array([0, 1, 1]), 1024)
    assert counts.tolist() == [[9, 8, 0, 0], [300, 250, 0, 0]]
    p = np.array([[0.7], [0.1], [0.1], [0.1]])
    assert np.allclose(adaptive.symmetric(p)[:, 0], [0.685, 0.1, 0.1, 0.115]) and adaptive.quantised(p).sum() == adaptive.TOTAL and adaptive.quantised(np.array([[1.0], [0], [0], [0]])).min() == 1
    mixer = adaptive.Mixer(2, 1, 1, 0.02)
    inputs, ctx = np.array([[[0.7], [0.1], [0.1], [0.1]], [[0.25]] * 4]), np.zeros(1, int)
    for _ in range(50):
        mixer.mix(inputs, ctx)
        mixer.learn(inputs[:, 0, :])
    assert mixer.mix(inputs, ctx)[0, 0] > 0.68
    calibration = adaptive.Calibration(1)
    ranked = np.array([[0.9], [0.04], [0.03], [0.03]])
    for i in range(400):
        calibration.refine(ranked, ctx)
        calibration.learn(np.array([i % 2]))
    assert abs(calibration.refine(ranked, ctx)[0, 0] - 0.5) < 0.05


@pytest.mark.parametrize("bad", [{"order": 1}, {"order": 21}, {"block_size": 99}, {"block_size": 1_000_001}, {"mode": "x"}, {"block_bases": 0}])
def test_options(bad):
    with pytest.raises(ValueError):
        Options(**bad)


def test_archives(spark, tmp_path):
    rows = [(i, f"r{i}", "ACGTNacg" * (i % 9), "IIFF##:," * (i % 9), "" if i % 5 else "p") for i in range(450)] + [(450, "long", "GATTACA" * 3000, "I" * 21_000, "")]
    reads = spark.createDataFrame(rows, "record_no long, identifier string, seq string, qual string, plus_line string").repartition(3).sortWithinPartitions("record_no")
    path = str(tmp_path / "a")
    write_archive(reads, path, block=None, options=Options(block_size=100, block_bases=5000))
    assert sorted(map(tuple, read_archive(spark, path).select(*reads.columns).collect())) == rows
    stored = spark.read.parquet(path)
    assert stored.agg({"records": "max"}).first()[0] <= 100 and "bits_per_base: " in report_text(stored)
    assert archive_report(stored).first()["bases"] == sum(len(r[2]) for r in rows)
    pieces = archive(reads, piece=2000)
    assert sorted(map(tuple, decode_blocks(pieces).select(*reads.columns).collect())) == rows
    files = read_bytes(spark, path + "/*.parquet").collect()
    assert files and all(f["length"] == len(f["content"]) for f in files)
    with pytest.raises(Exception, match="damaged"):
        decode_blocks(stored.selectExpr(*[c if c != "meta" else "concat(meta, x'00') as meta" for c in stored.columns])).collect()
    assert decode_blocks(archive(reads.where("false"))).collect() == []


@pytest.mark.parametrize("mode", codec.MODES)
def test_fasta_archive(spark, mode):
    rows = [(0, "chr1 test", "ACGTN" * 3000), (1, "", "nnnnACGT"), (2, "chr2", "RYSW" * 100 + "G" * 500)]
    records = spark.createDataFrame(rows, "record_no long, header string, sequence string")
    assert sorted(map(tuple, decode_fasta(archive_fasta(records, Options(mode), piece=1500)).collect())) == rows
