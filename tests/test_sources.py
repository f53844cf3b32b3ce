import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import dna, text
from strandlake.plans import codec
from strandlake.sources import fasta, fastq


def test_fasta_cases(spark, tmp_path):
    p = tmp_path / "a.fasta"
    p.write_bytes(b">r1 desc\nACGT\nNNAC\n\n>r2\nacgt\n>hdronly\n>r3\nTT\r\nGG\n>r4\n" + b"acgnnNR" * 30 + b"\n")
    got = [(r["record_no"], r["header"], r["sequence"], [tuple(a) for a in r["ambiguous"]]) for r in fasta.read_fasta(spark, str(p)).orderBy("record_no").collect()]
    assert got == [(0, "r1 desc", "ACGTAAAC", [(4, 2, "N")]), (1, "r2", "ACGT", []), (2, "r3", "TTGG", []), (3, "r4", "ACGAAAA" * 30, [x for i in range(30) for x in ((7 * i + 3, 2, "n"), (7 * i + 5, 1, "N"), (7 * i + 6, 1, "R"))])]
    fasta.write_fasta(fasta.read_fasta(spark, str(p)), str(tmp_path / "out"))
    again = fasta.read_fasta(spark, str(tmp_path / "out")).orderBy("record_no").collect()
    assert [(r["header"], r["sequence"], [tuple(a) for a in r["ambiguous"]]) for r in again] == [g[1:] for g in got]
    joined = fasta.sequence_only(fasta.read_fasta(spark, str(p))).orderBy("start").collect()
    assert "".join(r["sequence"] for r in joined) == "".join(g[2] for g in got) and [r["start"] for r in joined] == [0, 8, 12, 16]


@pytest.mark.parametrize(
    ("body", "problem"),
    [
        ("@r1\nACGT\n+\nIIII\n", None),
        ("@r2\nAC\n+r2\n@@\n", None),
        ("@r\n\n+\n\n", None),
        ("@r\r\nAC\r\n+\r\nII\r\n", None),
        ("r1\nACGT\n+\nIIII\n", "must start with @"),
        ("@r1\nACGT\nx\nIIII\n", "start with +"),
        ("@r1\nACGT\n", "cut off"),
        ("@r1\nACGT\n+\nIII\n", "4 bases but 3"),
        ("@r1\nACGT\n+\nIIII\n\n", "must start with @"),
        ("", None),
    ],
)
def test_fastq_cases(spark, tmp_path, body, problem):
    p = tmp_path / "a.fastq"
    p.write_bytes(body.encode())
    found = [r["problem"] for r in fastq.validate_fastq(spark, str(p)).collect()]
    assert (not found) if problem is None else problem in found[0]
    if problem:
        with pytest.raises(Exception, match="line"):
            fastq.read_fastq(spark, str(p)).collect()
    elif body:
        assert fastq.count_fastq(spark, str(p)) == 1


def test_four_group(spark):
    rows = spark.createDataFrame([("".join(k),) for k in itertools.product("ACGT", repeat=4)], "kmer string")
    assert rows.select(dna.canonical_v4("kmer").alias("c")).distinct().count() == 72
    assert rows.select(dna.canonical_rc("kmer").alias("c")).distinct().count() == 136
    assert rows.where(dna.canonical_v4(dna.canonical_v4("kmer")) != dna.canonical_v4("kmer")).count() == 0
    one = spark.createDataFrame([("GTT",)], "kmer string").select(dna.canonical_v4("kmer"), dna.canonical_transform("kmer"), dna.canonical_rc("kmer")).first()
    assert tuple(one) == ("AAC", "CR", "AAC")
    assert spark.range(1).select(dna.minimizer(F.lit("ACN"), 3).isNull()).first()[0]


def test_tokens(spark):
    got = spark.createDataFrame([("SRR001666.1",), ("007:08",)], "id string").select(text.tokens("id")).collect()
    assert [r[0] for r in got] == [["SRR001666", ".", "1"], ["007", ":", "08"]]


lines = st.text(alphabet="ACGTNRY", max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab0:.#/ ", max_size=12), lines, st.text(alphabet="I#F", max_size=40), st.sampled_from(["", "plus"])), min_size=1, max_size=20))
def test_block_round_trip(rows):
    columns = [list(c) for c in zip(*rows, strict=True)]
    assert codec.decode_block(*codec.encode_block(*columns)) == tuple(columns)


def test_block_all_ambiguous():
    columns = (["x"], ["NNNN"], ["IIII"], [""])
    assert codec.decode_block(*codec.encode_block(*columns)) == tuple(map(list, columns))


def test_symbols_shrink():
    symbols = np.random.default_rng(1).choice(4, 20_000, p=[0.85, 0.05, 0.05, 0.05])
    packed = codec.encode_symbols(symbols, 4, 1)
    assert len(packed) * 8 / len(symbols) < 1.1
    assert (codec.decode_symbols(codec.Reader(packed)) == symbols).all()


def test_damage_is_found(spark):
    rows = spark.createDataFrame([(0, 0, "a", "ACGT", "IIII", "")], "block_id long, record_no long, identifier string, seq string, qual string, plus_line string")
    bad = codec.encode_blocks(rows).withColumn("crc", F.col("crc") + 1)
    with pytest.raises(Exception, match="damaged"):
        codec.decode_blocks(bad).collect()


def test_command_line(spark, tmp_path, capsys):
    from strandlake.__main__ import main

    reads = "".join(f"@r{i}\nACGTN\n+{'x' if i % 2 else ''}\nIIFF#\n" for i in range(300))
    genome = ">chr1\n" + "ACGTNNacgR" * 8 + "\n>chr2\nGATTACA\n"
    for name, body, extra in (("a.fastq", reads, ["--mode", "adaptive", "-k", "12", "--block-size", "100", "--stats"]), ("b.fa", genome, [])):
        (tmp_path / name).write_text(body)
        assert main(["compress", *extra, str(tmp_path / name), str(tmp_path / f"{name}.arc")], spark) == 0
        assert main(["decompress", str(tmp_path / f"{name}.arc"), str(tmp_path / f"out-{name}")], spark) == 0
        assert main(["stats", str(tmp_path / f"{name}.arc")], spark) == 0
    assert "ratio" in capsys.readouterr().out
    text_of = lambda p: "".join(f.read_text() for f in sorted(p.glob("part-*")))
    assert text_of(tmp_path / "out-a.fastq") == reads
    assert text_of(tmp_path / "out-b.fa") == ">chr1\n" + "ACGTNNACGR" * 8 + "\n>chr2\nGATTACA\n"
    assert main(["validate", str(tmp_path / "a.fastq")], spark) == 0 and main(["validate", str(tmp_path / "b.fa")], spark) == 1
    assert main(["compress", "-k", "30", "x", "y"], spark) == 2 and main(["compress", "--block-size", "5", "x", "y"], spark) == 2


def test_fastq_files(spark, tmp_path):
    rows = [(i, f"r{i}", "ACGT", "p" if i % 2 else "", "IIII") for i in range(20)]
    fastq.write_fastq(spark.createDataFrame(rows, "record_no long, identifier string, sequence string, plus_line string, quality string"), str(tmp_path / "f"))
    assert sorted(map(tuple, fastq.read_fastq(spark, str(tmp_path / "f")).select("record_no", "identifier", "sequence", "plus_line", "quality").collect())) == rows


def test_scalars_and_sql_functions(spark):
    from strandlake.functions import numbers

    dna.register_sql(spark)
    assert tuple(spark.sql("select dna_complement('AACG'), dna_revcomp('AACG'), dna_canonical_v4('GTT'), dna_canonical_rc('GTT')").first()) == ("TTGC", "CGTT", "AAC", "AAC")
    one = spark.range(1).select(text.parse_number(F.lit("0042")), numbers.phred_char(numbers.phred(F.lit("I"))), numbers.inverse_sqrt(F.lit(4.0)), numbers.rescale(F.lit(9), F.lit(70_000)), numbers.rescale(F.lit(9), F.lit(70))).first()
    assert (int(one[0]), *one[1:]) == (42, "I", 0.5, 5, 9)
    assert [r[0] for r in spark.createDataFrame([("aabbbc",), ("",), ("é日日",)], "s string").select(text.run_structs("s")).collect()] == [[(0, 2, "a"), (2, 3, "b"), (5, 1, "c")], [], [(0, 1, "é"), (1, 2, "日")]]


def test_long_numbers_stay_text(spark):
    from strandlake.operators import identifiers

    rows = spark.createDataFrame([(1, "x" + "9" * 18), (2, "x:" + "1" * 19), (3, "x:007")], "r long, identifier string")
    tokens = identifiers.tokenize(rows, "r")
    assert {r["text"]: r["num"] for r in tokens.where("kind = 'NUMBER'").collect()} == {"007": 7}
    assert {r["r"]: r["identifier"] for r in identifiers.detokenize(tokens, "r").collect()} == {1: "x" + "9" * 18, 2: "x:" + "1" * 19, 3: "x:007"}


def test_dictionary_cut_ties_and_misses(spark):
    from strandlake.operators import identifiers

    rows = [(i, f"w{i % 30:02d}x:{'long' if i % 3 else 'rare' + str(i)}") for i in range(120)]
    rows = [(i, x.replace("x:", "x.")) for i, x in rows]
    tokens = identifiers.tokenize(spark.createDataFrame(rows, "r long, identifier string"), "r")
    words = identifiers.dictionary(tokens, 7)
    counts = {}
    for r in tokens.where("kind = 'LITERAL'").collect():
        counts[r["text"]] = counts.get(r["text"], 0) + 1
    want = sorted((t for t, n in counts.items() if n >= 2), key=lambda t: (-counts[t] * len(t), t))[:7]
    assert [r["text"] for r in words.orderBy("idx").collect()] == want
    coded = identifiers.encode(tokens, words)
    assert {r["text"] for r in coded.where("kind = 'LITERAL' and idx is null").collect()} == set(counts) - set(want)
    assert {r["text"] for r in identifiers.decode(coded.where("idx is not null"), words).collect()} == set(want)


def test_stream_of_reads(spark, tmp_path):
    from strandlake.operators.kmers import spectrum
    from strandlake.streaming.reads import SCHEMA, running_spectrum, stream_reads

    reads = spark.createDataFrame([(i, f"r{i}", "ACGTTGCA"[i % 5 :] * 3, "I" * 8) for i in range(40)], SCHEMA)
    reads.repartition(4).write.parquet(str(tmp_path / "in"))
    query = running_spectrum(stream_reads(spark, str(tmp_path / "in"), 1), 4).writeStream.outputMode("complete").format("memory").queryName("kmers").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("kmers").collect())) == sorted(map(tuple, spectrum(reads, 4, "v4").collect()))


def test_chunked_blocks(spark):
    from strandlake.operators import blocks

    lengths = np.random.default_rng(2).integers(0, 90, 1000).tolist()
    rows = spark.createDataFrame(list(enumerate(lengths)), "r long, n int").repartition(5)
    got = {x["r"]: x["block_id"] for x in blocks.bounded_blocks(rows, "r", "n", 30, 1000, chunk=250).collect()}
    block = records = bases = 0
    for i, n in enumerate(lengths):
        if i % 250 == 0:
            block, records, bases = (i // 250) << 32, 0, 0
        elif records >= 30 or bases >= 1000:
            block, records, bases = block + 1, 0, 0
        assert got[i] == block
        records, bases = records + 1, bases + n


def test_stretches_of_earlier_occurrences(spark):
    from strandlake.operators.repeats import previous_occurrences

    rng = np.random.default_rng(5)
    reads = spark.createDataFrame([(i, "".join(rng.choice([*"ACGT"], rng.integers(3, 12)))) for i in range(120)], "read_id long, seq string")
    wide, narrow = (sorted(map(str, previous_occurrences(reads, 2, "read_id", span=n).collect())) for n in (10**6, 3))
    assert wide == narrow and len(wide) > 300
