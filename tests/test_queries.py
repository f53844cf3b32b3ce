"""Every query with SQL against DuckDB on the smallest tables, and the others against plain Python."""

import os
import zlib

import duckdb
import pytest

from strandlake.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    key = lambda r: [(x is None, str(x)) for x in r]
    got = sorted((tuple(map(plain, r)) for r in df.collect()), key=key)
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=key)


def test_crc32(spark):
    from strandlake.sources.fixtures import reads

    want = {r["read_id"]: zlib.crc32(r["seq"].encode()) for r in reads(spark, SF).collect()}
    assert {r["read_id"]: r["crc"] for r in QUERIES["crc32_seq"](spark, SF).collect()} == want


def test_bounded_blocks(spark):
    got = sorted(map(tuple, QUERIES["block_assign_bounded"](spark, SF).collect()))
    block = records = bases = 0
    for read, n, b in got:
        if records >= 700 or bases >= 30_000:
            block, records, bases = block + 1, 0, 0
        assert b == block
        records, bases = records + 1, bases + n


def test_blend_sums_to_one(spark):
    rows = QUERIES["ppm_blend"](spark, SF).groupBy("p1").agg({"p": "sum"}).collect()
    assert len(rows) > 3 and all(abs(r[1] - 1) < 1e-4 for r in rows)


def test_archive_stats(spark):
    from strandlake.sources.fixtures import reads

    row, whole = QUERIES["archive_stats"](spark, SF).first(), reads(spark, SF).collect()
    assert (row["records"], row["bases"], row["text_bytes"]) == (len(whole), sum(len(r["seq"]) for r in whole), sum(len(r["identifier"]) + 2 * len(r["seq"]) + 6 for r in whole))
    assert 0 < row["bits_per_base"] < 2.5 and row["ratio"] > 2
