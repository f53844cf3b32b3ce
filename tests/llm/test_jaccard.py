"""The near-duplicate join against all pairs, under plans with and without hot keys; components and the skew-safe join."""

import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandlake.llm.common import skew_join
from strandlake.llm.components import components
from strandlake.llm.ngram_jaccard import Paths, ngram_jaccard_join


def shingle_set(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return frozenset(zip(*[w[j:] for j in range(k)], strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(texts):
    """For each row: smallest row with the same set, smallest row of its group, number of links, size of the set."""
    sets = [shingle_set(t) for t in texts]
    n = len(sets)
    near = [[j for j in range(n) if j != i and x and 5 * len(x & sets[j]) >= 4 * len(x | sets[j])] for i, x in enumerate(sets)]
    group = list(range(n))
    for i in range(n):
        for j in near[i]:
            a, b = sorted((group[i], group[j]))
            group = [a if g == b else g for g in group]
    return {i: (min([i, *(j for j in near[i] if sets[j] == sets[i])]), group[i], len(near[i]), len(sets[i])) for i in range(n)}


def texts():
    rng = np.random.default_rng(4)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 120)) for _ in range(6)]
    out = [None, "", "one", "one", "one two", " \n", *base, *[base[0]] * 5, *[base[1].replace(" ", "\n")] * 2]
    for b in base:
        for k in (1, 2, 4, 8):
            w = b.split()
            for j in rng.choice(len(w), k, replace=False):
                w[j] = "edit"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("paths,hot", [(Paths(), 1000), (Paths(bucket=2, block=2), 1)])
def test_against_all_pairs(spark, paths, hot):
    rows = texts()
    docs = spark.createDataFrame([(i, t, 1, "x", True, 0) for i, t in enumerate(rows)], "doc_id long, text string, n int, digest string, kept boolean, group_id int").repartition(3)
    got = {r["doc_id"]: r for r in ngram_jaccard_join(docs, paths=paths, hot_rows=hot).collect()}
    want = brute(rows)
    assert {i: (r["class_id"], r["group_id"], r["n_links"], r["n_shingles"]) for i, r in got.items()} == want
    assert {i for i, r in got.items() if r["kept"]} == {g for _, g, _, _ in want.values()}


def test_recall_over_the_fixture(spark):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = {table[i]["doc_id"]: w for i, w in brute([r["text"] for r in table]).items()}
    got = {r["doc_id"]: r["n_links"] for r in ngram_jaccard_join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    assert got == {i: w[2] for i, w in want.items()}


def test_null_ids_repeated_rows_and_empty_tables(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = spark.createDataFrame([(None, a), (None, a), (3, a + " more"), (7, b), (7, b)], "doc_id long, text string")
    got = ngram_jaccard_join(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_links"]) for r in got) == [(0, 2), (0, 2), (3, 2), (7, 1), (7, 1)]
    assert sum(r["kept"] for r in got) == 2 and [r["kept"] for r in got if r["doc_id"] == 3] == [True]
    assert ngram_jaccard_join(docs.where("false")).collect() == []


@pytest.mark.parametrize("most_broadcast,hot", [(10**6, 1000), (0, 2), (2, 2), (0, 10**6)])
def test_components_of_hubs_and_chains(spark, most_broadcast, hot):
    edges = [(500 + i, 499) for i in range(60)] + [(i, i + 1) for i in range(40)] + [(900, 900), (901, 900), (901, 900)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), hot_rows=hot, most_broadcast=most_broadcast).collect()))
    want = {499 + i: 499 for i in range(61)} | dict.fromkeys(range(41), 0) | {900: 900, 901: 900}
    assert got == want


@pytest.mark.parametrize("most_broadcast", [0, 10**6])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join(spark, how, most_broadcast):
    rows = [(k, i) for k, n in ((1, 50), (2, 3), (3, 40), (4, 1)) for i in range(n)] + [(None, 7)]
    left, right = spark.createDataFrame(rows, "k long, i long"), spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "k long, v string")
    got = Counter(map(tuple, skew_join(left, right, "k", how, hot_rows=5, most_broadcast=most_broadcast, salts=4).collect()))
    assert got == Counter(map(tuple, left.join(right, "k", how).collect()))
    assert skew_join(left.where(F.lit(False)), right, "k", how).count() == 0
