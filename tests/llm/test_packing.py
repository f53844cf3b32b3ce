"""Best-fit packing: pieces against the tokenizers library, every constraint, and few sequences."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandlake.llm.packing import Capacity, best_fit_pack, cut_pieces, vector_best_fit

PATH = public_tokenizers.path("byte_bpe_50k.json")
PROSE = "The river runs past the old mill, and nobody in the village remembers who built it or why. "
TEXTS = [None, "", " \n", "a b", PROSE, PROSE, PROSE * 400, "x\x01\x02!", "é" * 3000, "a " * 2046, "a " * 2047, "a " * 4095]


def expected():
    library = Tokenizer.from_file(PATH)
    out = {}
    for i, t in enumerate(TEXTS):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for j, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out[i, j] = (lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes()))
    return out


def test_pieces_and_places(spark):
    docs = spark.createDataFrame([(i, t, 7, 8, 9) for i, t in enumerate(TEXTS)], "doc_id long, text string, sequence_id int, offset int, length int").repartition(3)
    rows = best_fit_pack(cut_pieces(docs, PATH)).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected()
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == np.cumsum([0, *(n for _, n in sorted(b))])[:-1].tolist()
        assert sum(n for _, n in b) <= 2048
    assert len(bins) == -(-sum(r["length"] for r in rows) // 2048)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (1, None)], "doc_id long, text string")
    rows = best_fit_pack(cut_pieces(docs, PATH)).collect()
    assert len(rows) == 4 and sorted(r["offset"] for r in rows) == [0, 3, 6, 7]
    assert best_fit_pack(cut_pieces(docs.where("false"), PATH)).collect() == []


@pytest.mark.parametrize("capacity", [Capacity(), Capacity(documents=4), Capacity(score="dot"), Capacity(documents=None, attention=None), Capacity(documents=9, attention=2048**2 // 2, score="dot")])
def test_best_fit(capacity):
    lengths = np.random.default_rng(2).integers(1, 1449, 3000)
    u, c = np.unique(lengths, return_counts=True)
    runs, n = vector_best_fit(u, c, capacity)
    load = defaultdict(list)
    for length, lo, hi, first, q, offset in runs.tolist():
        for r in range(hi - lo):
            load[first + r // q].append(length)
    assert sorted(x for b in load.values() for x in b) == sorted(lengths.tolist())
    assert len(load) == n and all(sum(b) <= 2048 and len(b) <= (capacity.documents or 2048) for b in load.values())
    assert all(sum(x * x for x in b) <= (capacity.attention or 2048**2) for b in load.values())
    if capacity.documents in (None, 2048):
        assert n <= 1.01 * lengths.sum() / 2048 + 1


def test_capacities_beside_tokens_choose_the_bin():
    """Bins of equal free tokens: the piece goes where less attention is left; without weights for it, to the first."""
    lengths, counts = np.array([1200, 600, 100]), np.array([1, 2, 1])

    def beside(attention):
        runs, _ = vector_best_fit(lengths, counts, Capacity(tokens=1300, documents=3, attention=attention))
        where = {}
        for length, lo, hi, first, q, _ in runs.tolist():
            for r in range(hi - lo):
                where.setdefault(first + r // q, []).append(length)
        return sorted(map(sorted, where.values()))

    assert beside(1300**2) == [[100, 1200], [600, 600]]
    assert beside(1200**2) == [[100, 600, 600], [1200]]


def test_too_long_or_missing_lengths_are_errors(spark):
    with pytest.raises(ValueError):
        vector_best_fit(np.array([2049]), np.array([1]))
    with pytest.raises(ValueError):
        best_fit_pack(spark.createDataFrame([(1, None)], "doc_id long, length long")).collect()
