"""Removal of repeated strings against a set of all strings seen before."""

import hashlib

import numpy as np
import pytest

from strandlake.llm import common
from strandlake.llm import suffix_dedup as module
from strandlake.llm.suffix_dedup import repeated_spans, suffix_dedup


def brute(rows):
    """(id, bytes, removed, runs, digest, what is left) of rows (id, text), strings of 100 bytes being judged in order of id and start."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), (bytes(1) + bytes(gone)).count(b"\0\1"), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    return out


def made():
    rng = np.random.default_rng(3)
    base = "".join(chr(97 + x % 26) for x in rng.integers(0, 1000, 700).tolist())
    texts = [base, "zz" + base[100:400] + "yy" + base[350:600], None, "", base[:99], base[:100], "ab" * 300, "é" * 400, base, base[200:300] * 2, "x" * 3000, "abc" * 900, "ab" * 301 + "q"]
    line = "The river runs past the old mill, and nobody in the village remembers who built it or why. " * 2
    texts += [f"{i * 7919:050d}" + line + f"{i * 104729:050d}" for i in range(60)]
    words = ["".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(30)]
    parts = [" ".join(words[x] for x in rng.integers(0, 30, 25)) for _ in range(12)]
    texts += [" ".join(parts[x][int(rng.integers(0, 30)) :] for x in rng.integers(0, 12, 4)) for _ in range(60)]
    texts += [base * 40 + f"{i}" + line for i in range(2)]
    return list(enumerate(texts))


@pytest.mark.parametrize("hot,group_bytes", [(1000, 48 << 20), (1, 2000), (5, 500)])
def test_against_all_strings(spark, hot, group_bytes):
    rows = made()
    docs = spark.createDataFrame([(i, t, "x", True) for i, t in rows], "doc_id long, text string, kept_sha256 string, kept boolean").repartition(5)
    spans = {r["doc"]: [tuple(s) for s in r["spans"]] for r in repeated_spans(docs, hot=hot, group_bytes=group_bytes).collect()}
    want = {i: (removed, runs) for i, _, removed, runs, *_ in brute(rows) if removed}
    assert {i: (sum(b - a for a, b in s), len(s)) for i, s in spans.items()} == want


def test_columns(spark):
    rows = made()
    docs = spark.createDataFrame([(i, t, "x", True) for i, t in rows], "doc_id long, text string, kept_sha256 string, kept boolean").repartition(5)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["text"]) for r in suffix_dedup(docs).collect())
    assert got == brute(rows)


def test_null_ids_and_empty_tables(spark):
    text = "".join(map(str, range(200)))
    docs = spark.createDataFrame([(None, text), (None, text), (2, text), (1, text), (3, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"], r["text"] == text) for r in suffix_dedup(docs).collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 0, True), (2, len(text), False), (3, 0, False)]
    assert suffix_dedup(docs.where("false")).collect() == []


def test_grams_that_recur_by_chance_fetch_no_bytes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"word{i:02d}" for i in range(12)]
    texts = [" ".join(words[x] for x in rng.integers(0, 12, 150)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = []
    monkeypatch.setattr(module, "store", lambda df: stored.append(df.localCheckpoint()) or stored[-1])
    assert repeated_spans(docs).collect() == []
    assert stored[0].where(f"what != {module._SETTLED}").count() == 0


@pytest.mark.parametrize("most_bytes", [48 << 20, 0])
def test_texts_without_spans_stay(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "BROADCAST_BYTES", most_bytes)
    rows = [*made(), (None, "x" * 300), (-1, None)]
    docs = spark.createDataFrame([(t, i) for i, t in rows], "text string, doc_id long").repartition(5)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["text"]) for r in suffix_dedup(docs).where("doc_id is not null").collect())
    assert got == brute([r for r in rows if r[0] is not None])
    assert [(r["n_removed"], r["text"]) for r in suffix_dedup(docs).where("doc_id is null").collect()] == [(0, "x" * 300)]


def test_a_worker_holds_nothing_after_its_task():
    def work(batches):
        common.resident("something", lambda: bytearray(10))
        common.Hashes(np.zeros(1000, np.uint8)).of(np.zeros(1, np.int64), np.ones(1, np.int64))
        yield from batches
        if not batches:
            raise ValueError

    assert list(common.tidy(work)([1, 2])) == [1, 2]
    assert not common._resident and not common._tables
    with pytest.raises(ValueError):
        list(common.tidy(work)([]))
    assert not common._resident and not common._tables
