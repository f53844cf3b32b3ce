"""Each stage of the pipeline against plain Python on its own input; the whole over files."""

import os
import re
import sys

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))
import corpus_pipeline as pipeline  # noqa: E402
import test_jaccard  # noqa: E402
import test_language  # noqa: E402
import test_suffix  # noqa: E402

from strandlake.llm.common import passing_tables, shared_folder, store  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def made():
    rng = np.random.default_rng(21)
    english, german = ("the old mill stands by river and nobody in village knows who built it".split(), "der alte turm steht am fluss und niemand weiss wer ihn gebaut hat".split())
    rows = []
    for i in range(60):
        words, lang = (german, "de") if i % 3 == 0 else (english, "en")
        rows.append((" ".join(rng.choice(words) + str("" if rng.random() < 0.5 else rng.choice(words)) for _ in range(60)), lang))
    texts = [t for t, _ in rows]
    rows += [(texts[1], "en"), (texts[1].replace(" ", "\n ", 5), "en"), (texts[2] + " more", "en"), (texts[2] + " and more", None), (texts[4] + " " + texts[5], "en"), (texts[7][:200] + texts[8][50:300], "en")]
    rows += [(None, "en"), ("", None), ("12 34 !", "en"), ("a b", "en"), ("a  b", "en"), ("mill " * 5000, "en")]
    out = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(rows)]
    return [*out, (None, texts[10], "en", "s", 1), (None, "the village by the river", "en", "s", 1), (3, texts[3], "de", "s", 1), (3, texts[11] + " x", "en", "s", 1)]


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first stage and after each of the first four."""
    found = [spark.createDataFrame(made(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)]
    for _, stage in pipeline.STAGES[:-1]:
        found.append(stage(spark, found[-1], "").cache())
    return [rows_of(x) for x in found], found


def ids(rows):
    return sorted((r[0] is None, r[0] or 0) for r in rows)


def test_language_stage(stages):
    before, after = stages[0][0], stages[0][1]
    want = [r for r, (_, lang, score) in zip(before, test_language.brute([r[:3] for r in before]), strict=True) if lang != "und" and score >= 0.5]
    assert after == sorted(want, key=str) and len(want) > 60


def test_exact_stage(stages):
    before, after = stages[0][1], stages[0][2]
    norm = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
    best = {}
    for r in before:
        best[norm(r)] = min(best.get(norm(r), r), r, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
    assert sorted(map(norm, after)) == sorted(best) or {norm(r) for r in after} == set(best)
    assert {(r[0], r[1]) for r in best.values() if r[0] is not None} <= {(r[0], r[1]) for r in after}


def test_near_stage(stages):
    before, after = stages[0][2], stages[0][3]
    named = sorted((r for r in before if r[0] is not None), key=lambda r: r[0])
    order = named + [r for r in before if r[0] is None]
    group = test_jaccard.brute([r[1] for r in order])
    heads = {order[g][0] for _, g, _, _ in group.values()}
    assert ids(r for r in after if r[0] is not None) == ids(r for r in named if r[0] in heads)
    assert len(after) < len(before)


def test_passages_stage(stages):
    before, after = stages[0][3], stages[0][4]
    named = [r for r in before if r[0] is not None and [x[0] for x in before].count(r[0]) == 1]
    left = {i: t for i, *_, t in test_suffix.brute([(r[0], r[1]) for r in before if r[0] is not None])}
    assert {r[0]: r[1] for r in after if r[0] in {n[0] for n in named}} == {r[0]: left[r[0]] for r in named}
    assert all(r[4] == len(r[1]) for r in after) and len(after) == len(before)


def test_packing_stage(spark, stages):
    before = stages[0][4]
    rows = pipeline.pack(spark, stages[1][4], "").collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = sorted(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in before)
    assert sum(r["length"] for r in rows) == sum(sizes) and sum(r["piece"] == 0 for r in rows) == len(before)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(o == sum(n for _, n in sorted(b)[:k]) for b in bins.values() for k, (o, _) in enumerate(sorted(b))) and max(sum(n for _, n in b) for b in bins.values()) <= 2048


def test_run_leaves_only_its_result(spark):
    rows = pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(rows.columns) and rows.count() > 50
    folder = shared_folder(spark).removeprefix("file:")
    assert [d for p in os.listdir(folder) if p.startswith("pipeline-") for d in os.listdir(f"{folder}/{p}")] == ["4-best_fit_packing"]


def test_tables_pass(spark):
    with passing_tables(spark):
        path = store(spark.range(3)).inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        assert os.path.isdir(path)
    assert not os.path.isdir(path)
