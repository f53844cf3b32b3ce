"""The text operators on small tables with nulls, empty and repeated rows, ties and clashing columns, against plain Python."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strandlake.llm.bpe import Encoder, bpe_decode, bpe_encode, vocabulary
from strandlake.llm.exact_dedup import exact_dedup
from strandlake.llm.html_extract import extract, html_extract
from strandlake.llm.language_id import Scorer, fit, learn
from strandlake.llm.quality_classifier import quality_classifier
from strandlake.llm.quality_rules import quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, kept boolean, digest string, ids string, score double, _text string"
PROSE = "The river runs past the old mill, and nobody in the village remembers who built it or why. "


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", "s", 0, 1, True, "x", "y", 0.5, "z") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


MIXED = [None, "", " \n", "a b", "ab", " a  b ", PROSE * 3, PROSE * 3, PROSE.upper(), "x" * 5000, "é" * 300 + PROSE, "é" * 300]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_exact(spark):
    got = {r["doc_id"]: r for r in exact_dedup(frame(spark, MIXED), fan_in=2).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(MIXED):
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t or "")].append(i)
    for norm, members in groups.items():
        best = min(members, key=lambda i: (-len(MIXED[i] or ""), i))
        for i in members:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (best, len(members), i == best, hashlib.sha256(norm.encode()).hexdigest())


def test_exact_repeated_rows(spark):
    got = exact_dedup(frame(spark, ["a", "a", "a"], [1, 1, None])).collect()
    assert sum(r["kept"] for r in got) == 1 and all(r["keep_id"] == 1 and r["group_size"] == 3 for r in got)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe(spark, name):
    path = public_tokenizers.path(name)
    texts = [t or "" for t in MIXED] + ["it's <|endoftext|> <|startoftext|>", "ΟΔΟΣ Σ", "日本語 naïve", "½ ² µ", "😀👍🏽", "a\x85b\x1cc", "0123 !!--"]
    library = Tokenizer.from_file(path)
    want = library.encode_batch(texts, add_special_tokens=False)
    for encoder in (Encoder(vocabulary(path)), Encoder(vocabulary(path), speculate=False)) if name.startswith("byte") else (Encoder(vocabulary(path)),):
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [w.ids for w in want]
    got = {r["doc_id"]: r for r in bpe_decode(bpe_encode(frame(spark, texts), path), path).collect()}
    assert [got[i]["decoded"] for i in range(len(texts))] == [library.decode(w.ids, skip_special_tokens=False) for w in want]


def test_language_learns_rare_languages_and_all_words(spark):
    rng = np.random.default_rng(8)
    common = sorted({"".join(map(chr, x)) for x in rng.integers(97, 123, (30_000, 5))})
    rows = [(i, " ".join(common[i % 40 :: 40] * 4), "en") for i in range(80)] + [(100 + i, "жук лес жук лес", "ru") for i in range(3)]
    model = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=12)
    assert model.langs == ["en", "ru"]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["en", "ru"] and set(model.counts[0][0]) == {*common, "жук", "лес"}
    assert Scorer(model).predict("лес")[0] == "ru" and Scorer(model).predict(common[-1])[0] == "en"


def test_language_of_words_seen_once(spark):
    docs = spark.createDataFrame([(0, "жук", "ru"), (2, "the house the house", "en")], "doc_id long, text string, lang string")
    assert fit(docs).langs == ["en", "ru"]
    assert fit(docs.where("false")).langs == []


def test_components_of_unsteady_edges(spark):
    from strandlake.llm.components import components

    def trees(batches):  # every evaluation gives other trees over the same groups of 30
        rng = np.random.default_rng()
        for batch in batches:
            edges = [(int(g * 30 + a), int(g * 30 + b)) for g in batch.column(0).to_pylist() for p in [rng.permutation(30)] for a, b in zip(p[:-1], p[1:], strict=True)]
            yield pa.record_batch([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])

    got = components(spark.range(40).mapInArrow(trees, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(i, i // 30 * 30) for i in range(1200)]


def test_quality(spark):
    bad = "BUY!! NOW!! *** $$$ | | | "
    texts = [None, "", *[PROSE * (2 + i % 5) for i in range(60)], *[bad * (2 + i % 7) for i in range(60)]]
    labels = spark.createDataFrame([(i, int(t == "" or "BUY" not in (t or "")), None) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    got = quality_classifier(frame(spark, texts), labels).collect()
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["predicted"] == int(r["doc_id"] < 62) for r in got if r["held_out"] and r["doc_id"] >= 2)
    assert {r["score"] for r in quality_classifier(frame(spark, texts), labels.where("false")).collect()} == {0.5}


def test_rules(spark):
    clean = "\n".join(" ".join(f"word{i * 10 + j}" for j in range(10)) + "." for i in range(6))
    texts = [None, "", clean, clean + "\n" + "Home | About | News | Shop | Help\n" * 20, PROSE * 10, "a b c a b c"]
    got = {r["doc_id"]: r for r in quality_rules(frame(spark, texts)).collect()}
    assert [got[i]["kept"] for i in range(5)] == [False, False, True, False, False]
    assert got[5]["n_repeat_words"] == 6 and got[3]["n_dup_lines"] == 19 and got[0]["clean_text"] == ""


def test_pages(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>A &amp; B</h1><p>First  one<br>two <b>three</b>.<p>Last.<div class='comments'><p>me too</p></div></article><footer>end</footer></body></html>"
    assert extract(page, {}) == "A & B First one two three. Last."
    pages = spark.createDataFrame([(0, "u", page, "t"), (1, "u", None, "t"), (2, None, "", "t"), (0, "u", page, "t")], "page_id long, url string, html string, text string")
    got = html_extract(pages).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in got) == [(0, 32), (0, 32), (1, 0), (2, 0)]
