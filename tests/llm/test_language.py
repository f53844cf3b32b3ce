"""Language identification against plain dictionaries, with samples, nulls and clashing columns."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandlake.llm.language_id import ORDERS, keep_identified, language_id, shares

LETTERS = re.compile(r"[^\W\d_]+")


def brute(rows, min_count=2):
    """(id, language or und, score) of every row, by the definition: word first, then ever shorter n-grams, equal priors."""
    counts = defaultdict(lambda: defaultdict(Counter))
    for i, text, lang in rows:
        if text is not None and lang is not None and (i is None or zlib.crc32(str(i).encode()) % 3 != 1):
            for w in LETTERS.findall(text.lower()):
                counts[0][w][lang] += 1
                for n in ORDERS:
                    for j in range(len(w) + 3 - n):
                        counts[n][f"^{w}$"[j : j + n]][lang] += 1
    langs = sorted({lang for by in counts[1].values() for lang in by})
    kept = {n: {g: by for g, by in table.items() if n == 1 or sum(by.values()) >= min_count} for n, table in counts.items()}
    total = {n: {lang: sum(by[lang] for by in table.values()) for lang in langs} for n, table in kept.items()}

    def log(n, g, lang):
        return math.log((kept[n][g][lang] + 0.5) / (total[n][lang] + 0.5 * len(kept[n])))

    def word(w, lang):
        if w in kept[0]:
            return log(0, w, lang)
        for n in ORDERS:
            seen = [log(n, f"^{w}$"[j : j + n], lang) for j in range(len(w) + 3 - n) if f"^{w}$"[j : j + n] in kept.get(n, {})]
            if seen:
                return sum(seen) / len(seen)
        return 0.0

    out = []
    for i, text, _ in rows:
        found = LETTERS.findall((text or "").lower())
        if not found or not langs:
            out.append((i, "und", 0.0))
            continue
        scores = [sum(word(w, lang) for w in found) for lang in langs]
        out.append((i, langs[int(np.argmax(scores))], 1 / sum(math.exp(s - max(scores)) for s in scores)))
    return out


def corpus(n=150):
    rng = np.random.default_rng(11)
    pieces = {"de": "der die und ein sch lich ung haus gar ten".split(), "en": "the and ing tion house gard en of to".split(), "fr": "le la et ment eau oui mai son jar din".split()}
    rows = []
    for i in range(n):
        lang = ["de", "en", "fr"][i % 3]
        words = ["".join(rng.choice(pieces[lang if rng.random() < 0.8 else "en"], rng.integers(1, 4))) for _ in range(rng.integers(1, 12))]
        rows.append((i, " ".join(words) + " 12 _x é", lang))
    return [*rows, (n, None, "en"), (n + 1, "123 !", "en"), (n + 2, "", None), (None, "the house", "en"), (None, "das haus", None), (5, "repeated id", "en")]


def test_against_dictionaries(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "s", 0.1, "x") for r in rows], "doc_id long, text string, lang string, _text string, score double, lang_pred string").repartition(3)
    got = sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 3)) for r in language_id(docs).collect())
    want = sorted((str(i), lang, round(s, 3)) for i, lang, s in brute(rows))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=0.002)
    kept = sorted(str(r["doc_id"]) for r in keep_identified(docs).collect())
    assert kept == sorted(str(i) for i, lang, s in brute(rows) if lang != "und" and s >= 0.5)
    assert keep_identified(docs).columns == docs.columns


@pytest.mark.parametrize("scale", [1, 10**6, 10**12])
def test_shares_at_any_size(scale):
    sizes = {"a": 5, "b": 7_000 * scale, "c": 90_000 * scale}
    rates = shares(sizes, 1000)
    taken = {k: rates[k] * n / 2**62 for k, n in sizes.items()}
    assert taken["a"] == 5 and abs(sum(taken.values()) - 1000) < 1.5 and abs(taken["b"] - taken["c"]) < 2


def test_sample_below_the_number_of_rows_still_learns_all_languages(spark):
    docs = spark.createDataFrame(corpus(900), "doc_id long, text string, lang string")
    got = [r for r in language_id(docs, sample_rows=60).collect() if r["held_out"] and r["lang_pred"] != "und"]
    lang = {i: x for i, _, x in corpus(900)}
    assert {r["lang_pred"] for r in got} == {"de", "en", "fr"}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got]) > 0.9


def test_long_text(spark):
    rows = [(0, "the house " * 60_000, "en"), (1, "das haus " * 3, "de")]
    got = {r["doc_id"]: r for r in language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[0]["lang_pred"] == "en" and got[1]["lang_pred"] == "de"
