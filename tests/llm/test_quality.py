"""The quality classifier against features in plain Python and the textbook discriminant; the line rules against plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm.common import utf8
from strandlake.llm.quality_classifier import FEATURES, quality_classifier, statistics
from strandlake.llm.quality_rules import LineRules, quality_rules

WORD = r"[^\x20\x09-\x0D]+"


def features(text):
    """A row of FEATURES: shares under a square root (4 at most a word), sizes under a logarithm; bytes count, not characters."""
    b = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", b)
    lines = [x for x in b.split(b"\n") if x]
    n = max(1, len(words))
    share = lambda k: math.sqrt(min(4, k / n))
    letters = max(1, sum(chr(c).isascii() and chr(c).isalpha() for c in b))
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)] or ([tuple(words)] if words else [])
    many = Counter(triples)
    again = {i + j for i, t in enumerate(triples) if many[t] > 1 for j in range(3)}
    return [
        math.log1p(len(words)), math.log1p(sum(map(len, words)) / n), share(sum(c in b"#*$%&<>~^_=" for c in b)), share(sum(c in b"!?" for c in b)), share(words.count(b"|")),
        math.sqrt(sum(65 <= c <= 90 for c in b) / letters), math.sqrt(sum(48 <= c <= 57 for c in b) / max(1, len(b))), share(sum(c in b".,;:" for c in b)), share(b.count(b"\n")),
        share(sum(len(w) <= 3 for w in words)), share(sum(len(w) >= 10 for w in words)), math.sqrt(len(set(words)) / n), share(len(again)), math.sqrt(1 - len(set(lines)) / max(1, len(lines))) if lines else 0.0,
    ]


def made(n=160):
    rng = np.random.default_rng(7)
    good = "the river runs past an old mill and nobody remembers who built it or why it stands there".split()
    texts = []
    for i in range(n):
        words = rng.choice(good, rng.integers(5, 60)).tolist()
        if i % 2:
            words = [w.upper() + "!!" if rng.random() < 0.3 else w + "*#" if rng.random() < 0.2 else w for w in words] + ["|"] * int(rng.integers(0, 5))
        texts.append((" ".join(words) + ("\n" if i % 3 else ". ")) * int(rng.integers(1, 4)))
    return [*texts, None, "", " \n\n", "é 7 |", "long " * 20_000]


def test_features():
    texts = made()
    got = statistics(*utf8(pa.array(texts, pa.string())))
    assert got.shape[1] == len(FEATURES) and np.allclose(got, [features(t) for t in texts], atol=1e-9)


def textbook(x, y, shrink=0.2, pooled_part=0.5):
    """Scores of all rows of x from the rows with y in 0 and 1: log-density difference of two shrunk Gaussians, by inverses and determinants."""
    known = y >= 0
    mean, scale = x[known].mean(0), np.sqrt(np.maximum(1e-6, x[known].var(0)))
    z = (x - mean) / scale
    own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    n = [(y == c).sum() for c in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    density = []
    for c in (0, 1):
        target = pooled_part * pooled + (1 - pooled_part) * np.eye(x.shape[1]) * np.trace(own[c]) / x.shape[1]
        cov = (1 - shrink) * own[c] + shrink * target + 1e-6 * np.eye(x.shape[1])
        d = z - z[y == c].mean(0)
        density.append(math.log(n[c] / sum(n)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / 4, -30, 30)))


def test_against_the_textbook(spark):
    texts = made()
    labels = [None if i % 7 == 0 else 1 - i % 2 for i in range(len(texts))]
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 0.1, 1, "x") for i, t in enumerate(texts)] + [(None, "no id", 0.1, 1, "x")], "doc_id long, text string, score double, quality int, _id string").repartition(3)
    known = spark.createDataFrame([(i, q, "x") for i, q in enumerate(labels)] + [(None, 1, "x"), (9999, 1, "x")], "doc_id long, quality int, _text string")
    got = {r["doc_id"]: r for r in quality_classifier(docs, known).collect()}
    y = np.array([-1 if q is None or h else q for q, h in zip(labels, held, strict=True)])
    want = textbook(np.array([features(t) for t in texts]), y)
    assert np.allclose([got[i]["score"] for i in range(len(texts))], want, atol=1e-6)
    assert all(got[i]["held_out"] == held[i] and got[i]["predicted"] == int(got[i]["score"] >= 0.5) for i in range(len(texts)))
    right = [got[i]["predicted"] == labels[i] for i in range(160) if held[i] and labels[i] is not None]
    assert np.mean(right) > 0.85
    assert {r["score"] for r in quality_classifier(docs, known.where("false")).collect()} == {0.5}
    assert quality_classifier(docs.where("false"), known).collect() == []


def rules_of(text):
    rules, t = LineRules(), text or ""
    words = re.findall(WORD, t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    again = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    chars = lambda x: len(re.sub(r"[\x20\x09-\x0D]", "", x))

    def bad(line):
        own = re.findall(WORD, line)
        bare = sum(w in "|»›•·>/" for w in own)
        return sum(c in rules.marks for c in line) * 100 > chars(line) * 10 or bare >= 4 or bare * 100 > 15 * len(own) or bool(re.search(rules.boilerplate, line))

    lost = sum(chars(x) for x in lines if bad(x))
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    base = (len(words), chars(t), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), failed, len(lines), sum(map(bad, lines)), lost)
    return (*base, "\n".join(x for x in lines if not bad(x)), not failed and lost * 100 <= chars(t) * 30)


@pytest.mark.parametrize("more", [[], [None, "", " \n\t", "a b c a b c a b", "x " * 200, "Home | About | News | Shop\n" * 30, "Accept all cookies\n" + "one two three\n" * 30, "日本 語\x0bé\x85 x\x1cy"]])
def test_rules(spark, more):
    texts = [*made(40)[:-1], " ".join(f"w{i % 3000}" for i in range(9000)), *more]
    docs = spark.createDataFrame([(i if i % 9 else None, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, _words string").repartition(2)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_bad_lines", "lost_chars", "clean_text", "kept"]
    got = Counter((r["doc_id"], *(r[k] for k in names)) for r in quality_rules(docs).collect())
    assert got == Counter((i if i % 9 else None, *rules_of(t)) for i, t in enumerate(texts))
    assert quality_rules(docs.where("false")).collect() == []
