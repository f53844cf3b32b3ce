"""BPE against the tokenizers library on control characters, mixed scripts and special tokens; vocabularies of other kinds are refused."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandlake.llm.bpe import Encoder, bpe_decode, bpe_encode, vocabulary

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
BYTES = [chr(i) for i in range(256)]
OTHERS = [*"ΟΔΟΣςß日本語한글😀👍🏽‍́İ 　ﬁ½²٣", "<|endoftext|>", "<|startoftext|>", "<|", "</w>", "'s", "'LL", "\n\n", "  "]


def fuzz():
    rng = random.Random(5)
    texts = ["".join(rng.choice(BYTES if rng.random() < 0.7 else OTHERS) for _ in range(rng.choice([1, 2, 3, 5, 9, 60]))) for _ in range(4000)]
    return texts + [a + b for a in BYTES[:32] + ["\x7f"] for b in BYTES] + ["\x01\x02!", "a \x01\x01b", "\x00<|endoftext|>", "\x00", "", "word " * 30_000]


@pytest.mark.parametrize("speculate", [True, False])
@pytest.mark.parametrize("name", FILES)
def test_any_characters(name, speculate):
    path, texts = public_tokenizers.path(name), fuzz()
    library, encoder = Tokenizer.from_file(path), Encoder(vocabulary(path), speculate)
    want = [w.ids for w in library.encode_batch(texts, add_special_tokens=False)]
    got = encoder.encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == want
    assert [encoder.decode(b) for b in got] == [library.decode(w, skip_special_tokens=False) for w in want]


@pytest.mark.parametrize("name", FILES)
def test_another_splitter_goes_through_the_library(name):
    spec = json.loads(vocabulary(public_tokenizers.path(name)))
    spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    spec["normalizer"] = None
    source, texts = json.dumps(spec), ["Ab 12 cd", "x\x01 9", "é 3"]
    want = [w.ids for w in Tokenizer.from_str(source).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in Encoder(source).encode(texts)] == want


def test_other_models_are_refused():
    spec = json.loads(vocabulary(public_tokenizers.path(FILES[1])))
    for change in ({"model": {**spec["model"], "byte_fallback": True}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{**spec["added_tokens"][0], "lstrip": True}]}):
        with pytest.raises(ValueError):
            Encoder(json.dumps(spec | change))


def test_empty_table_and_clashing_columns(spark):
    path = public_tokenizers.path(FILES[0])
    docs = spark.createDataFrame([(1, "a b", "x", 2), (None, None, "y", 3), (1, "a b", "x", 2)], "doc_id long, text string, ids string, decoded int")
    rows = bpe_decode(bpe_encode(docs, path), path).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in rows) == [(0, ""), (1, "a</w> b</w>"), (1, "a</w> b</w>")]
    assert bpe_decode(bpe_encode(docs.where("false"), path), path).collect() == []
