"""BPE encoding by speculation: greedy longest match proposes tokens, one array check tests all neighbours, and only words that fail it are merged.

A sequence of tokens is what BPE yields exactly if every two neighbours are: no merge across their border would have come before the merges
that formed the parts on either side. So the proposals of many words are verified at once, and the slow loop runs for the rest.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident, slices, small_batches

#: Encoded words kept by a worker at once.
CACHE = 500_000
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_BLANK = "\t-\r "
#: A character outside ASCII and the letters of Latin-1: the text then goes through the tokenizers library's own normaliser and splitter.
UNUSUAL = re.compile(f"[^\x00-\x7f{_LETTER}]")
#: The two splitting patterns of the public vocabularies, written for the characters that aren't UNUSUAL.
WORD_END_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_BLANK}{_LETTER}0-9]+")
BYTE_LEVEL_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^{_BLANK}{_LETTER}0-9]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself if printable in Latin-1, else the next one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_END = "\x01"
_GAP = "\x00"


class Merges:
    """The merge table of a BPE vocabulary, as arrays indexed by token id."""

    def __init__(self, model: dict, suffix: str):
        vocab, self.suffix = model["vocab"], suffix
        self.tokens: list[str] = [""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        n = len(self.tokens)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[j]] for p in pairs], np.int64) for j in (0, 1))
        made = np.array([vocab[self._joined(*p)] for p in pairs], np.int64)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, key in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
            self.rank.setdefault(key, (r, int(made[r])))
        self.made = made
        self.keys = left * n + right
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.key_rank = self.keys[order], order
        self.born = np.full(n, -1)
        self.left, self.right = np.arange(n), np.arange(n)
        for r in range(len(made) - 1, -1, -1):
            self.born[made[r]], self.left[made[r]], self.right[made[r]] = r, left[r], right[r]
        self.ids = {self._short(t): i for t, i in vocab.items()}
        own = [t for t in range(n) if self.tokens[t] and (self.born[t] < 0 or self.merge(self._symbols(self._short(self.tokens[t]))) == [t])]
        self.automaton = ahocorasick.Automaton()
        for t in own:
            if short := self._short(self.tokens[t]):
                self.automaton.add_word(short, (t, len(short)))
        self.automaton.make_automaton()

    def _joined(self, a: str, b: str) -> str:
        return a + b

    def _short(self, token: str) -> str:
        return token[: -len(self.suffix)] + _END if self.suffix and token.endswith(self.suffix) else token

    def _symbols(self, short: str) -> list[int]:
        end = short.endswith(_END)
        body = short[:-1] if end else short
        parts = [*body[:-1], body[-1:] + _END] if end and body else [*body]
        return [self.ids[p] for p in parts if p in self.ids]

    def merge(self, symbols: list[int]) -> list[int]:
        """Exact BPE: again and again the pair of the lowest rank, the leftmost of equals, until none is left."""
        symbols, none = list(symbols), (1 << 40, -1)
        ranks = [self.rank.get(p, none) for p in zip(symbols, symbols[1:], strict=False)]
        while ranks and (least := min(ranks)) is not none:
            i = ranks.index(least)
            symbols[i : i + 2] = [least[1]]
            del ranks[i]
            for j in (i - 1, i):
                if 0 <= j < len(ranks):
                    ranks[j] = self.rank.get((symbols[j], symbols[j + 1]), none)
        return symbols

    def merge_all(self, lines: list[list[int]]) -> list[bytes]:
        """merge() for many words at once: a row of a matrix each, one merge a row and round."""
        out: list[bytes] = [b""] * len(lines)
        sizes = np.array([len(x) for x in lines])
        for low, high in ((0, 8), (8, 12), (12, 18), (18, 32)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for part in np.array_split(rows, len(rows) // 100_000 + 1):
                width = int(sizes[part].max(initial=1))
                symbols = np.full((len(part), width + 1), -1, np.int64)
                symbols[np.arange(width + 1) < sizes[part][:, None]] = np.concatenate([lines[i] for i in part.tolist()]) if len(part) else []
                never = 1 << 40
                ranks = np.where(symbols[:, 1:] >= 0, self._pair_rank(symbols[:, :-1], symbols[:, 1:]), never)
                live = np.arange(len(part))
                place = np.arange(width)
                while len(live):
                    now = ranks[live]
                    i = now.argmin(1)
                    least = now[np.arange(len(live)), i]
                    going = least < never
                    live, now, i, least = live[going], now[going], i[going], least[going]
                    if not len(live):
                        break
                    line = symbols[live]
                    moved = np.where(place <= i[:, None], line[:, :-1], line[:, 1:])
                    row = np.arange(len(live))
                    moved[row, i] = self.made[least]
                    line[:, :-1], line[:, -1] = moved, -1
                    symbols[live] = line
                    now[:, :-1] = np.where(place[:-1] < i[:, None], now[:, :-1], now[:, 1:])
                    now[:, -1] = never
                    for j in (i - 1, i):
                        at = np.maximum(j, 0)
                        a, b = line[row, at], line[row, at + 1]
                        fresh = np.where(b >= 0, self._pair_rank(a, np.maximum(b, 0)), never)
                        now[row, at] = np.where(j >= 0, fresh, now[row, at])
                    ranks[live] = now
                kept = symbols >= 0
                blob = symbols[kept].astype("<u4").tobytes()
                ends = (4 * np.cumsum(kept.sum(1))).tolist()
                for k, i in enumerate(part.tolist()):
                    out[i] = blob[ends[k - 1] if k else 0 : ends[k]]
        for i in np.flatnonzero(sizes > 32).tolist():
            out[i] = np.array(self.merge(lines[i]), "<u4").tobytes()
        return out

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * len(self.tokens) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], 1 << 40)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves token a beside token b.

        Two symbols meet at the border from when both are formed until one is taken up by its own parent. Going back in time, the symbol
        formed later is split; of two of equal rank the right one is the later. A merge across is early if its rank is below that of the left
        parent, or not above that of the right one (equal ranks merge from the left).
        """
        never = 1 << 39
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        left_parent, right_parent = np.full(len(a), never), np.full(len(a), never)
        while len(live):
            r = self._pair_rank(a, b)
            crossed = (r < left_parent) & (r <= right_parent)
            ok[live[crossed]] = False
            go = ~crossed & ((self.born[a] >= 0) | (self.born[b] >= 0))
            live, a, b, left_parent, right_parent = (x[go] for x in (live, a, b, left_parent, right_parent))
            split_a = self.born[a] > self.born[b]
            left_parent = np.where(split_a, self.born[a], left_parent)
            right_parent = np.where(split_a, right_parent, self.born[b])
            a, b = np.where(split_a, self.right[a], a), np.where(split_a, b, self.left[b])
        return ok

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of words written in the byte alphabet (without the suffix), as little-endian unsigned 32-bit integers."""
        end = _END if self.suffix else ""
        line = _GAP.join([w + end for w in words])
        ends = np.cumsum([len(w) + len(end) + 1 for w in words]) - 1
        found = [x for at, (token, size) in self.automaton.iter_long(line) for x in (at, token, size)]
        at, ids, size = np.array(found, np.int64).reshape(-1, 3).T
        owner = np.searchsorted(ends, at, "right")
        good = np.bincount(owner, size, len(words)) == np.diff(ends, prepend=-1) - 1
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        good[owner[inner[~self.compatible(ids[inner], ids[inner + 1])]]] = False
        first = (4 * np.searchsorted(owner, np.arange(len(words) + 1))).tolist()
        blob = ids.astype("<u4").tobytes()
        fine = good.tolist()
        failed = iter(self.merge_all([self._symbols(w + end) for w, ok in zip(words, fine, strict=True) if not ok]))
        return [blob[first[i] : first[i + 1]] if ok else next(failed) for i, ok in enumerate(fine)]


def _ranked(spec: dict) -> Callable[[bytes], list[int]] | None:
    """tiktoken's merge loop over the same vocabulary, if its ids follow the order of its merges and sit in the byte alphabet; else None."""
    model, suffix = spec["model"], spec["model"].get("end_of_word_suffix")
    vocab = model["vocab"]
    made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    back = {c: b for b, c in enumerate(byte_alphabet())}
    special = {t["content"] for t in spec["added_tokens"]}
    plain = {t: i for t, i in vocab.items() if t not in special}
    if suffix or made != sorted(set(made)) or array("I").itemsize != 4 or sys.byteorder != "little" or not all(c in back for t in plain for c in t):
        return None
    import tiktoken

    ranks = {bytes(back[c] for c in t): i for t, i in plain.items()}
    return tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


#: The regular expressions by which the library splits texts under the public vocabulary of word ends.
_WORD_END_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WHITE_RUN = r"\s+"


def _fast_split(spec: dict) -> tuple[re.Pattern, bool] | None:
    """The pattern, and whether texts are lower-cased first, by which texts without UNUSUAL characters are split in Python; None: only the library can."""
    normalizer, splitter = spec["normalizer"], spec["pre_tokenizer"]
    steps = splitter.get("pretokenizers", [splitter])
    levels = [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in steps]
    if normalizer is None and levels == [("ByteLevel", False, True)]:
        return BYTE_LEVEL_PATTERN, False
    if normalizer is None or len(steps) != 2 or levels[1] != ("ByteLevel", False, False):
        return None
    split = {"type": "Split", "pattern": {"Regex": _WORD_END_SPLIT}, "behavior": "Removed", "invert": True}
    parts = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": _WHITE_RUN}, "content": " "}, {"type": "Lowercase"}]
    return (WORD_END_PATTERN, True) if steps[0] == split and normalizer.get("normalizers") == parts else None


def _refuse_unknown(spec: dict) -> None:
    """Raises for a vocabulary file that means more than this module does: it would be encoded wrongly."""
    model, splitter = spec["model"], spec["pre_tokenizer"] or {}
    steps = splitter.get("pretokenizers", [splitter])
    extra = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    flags = [t["content"] for t in spec["added_tokens"] if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
    if model["type"] != "BPE" or extra or flags or not any(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") for x in steps):
        raise ValueError(f"not a byte-level BPE vocabulary of the kind that can be encoded here: {model['type']} {extra} {flags}")


class Encoder:
    """Ids of texts under a vocabulary file of the tokenizers library, in little-endian unsigned 32-bit integers.

    With speculate, unseen words are encoded by Merges; without it, by the library, word by word. Any byte-level BPE vocabulary does; others are refused.
    A line of words holds strings as they stand in the text, 1-tuples of what the library split and wrote in the byte alphabet, and special tokens' ids.
    """

    def __init__(self, source: str, speculate: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(source)
        _refuse_unknown(spec)
        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.merges = Merges(spec["model"], self.suffix) if speculate else None
        self.ranked = None if speculate else _ranked(spec)
        self.bytes = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern, self.lower = _fast_split(spec) or (None, False)
        self.cache: dict[str | tuple[str] | int, bytes] = {}
        self.names = {i: t for t, i in spec["model"]["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.decoder = self.library.decoder

    def split(self, text: str) -> list[str] | list[tuple[str]]:
        """The words of a text without special tokens."""
        if self.pattern is not None and UNUSUAL.search(text) is None:
            return self.pattern.findall(text.lower() if self.lower else text)
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [(w,) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def write(self, word: str | tuple[str]) -> str:
        """A word in the byte alphabet."""
        if isinstance(word, tuple):
            return word[0]
        return word if word.isascii() and word.isalnum() else "".join([self.bytes[b] for b in word.encode()])

    def encode(self, texts: list[str]) -> list[bytes]:
        lines: list[list] = []
        for text in texts:
            if not any(x in text for x in self.special):
                lines.append(self.split(text))
                continue
            line: list = []
            for part in self.at_special.split(text):
                if part in self.special:
                    line.append(self.special[part])
                elif part:
                    line += self.split(part)
            lines.append(line)
        cache = self.cache
        new = {w for line in lines for w in line if w not in cache} if len(lines) < 4 else set().union(*lines).difference(cache)
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = set().union(*lines)
        for w in [w for w in new if isinstance(w, int)]:
            cache[w] = np.uint32(w).tobytes()
        todo = [w for w in new if not isinstance(w, int)]
        if self.merges is not None:
            if todo:
                cache.update(zip(todo, self.merges.encode([self.write(w) for w in todo]), strict=True))
        else:
            model, raw = self.library.model, [w for w in todo if isinstance(w, str)]
            if self.ranked is not None:
                cache.update((w, array("I", self.ranked(w.encode())).tobytes()) for w in raw)
            for w in todo:
                if w not in cache:
                    cache[w] = np.array([t.id for t in model.tokenize(self.write(w))], "<u4").tobytes()
        return [b"".join(map(cache.__getitem__, line)) for line in lines]

    def decode(self, ids: bytes) -> str:
        """As the library's decode(ids, skip_special_tokens=False): without a decoder the tokens' names with a space between."""
        listed = np.frombuffer(ids, "<u4").tolist()
        if self.decoder is not None:
            return self.library.decode(listed, skip_special_tokens=False)
        return " ".join(map(self.names.__getitem__, listed))


def encoder_of(source: str, speculate: bool = True) -> Encoder:
    """The worker's encoder of this vocabulary; it lives on from task to task."""
    return resident((hash(source), speculate), lambda: Encoder(source, speculate))


def vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def over_texts(docs: DataFrame, text_col: str, name: str, kind: str, work: Callable[[list], pa.Array]) -> DataFrame:
    """docs without the text, with a column that `work` makes from slices of texts (None where null); a column of that name is replaced."""
    kept = docs.drop(name).withColumn("__sl_in", F.col(text_col)) if name in docs.columns and name != text_col else docs.withColumn("__sl_in", F.col(text_col))
    kept = kept.drop(text_col)
    names = [c for c in kept.columns if c != "__sl_in"]
    schema = kept.select(*names).schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__sl_in", 2 << 20):
                yield pa.record_batch([*(part.column(i) for i in range(len(names))), work(part.column(len(names)).to_pylist())], [*names, name])

    return kept.select(*names, "__sl_in").mapInArrow(run, schema)


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids of the text (binary, little-endian unsigned 32-bit) in place of the text, without added special tokens.

    A null text counts as empty and has no ids; special tokens written out in a text are their ids, as in the library.
    """
    source = small_batches(docs.sparkSession).sparkContext.broadcast(vocabulary(path))
    return over_texts(docs, text_col, ids_col, "binary", lambda texts: pa.array(encoder_of(source.value).encode([t or "" for t in texts]), pa.binary()))


def bpe_decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with the decoded text beside the ids; null ids decode to ""."""
    source = small_batches(rows.sparkSession).sparkContext.broadcast(vocabulary(path))
    both = rows.withColumn("__sl_ids", F.col(ids_col))
    return over_texts(both, "__sl_ids", text_col, "string", lambda ids: pa.array([encoder_of(source.value).decode(i or b"") for i in ids], pa.string()))
