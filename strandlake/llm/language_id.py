"""Language identification: known words by their log frequency in each language, unseen words by ever shorter character n-grams."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import broadcast_if_small, release, resident, slices, small_batches

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Length of the n-grams to which an unseen word falls back, in turn.
ORDERS = (5, 4, 3, 2, 1)
#: Scored words kept by a worker at once.
CACHE = 200_000


@dataclass
class LanguageModel:
    """Counts by language of words (`counts[0]`) and of n-grams (`counts[n]`): the strings and a matrix with a row for each; columns follow `langs`."""

    langs: list[str]
    counts: dict[int, tuple[list[str], np.ndarray]] = field(default_factory=dict)
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def _grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Scorer(dict):
    """word -> row of `table`, which holds its log frequencies; new words are scored many at a time."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model, self.table = model, np.zeros((CACHE, max(1, len(model.langs))), np.float32)
        self.row: dict[int, dict[str, int]] = {}
        self.log: dict[int, np.ndarray] = {}
        for n, (strings, counts) in model.counts.items():
            self.row[n] = {x: i for i, x in enumerate(strings)}
            self.log[n] = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * len(counts))).astype(np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: its own log frequencies if it is known, else the mean of those of its longest known n-grams, else zeros."""
        out = np.zeros((len(words), self.table.shape[1]))
        known = self.row.get(0, {})
        at = np.array([known.get(w, -1) for w in words], np.int64)
        if len(known):
            out[at >= 0] = self.log[0][at[at >= 0]]
        rest = np.flatnonzero(at < 0).tolist()
        for n in ORDERS:
            if n not in self.row or not rest:
                continue
            get, owner, rows = self.row[n].get, [], []
            for i in rest:
                padded = f"^{words[i]}$"
                for j in range(len(padded) - n + 1):
                    if (at_ := get(padded[j : j + n])) is not None:
                        owner.append(i)
                        rows.append(at_)
            if owner:
                seen, first, many = np.unique(np.array(owner, np.int64), return_index=True, return_counts=True)
                out[seen] = np.add.reduceat(self.log[n][rows].astype(np.float64), first, 0) / many[:, None]
                done = set(seen.tolist())
                rest = [i for i in rest if i not in done]
        return out

    def learn(self, words: set[str]) -> None:
        """Scores the words that have no row yet; if there is too little room, older ones lose theirs."""
        new = list(words.difference(self))
        if len(self) + len(new) > CACHE:
            self.clear()
            new = list(words)
        self.table[len(self) : len(self) + len(new)] = self.scores(new)
        self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The likeliest language of each text and its posterior probability under equal priors; ties go to the first in order of name. Long texts are scored in pieces."""
        lines = [LETTERS.findall(text.lower()) if text else [] for text in texts]
        together = sum(map(len, lines)) <= CACHE
        if together:
            self.learn(set().union(*lines))
        out = []
        for words in lines:
            if not self.model.langs or not any(any(map(str.isalpha, w)) for w in words):
                out.append((UNKNOWN, 0.0))
                continue
            total = np.zeros(self.table.shape[1])
            for i in range(0, len(words), 50_000):
                part = words[i : i + 50_000]
                if not together:
                    self.learn(set(part))
                total += self.table[list(map(self.__getitem__, part))].sum(0, dtype=np.float64)
            p = np.exp(total - total.max())
            best = int(total.argmax())
            out.append((self.model.langs[best], float(p[best] / p.sum())))
        return out


def scorer_of(model: LanguageModel) -> Scorer:
    """The worker's scorer of this model; it lives on from task to task."""
    return resident(model.key, lambda: Scorer(model))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 2) -> LanguageModel:
    """Counts words and n-grams by language and keeps all that occur min_count times or more; each language with a word is learned.

    Rows whose text or language is null don't count. The size of the model, which is shipped to workers, grows with the vocabulary of `labelled`.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        found: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            grams: dict[tuple[str, str, int], int] = Counter()
            for lang, counts in found.items():
                for word, n in counts.items():
                    grams[lang, word, 0] += n
                    for k in ORDERS:
                        for g in _grams(word, k):
                            grams[lang, g, k] += n
            found.clear()
            keys = list(grams)
            return pa.record_batch([pa.array([k[i] for k in keys], t) for i, t in ((0, pa.string()), (1, pa.string()), (2, pa.int32()))] + [pa.array(list(grams.values()), pa.int64())], ["lang", "gram", "k", "n"])

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
                if sum(map(len, found.values())) > 30_000:
                    yield flush()
        yield flush()

    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("t is not null and l is not null")
    counts = rows.mapInArrow(count, "lang string, gram string, k int, n long").groupBy("k", "gram", "lang").agg(F.sum("n").alias("n"))
    by_gram = counts.groupBy("k", "gram").agg(F.collect_list(F.struct("lang", "n")).alias("by"), F.sum("n").alias("n"))
    # unigrams stay whatever their count, so that no language goes missing
    found = by_gram.where((F.col("n") >= min_count) | (F.col("k") == 1)).select("k", "gram", "by").toArrow().combine_chunks().sort_by([("k", "ascending"), ("gram", "ascending")])
    by = found.column("by").combine_chunks()
    owner, flat = pc.list_parent_indices(by).to_numpy(), pc.list_flatten(by)
    lang, n = pc.struct_field(flat, "lang").dictionary_encode(), pc.struct_field(flat, "n").to_numpy()
    langs = sorted(lang.dictionary.to_pylist())
    rank = np.array([langs.index(x) for x in lang.dictionary.to_pylist()], np.int64)
    counts = np.zeros((found.num_rows, len(langs)), np.int64)
    counts[owner, rank[lang.indices.to_numpy()]] = n
    strings, k = found.column("gram").to_pylist(), found.column("k").to_numpy()
    model = LanguageModel(langs)
    for order in np.unique(k).tolist():
        lo, hi = np.searchsorted(k, [order, order + 1]).tolist()
        model.counts[order] = strings[lo:hi], counts[lo:hi]
    return model


_WHOLE = 1 << 62


def shares(sizes: dict[str, int], most: int) -> dict[str, int]:
    """Which of each language's rows to take, in parts of _WHOLE, so that they are `most` in all: as many of each, and all of a language that has fewer."""
    rates, left = {}, most
    for i, (n, lang) in enumerate(sorted((n, lang) for lang, n in sizes.items())):
        share = min(n, left // (len(sizes) - i))
        rates[lang] = _WHOLE * share // n
        left -= share
    return rates


def stratified_sample(rows: DataFrame, lang_col: str, by: list[str], most: int) -> DataFrame:
    """About `most` of the rows, chosen by a hash of the columns `by`: as many of each language, and all rows of a language that has fewer."""
    rates = shares({lang: n for lang, n in rows.groupBy(lang_col).count().collect()}, most)
    if all(rate == _WHOLE for rate in rates.values()):
        return rows
    below = broadcast_if_small(rows.sparkSession.createDataFrame(list(rates.items()), f"{lang_col} string, _rate long"), len(rates))
    return rows.join(below, lang_col).where(F.pmod(F.xxhash64(F.lit(7), *by), F.lit(_WHOLE)) < F.col("_rate")).select(*rows.columns)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred (a learned language, or `und` if the text is null or has no letter) and score (0 to 1; 0 for `und`).

    Every whole text is read; only the text is an input of the prediction. A long text is scored 50,000 words at a time, so its words are held once. Columns
    of docs pass through; those named lang_pred or score are replaced.
    """
    shipped = small_batches(docs.sparkSession).sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    out = docs.drop("lang_pred", "score")
    keep = [i for i, c in enumerate(docs.columns) if c in out.columns]
    schema = StructType(list(out.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType())

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shipped.value)
        for batch in batches:
            for part in slices(batch, text_col):
                found = scorer.predict_all(part.column(at).to_pylist())
                columns = [part.column(i) for i in keep] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.record_batch(columns, schema.names)

    return docs.mapInArrow(label, schema)


def is_held_out(id_col: str) -> Column:
    """crc32(id as text) mod 3 is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 12_000, min_count: int = 2) -> LanguageModel:
    """A model from about `sample_rows` of the labelled rows at most that aren't held out, dealt out over the languages; a hash of id and text chooses them."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    labelled = rows.where(~is_held_out("_id") & F.col("_text").isNotNull() & F.col("_lang").isNotNull())
    return fit(stratified_sample(labelled, "_lang", ["_id", "_text"], sample_rows), "_text", "_lang", min_count)


def keep_identified(docs: DataFrame, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 12_000, min_count: int = 2) -> DataFrame:
    """The rows whose language is identified (not `und`) with a score of min_score or more; without any labelled row, those with a letter."""
    model = learn(docs, id_col, text_col, lang_col, sample_rows, min_count)
    if not model.langs:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    found = identify(docs.withColumnsRenamed({c: f"_own_{c}" for c in ("lang_pred", "score")}), model, text_col)
    found = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).drop("lang_pred", "score")
    return found.withColumnsRenamed({f"_own_{c}": c for c in ("lang_pred", "score")}).select(*docs.columns)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 12_000, min_count: int = 2) -> DataFrame:
    """One row per input row: <id_col>, held_out, lang_pred, score.

    Learns from rows with a text and a language whose crc32(id as text) mod 3 isn't 1, about `sample_rows` of them at most,
    as many of each language as there are (a hash of id and text chooses), and from all words and n-grams that occur min_count times there; predicts from the text alone. A null id isn't held out. Without any labelled row all texts are `und`.
    """
    model = learn(docs, id_col, text_col, lang_col, sample_rows, min_count)
    found = identify(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), model, "_text")
    return found.select(F.col("_id").alias(id_col), is_held_out("_id").alias("held_out"), "lang_pred", "score")
