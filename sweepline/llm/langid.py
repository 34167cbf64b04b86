"""Language identification by known words, backing off to ever shorter character n-grams.

A known word scores its log frequency in each language. An unseen word is padded with marks for
its ends and scored by the longest n-grams of it that were seen in training: five characters,
else four, and so on to one. The word scores of a text add up; a softmax makes the posterior.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import map_arrow, sampled

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNKNOWN = "und"


@dataclass
class LanguageModel:
    """Per-language log frequencies; row i of each matrix belongs to the i-th key."""

    langs: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: list[dict[str, int]]  # by length, longest first
    gram_scores: list[np.ndarray]
    longest: int
    prior: np.ndarray

    def unseen(self, word: str) -> np.ndarray:
        padded = f"<{word}>"
        for n, index, scores in zip(range(self.longest, 0, -1), self.grams, self.gram_scores, strict=True):
            rows = [r for i in range(len(padded) - n + 1) if (r := index.get(padded[i : i + n])) is not None]
            if rows:
                return scores[rows].mean(axis=0)
        return np.zeros(len(self.langs))


class Scorer:
    """Scores texts; remembers unseen words, and forgets them all when there are too many."""

    def __init__(self, model: LanguageModel, remembered: int = 100_000):
        self.m, self.most = model, remembered
        self.cache: dict[str, np.ndarray] = {}

    def _vector(self, word: str) -> np.ndarray:
        if (v := self.cache.get(word)) is None:
            if len(self.cache) >= self.most:
                self.cache.clear()
            v = self.cache[word] = self.m.unseen(word)
        return v

    def score(self, text: str | None) -> tuple[str, float]:
        m = self.m
        words = Counter(LETTERS.findall((text or "").lower()))
        if not words or not m.langs:
            return UNKNOWN, 0.0
        known, counts, total = [], [], m.prior.copy()
        for w, c in words.items():
            r = m.words.get(w)
            if r is None:
                total += c * self._vector(w)
            else:
                known.append(r)
                counts.append(c)
        if known:
            total += np.asarray(counts, dtype=float) @ m.word_scores[known]
        best = int(total.argmax())  # the first of equals: languages are sorted
        return m.langs[best], float(1.0 / np.exp(total - total[best]).sum())


def _log_frequencies(rows: pa.Table, langs: list[str], smooth: float = 0.5) -> tuple[dict[str, int], np.ndarray]:
    """Row numbers of the keys in ascending order, and their smoothed log frequency in each language; rows: lang, key, n."""
    rows = rows.sort_by("key")
    keys = rows["key"].combine_chunks().dictionary_encode()
    counts = np.zeros((max(1, len(keys.dictionary)), len(langs)), dtype=np.float32)
    at = {x: i for i, x in enumerate(langs)}
    counts[keys.indices.to_numpy(zero_copy_only=False), [at[x] for x in rows["lang"].to_pylist()]] = rows["n"].to_numpy()
    index = {k: i for i, k in enumerate(keys.dictionary.to_pylist())}
    return index, np.log((counts + smooth) / (counts.sum(axis=0) + smooth * len(counts)))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs_per_lang: int = 3000, least_count: int = 2, longest: int = 5) -> LanguageModel:
    """Learn from labelled rows (null languages and texts are left out).

    The sample is bounded: about max_docs_per_lang documents a language, chosen by a hash of id and
    text, so every run takes the same ones. The model holds every word and n-gram that one language
    of the sample has least_count times, so it is bounded by the sample; a word seen less often is
    scored by its n-grams, like an unseen one.
    """
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("id")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], {}, np.zeros((1, 0)), [{}] * longest, [np.zeros((1, 0))] * longest, longest, np.zeros(0))
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, max_docs_per_lang / sizes[k])))])
    sample = labelled.where(sampled(share[F.col("lang")], "id", "text")).select("text", "lang")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, Counter] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            for lang, c in seen.items():
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(c), "word": list(c), "n": list(c.values())})

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for lang, word, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                padded = f"<{word}>"
                for size in range(1, longest + 1):
                    for i in range(len(padded) - size + 1):
                        seen[lang, padded[i : i + size]] += n
            yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in seen], "gram": [k[1] for k in seen], "n": list(seen.values())})

    def known(df: DataFrame, key: str) -> pa.Table:
        whole = F.max("n").over(Window.partitionBy(key))  # at most a row a language
        kept = df.withColumn("most", whole).where(F.col("most") >= least_count)
        return kept.select("lang", F.col(key).alias("key"), "n").toArrow()  # bounded by the sample

    words = map_arrow(sample, count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).checkpoint()
    index, scores = _log_frequencies(known(words, "word"), langs)
    counted = map_arrow(words, count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("size", F.length("gram")).checkpoint()
    grams, gram_scores = [], []
    for n in range(longest, 0, -1):
        i, s = _log_frequencies(known(counted.where(F.col("size") == n), "gram"), langs)
        grams.append(i)
        gram_scores.append(s)
    total = sum(sizes.values())
    return LanguageModel(langs, index, scores, grams, gram_scores, longest, np.array([math.log(sizes[k] / total) for k in langs]))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (posterior, 0 to 1).

    Null, empty or letterless texts give ('und', 0.0), as does a model learned from no rows. Ties
    go to the language first by code point. Repeated rows and null ids each keep their row;
    other columns, whatever their names, are not read. Whole texts are scored. An empty table gives
    no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by fit()'s parameters

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            got = [scorer.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), score, f"doc_id {kind}, lang_pred string, score double")
