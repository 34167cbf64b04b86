"""Toxicity by a weighted lexicon, matched with Aho-Corasick over a folded text.

Folding lower-cases, maps look-alike letters of other scripts to Latin ones, undoes digit and
sign substitutions inside words, and turns everything else into single blanks. The lexicon holds
whole words (' word ') and word beginnings (' stem'); exception phrases cancel the hits inside
them. The hits' weights are divided by a power of the length and passed to a logistic curve.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from itertools import accumulate
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow, sampled, written

# Letters of other scripts and their Latin look-alikes, in aligned rows.
CYRILLIC = "авеікмнорстухѕјһԁԛԝьгпцңү", "abeikmhopctyxsjhdqwbrnuhy"
GREEK = "αβγεζηικμνοπρστυχωϲϳ", "abyeznikuvonpotuxwcj"
ARMENIAN = "ոսօհցգքզյ", "nuohgqpqj"
#: Digits and signs that stand for letters, undone only inside a word that has a letter.
SUBSTITUTE = str.maketrans("0123456789@$!|", "oizeasgtbgasil")
MARKS = re.compile("[\u0300-\u036f]+")


def _lookalikes() -> dict[int, str]:
    """Of the scripts above, and of Latin letters that Unicode names as one of a to z "with" something, small capitals and the like."""
    out = {ord(a): b for rows in (CYRILLIC, GREEK, ARMENIAN) for a, b in zip(*rows, strict=True)}
    named = re.compile(r"LATIN (?:SMALL LETTER|LETTER SMALL CAPITAL)(?: SCRIPT| DOTLESS| OPEN| TURNED| REVERSED)? ([A-Z])(?: WITH .*)?")
    for c in [*range(0xC0, 0x2B0), *range(0x1D00, 0x1E00), *range(0xA720, 0xA800), *range(0xAB30, 0xAB70)]:
        if m := named.fullmatch(unicodedata.name(chr(c), "")):
            out[c] = m[1].lower()
    return out


LOOKALIKE = _lookalikes()
RUN = re.compile(r"[\w@$!|]+")
PLAIN = re.compile(r"[^\W\d_]+")
ODD = re.compile(r"[0-9@$!|]")

#: Phrases in which a lexicon word is harmless, beside those that fit() finds.
EXCEPTIONS = ("trash can", "trash bin", "class clown", "sore loser award")


def fold(text: str | None) -> str:
    """' word word ... ' with one blank around each word; '' if there is no word."""
    if not text:
        return ""
    low = text.lower()
    if not low.isascii():
        low = MARKS.sub("", unicodedata.normalize("NFKD", low)).translate(LOOKALIKE).lower()
    out = []
    for w in RUN.findall(low):
        if ODD.search(w):
            bare = w.strip("!|")
            if not PLAIN.search(bare):
                out.append(bare or w)
                continue
            w = bare.translate(SUBSTITUTE)
        out.append(w)
    return f" {' '.join(out)} " if out else ""


@dataclass
class ToxicityModel:
    lexicon: dict[str, float] = field(default_factory=dict)  # ' word ' or ' stem' -> weight
    exceptions: tuple[str, ...] = EXCEPTIONS
    power: float = 0.5
    slope: float = 1.0
    offset: float = -4.0


class Matcher:
    """An automaton over the lexicon and the exception phrases."""

    def __init__(self, model: ToxicityModel):
        self.m = model
        self.auto = ahocorasick.Automaton()
        for pattern, weight in model.lexicon.items():
            self.auto.add_word(pattern, (len(pattern), weight))
        for phrase in model.exceptions:
            if folded := fold(phrase):
                self.auto.add_word(folded, (len(folded), None))
        self.empty = not len(self.auto)
        if not self.empty:
            self.auto.make_automaton()

    def density(self, text: str | None) -> tuple[float, int]:
        """(weights of the hits by the text's length in words to a power, number of hits)."""
        folded = fold(text)
        if not folded or self.empty:
            return 0.0, 0
        hits, calm = [], []
        for end, (size, weight) in self.auto.iter(folded):
            (calm if weight is None else hits).append((end - size + 1, end, weight))
        if calm:
            calm.sort()
            starts, reach = [c[0] for c in calm], list(accumulate((c[1] for c in calm), max))
            # a phrase that begins no later and ends no earlier holds the hit
            hits = [h for h in hits if not ((i := bisect_right(starts, h[0])) and reach[i - 1] >= h[1])]
        return sum(h[2] for h in hits) / (folded.count(" ") - 1) ** self.m.power, len(hits)

    def score(self, text: str | None) -> tuple[float, int]:
        x, hits = self.density(text)
        z = max(-40.0, min(40.0, self.m.offset + self.m.slope * x))
        return 1.0 / (1.0 + math.exp(-z)), hits


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[float, float]:
    """(slope, offset) by Newton steps on the ridge-penalised likelihood."""
    a = np.column_stack([x, np.ones_like(x)])
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs_per_class: int = 4000, stem: tuple[int, int] = (3, 8), least_docs: int = 3, least_weight: float = 2.0, least_support: float = 40.0) -> ToxicityModel:
    """Learn the lexicon, its weights, exception phrases and the curve from labelled rows.

    The sample is bounded: about max_docs_per_class documents of each class, chosen by a hash of
    the id. Nothing else is capped: all terms of the sample that tell the classes apart enter the
    lexicon. A term's weight is its log odds between the two classes; terms whose likelihood ratio
    against chance is below least_support, or that fewer than least_docs toxic documents hold, are
    left out. A stem stands in for the words that begin with it unless one word makes up nearly all
    of its uses. Ids that are null, or labelled both ways, are left out.
    """
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    marked = marked.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top")
    n = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return ToxicityModel()
    share = F.when(F.col("y") == 1, min(1.0, max_docs_per_class / n[1])).otherwise(min(1.0, max_docs_per_class / n[0]))
    chosen = marked.where(sampled(share, "doc_id")).select("doc_id", "y")
    # about 2 * max_docs_per_class rows of 12 bytes, whatever the input: fit to broadcast
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "y")
    sample = written(sample)  # read four times, where all texts would be read each time
    low, high = stem

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = (Counter(), Counter())
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = set(fold(text).split())
                got = {f" {w} " for w in words}
                for w in words:
                    got.update(f" {w[:k]}" for k in range(low, min(high, len(w) - 1) + 1))
                seen[y].update(got)
            keys = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_pydict({"term": keys, "clean": [seen[0][k] for k in keys], "toxic": [seen[1][k] for k in keys]})

    counted = map_arrow(sample, terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).checkpoint()
    sizes = sample.groupBy("y").agg(F.count("*").alias("n"))
    n = {r["y"]: r["n"] for r in sizes.collect()}
    if not n.get(1) or not n.get(0):
        return ToxicityModel()
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 0.5) / (n[0] + 1))
    total = F.col("toxic") + F.col("clean")
    part = lambda c, k: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * (n[0] + n[1]) / (total * n[k]))).otherwise(0.0)
    support = 2 * (part("toxic", 1) + part("clean", 0))
    found = counted.withColumn("weight", odds).where((F.col("toxic") >= least_docs) & (F.col("weight") >= least_weight) & (support >= least_support)).collect()  # terms of the bounded sample
    by_term = {r["term"]: (r["toxic"], r["clean"], r["weight"]) for r in found}
    blunt = set()  # stems that a longer term with half of their uses beats clearly
    for t, (toxic, _, weight) in by_term.items():
        for k in range(low + 1, len(t)):
            if (p := by_term.get(t[:k])) and weight > p[2] + 1 and 2 * toxic >= p[0]:
                blunt.add(t[:k])
    most_used: dict[str, int] = {}  # of each stem: the documents of its most frequent word
    for t, (toxic, _, _) in by_term.items():
        if t.endswith(" "):
            for k in range(low, min(high, len(t) - 3) + 1):
                most_used[t[: k + 1]] = max(most_used.get(t[: k + 1], 0), toxic)
    lexicon: dict[str, float] = {}
    for t in sorted(by_term, key=lambda t: (len(t.rstrip()), t)):
        if t in blunt or any(t[:k] in lexicon for k in range(2, len(t))):
            continue
        toxic, _, weight = by_term[t]
        if t.endswith(" ") or most_used.get(t, 0) < 0.9 * toxic:
            lexicon[t] = weight
    model = ToxicityModel(lexicon)

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value.lexicon
        stems = tuple(t for t in lex if not t.endswith(" "))
        for b in batches:
            seen = (Counter(), Counter())
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = fold(text).split()
                got = set()
                for i, w in enumerate(words):
                    if f" {w} " in lex or (stems and f" {w}".startswith(stems)):
                        got.update(" ".join(words[a : a + 2]) for a in (i - 1, i) if 0 <= a < len(words) - 1)
                seen[y].update(got)
            keys = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_pydict({"phrase": keys, "clean": [seen[0][k] for k in keys], "toxic": [seen[1][k] for k in keys]})

    calm = map_arrow(sample, neighbours, "phrase string, clean long, toxic long").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    calm = calm.where((F.col("clean") >= least_docs) & (F.col("clean") >= 4 * F.col("toxic"))).orderBy("phrase")
    model = ToxicityModel(lexicon, tuple(dict.fromkeys((*EXCEPTIONS, *(r["phrase"] for r in calm.collect())))))
    pairs = densities(sample, model, "y", "text").collect()  # about 2 * max_docs_per_class numbers
    model.slope, model.offset = _logistic(np.array([r["density"] for r in pairs]), np.array([r["doc_id"] for r in pairs], dtype=float))
    return model


def densities(docs: DataFrame, model: ToxicityModel, id_col: str, text_col: str) -> DataFrame:
    """doc_id, density, hits: what the curve is fitted to."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(shared.value)
        for b in batches:
            got = [match.density(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())], names=["doc_id", "density", "hits"])

    return map_arrow(docs.select(id_col, text_col), run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, density double, hits long")


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), hits (lexicon matches left after exceptions).

    Null and empty texts have density 0 and the score that the curve gives to it. Repeated rows
    and null ids each keep their row; other columns are not read. Whole texts are matched. A match
    that lies inside an exception's phrase does not count. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit()'s parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(shared.value)
        for b in batches:
            got = [match.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())], names=["doc_id", "score", "hits"])

    return map_arrow(docs.select(id_col, text_col), run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, hits long")
