"""Removes passages that an earlier document already has, by hashing lines and sentences.

A text is cut into units: at line ends, and inside a line after a sentence end once four words are
together, as lines of running text are whole paragraphs. Units are normalised (lower case, single
blanks) and hashed. Of each digest the document of the lowest rank keeps its first occurrence. Runs
of repeated units with enough words together are removed from all others; offsets refer to the
original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow, prepare, written
from .common import join_keyed

BREAK = re.compile(r"[.!?]+(?=\s)|\n")
LEAST_UNIT = 4
LAST = (1 << 63) - 1


def units(text: str | None) -> list[tuple[int, int, int, int]]:
    """(start, end, digest, words) of the units, which tile the text; digest 0 without words."""
    if not text:
        return []
    out, start = [], 0
    for m in BREAK.finditer(text):
        end = m.end()
        words = text[start:end].split()
        if len(words) >= LEAST_UNIT or text[end - 1] == "\n":
            out.append((start, end, _digest(words), len(words)))
            start = end
    if start < len(text):
        words = text[start:].split()
        out.append((start, len(text), _digest(words), len(words)))
    return out


def _digest(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words).lower()) - (1 << 63) if words else 0


def repeated_spans(cut: list[tuple[int, int, int, int]], known: set[int], min_words: int) -> list[tuple[int, int]]:
    """Spans to remove: runs of units that are in `known` or stood earlier in the same text."""
    seen: set[int] = set()
    spans, start, end, words = [], -1, -1, 0
    for a, b, d, n in cut:
        if not n:  # a blank line ends no run; it goes only between two removed units
            continue
        again = d in known or d in seen
        seen.add(d)
        if again:
            if start < 0:
                start, words = a, 0
            end, words = b, words + n
        elif start >= 0:
            if words >= min_words:
                spans.append((start, end))
            start = -1
    if start >= 0 and words >= min_words:
        spans.append((start, end))
    return spans


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def _rank(col: Column) -> Column:
    return F.coalesce(col.cast("long"), F.lit(LAST))


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 25, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, text (what is left), n_units, n_removed_chars, removed.

    removed: array of (start, end), code-point offsets of the original text in ascending order.
    carry names input columns to pass along unchanged (none of the names above). The rank is the
    id. Rows that repeat an id are one document, as are those with a null id, which ranks last:
    they take nothing from one another. Ties cannot arise otherwise. A null text stays null, an
    empty one empty; neither has units. An empty table gives no rows. Other columns are not read.

    A passage is removed if its whole units make up min_words words; shorter ones, such as a heading
    that many texts share, stay. Digests have 64 bits; a lone collision removes nothing unless the
    unit is part of a run with min_words words. Groups of equal digests are combined before they
    are shuffled, and only one row per group is kept. Digests that many documents share are few,
    and are broadcast back to the documents, so a line that a third of all documents hold goes to
    no single task. Rows are told apart by id and text, so null ids are no hot key either, unless
    their texts are equal too.
    """
    prepare(docs.sparkSession)
    src = docs.select(_rank(F.col(id_col)).alias("rank"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("same"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                ranks, sames, digests = [], [], []
                for r, t, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                    mine = {d for _, _, d, n in units(t.as_py()) if n}
                    ranks += [r] * len(mine)
                    sames += [h] * len(mine)
                    digests += mine
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ranks, sames, digests)], names=["rank", "same", "digest"])

    held = written(map_arrow(src, hashes, "rank long, same long, digest long"))
    spread = held.groupBy("digest").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.count("*").alias("n")).where("first < last").select("digest", "first", "n")
    again = join_keyed(held, spread, "digest", "n", held.count()).where("rank > first")
    again = again.groupBy("rank", "same").agg(F.collect_set("digest").alias("again"))
    text = docs.select(_rank(F.col(id_col)).alias("rank"), F.xxhash64(text_col).alias("same"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carry)
    marked = text.join(again, ["rank", "same"], "left").select("doc_id", "text", "again", *carry)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                texts, n_units, gone, removed = [], [], [], []
                for t, known in zip(b.column(1), b.column(2), strict=True):
                    t = t.as_py()
                    cut = units(t)
                    spans = repeated_spans(cut, set(known.as_py() or ()), min_words)
                    texts.append(cut_out(t, spans) if spans else t)
                    n_units.append(sum(1 for u in cut if u[3]))
                    gone.append(sum(z - a for a, z in spans))
                    removed.append([{"start": a, "end": z} for a, z in spans])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                cols = [b.column(0), pa.array(texts, pa.string()), pa.array(n_units, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, kind)]
                yield pa.RecordBatch.from_arrays([*cols, *(b.column(i) for i in range(3, b.num_columns))], names=["doc_id", "text", "n_units", "n_removed_chars", "removed", *carry])

    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return map_arrow(marked, remove, f"doc_id {docs.schema[id_col].dataType.simpleString()}, text string, n_units long, n_removed_chars long, removed array<struct<start:int,end:int>>{kept}")
