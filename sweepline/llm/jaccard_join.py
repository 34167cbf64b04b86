"""Joins texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts with equal shingle sets form a class. Classes that share a band of MinHash values are
candidates; of each candidate pair the MinHash values are compared in steps, and it is dropped as
soon as the posterior probability that it reaches the threshold falls below a tolerance. What is
left is verified exactly on the shingle sets. Pairs are never written out: blocks of bounded size
return link counts and spanning forests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow, prepare
from .common import WORD, by_blocks, join_keyed, salted_blocks
from .components import components
from .embed_dedup import spanning

N_HASHES = 96
BAND_ROWS = 4  # 24 bands: a pair at 0.8 shares none with probability 3e-6
STEP = 16
SHINGLE = 5
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 1 << 63, N_HASHES, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, N_HASHES, dtype=np.uint64)
_ROLL = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


class Shingler:
    """Shingle sets as sorted arrays of 64-bit hashes; remembers word hashes, within a bound."""

    def __init__(self, remembered: int = 100_000):
        self.most, self.words = remembered, {}

    def shingles(self, text: str | None) -> np.ndarray:
        """Distinct shingles; of a text with one to four words the one shingle of all its words."""
        words = WORD.findall(text or "")
        if not words:
            return np.array([], dtype=np.uint64)
        known, digest = self.words, xxhash.xxh3_64_intdigest
        got = []
        for w in words:
            if (h := known.get(w)) is None:
                if len(known) >= self.most:
                    known.clear()
                h = known[w] = digest(w)
            got.append(h)
        h = np.array(got, dtype=np.uint64)
        n = max(1, len(h) - SHINGLE + 1)
        out = np.full(n, len(h) if len(h) < SHINGLE else SHINGLE, dtype=np.uint64)
        for i in range(min(SHINGLE, len(h))):
            out = (out ^ (h[i : i + n] * _ROLL[i])) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """N_HASHES values of 32 bits."""
    low = np.full(N_HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        x = shingles[at : at + 2048]
        np.minimum(low, (x[None, :] * _MUL[:, None] + _ADD[:, None]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


@lru_cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """After STEP, 2 * STEP, ... values: the fewest matches with P(similarity >= threshold) >= tolerance.

    With a uniform prior, m matches of n leave a Beta(m + 1, n - m + 1) posterior, whose upper tail
    at t is the chance of at most m successes in n + 1 trials of probability t.
    """
    out = []
    for n in range(STEP, N_HASHES + 1, STEP):
        tail, m = 0.0, 0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
        out.append(m)
    return tuple(out)


def survivors(sigs: np.ndarray, least: tuple[int, ...], allowed: np.ndarray | None = None) -> np.ndarray:
    """Symmetric matrix of the pairs that no step drops."""
    n = len(sigs)
    alive = np.zeros((n, n), dtype=bool)
    for i in range(n - 1):
        js = np.arange(i + 1, n) if allowed is None else i + 1 + np.flatnonzero(allowed[i, i + 1 :])
        same = np.zeros(len(js), dtype=np.int32)
        for k, need in enumerate(least):
            if not len(js):
                break
            at = slice(k * STEP, (k + 1) * STEP)
            same = same + (sigs[js, at] == sigs[i, at]).sum(axis=1)
            ok = same >= need
            js, same = js[ok], same[ok]
        alive[i, js] = alive[js, i] = True
    return alive


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairs' intersections, by matrix products over slices of the shared shingles."""
    n = len(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    values, cols, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[cols] > 1
    rows, cols = rows[keep], cols[keep]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    _, cols = np.unique(cols, return_inverse=True)
    out = np.zeros((n, n), dtype=np.float64)
    width = 4096
    for start in range(0, int(cols[-1]) + 1 if len(cols) else 0, width):
        a, b = np.searchsorted(cols, [start, start + width])
        m = np.zeros((n, width), dtype=np.float32)
        m[rows[a:b], cols[a:b] - start] = 1
        out += m @ m.T
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, set_hash (two halves of a digest of the shingle set; null for a text without words), n_shingles, sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                a1, a2, n, sig = [], [], [], []
                for t in b.column(1):
                    s = shingler.shingles(t.as_py())
                    if len(s):
                        d = xxhash.xxh3_128_digest(s.tobytes())
                        a1.append(int.from_bytes(d[:8], "big", signed=True))
                        a2.append(int.from_bytes(d[8:], "big", signed=True))
                        sig.append(minhash(s).tobytes())
                    else:
                        a1.append(None)
                        a2.append(None)
                        sig.append(None)
                    n.append(len(s))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(a1, pa.int64()), pa.array(a2, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "set_a", "set_b", "n_shingles", "sig"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, set_a long, set_b long, n_shingles long, sig binary")


def join_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, tolerance: float = 1e-5, block_rows: int = 800, block_shingles: int = 4_000_000) -> DataFrame:
    """One row per input row: doc_id, n_links, component_id, kept.

    n_links counts the other rows whose text is linked directly, copies included. component_id is
    the smallest doc_id reachable over links, kept tells whether that is the row's own. Null and
    empty texts, which have no shingles, and rows with a null id link with nothing (component_id
    their id, kept true). Texts of one to four words have one shingle, all their words. Rows that
    repeat an id count as rows and share the id. Other columns are not read. No cap on partners or
    candidates: groups too large for a task are cut into blocks that meet pairwise.
    """
    prepare(docs.sparkSession)
    signed = signatures(docs, id_col, text_col).checkpoint()
    rows = signed.where("doc_id is not null and set_a is not null")
    classes = rows.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    classes = classes.select(F.col("set_a").alias("node"), "set_b", "rep", "copies", "sig", "n_shingles").checkpoint()

    # bands that two classes share
    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for s in b.column(1):
                v = np.frombuffer(s.as_py(), dtype=np.uint32).reshape(-1, BAND_ROWS)
                keys.append([xxhash.xxh3_64_intdigest(r.tobytes(), seed=i) - (1 << 63) for i, r in enumerate(v)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["node", "keys"])

    banded = map_arrow(classes.select("node", "sig"), bands, "node long, keys array<long>").select("node", F.explode("keys").alias("band")).checkpoint()
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = banded.join(shared, "band").join(classes.select("node", "sig"), "node")
    met = salted_blocks(met, ["band"], F.col("node"), F.ceil(F.col("n") / block_rows))
    least = least_matches(threshold, tolerance)

    def candidates(t: pa.Table) -> dict | None:
        node = t["node"].to_numpy()
        sigs = np.array([np.frombuffer(s, dtype=np.uint32) for s in t["sig"].to_pylist()])
        allowed = _across(t)
        if len(node) == 2:  # the usual case, without matrices
            at, same = 0, 0
            for k, need in enumerate(least):
                at = slice(k * STEP, (k + 1) * STEP)
                same += int((sigs[0, at] == sigs[1, at]).sum())
                if same < need:
                    return None
            if allowed is not None and not allowed[0, 1]:
                return None
            return {"a": [int(node.max())], "b": [int(node.min())]}
        alive = survivors(sigs, least, allowed)
        if not alive.any():
            return None
        low = spanning(alive, node)
        pairs = [(int(a), int(b)) for a, b in zip(node, low, strict=True) if a != b]
        return {"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}

    edges = by_blocks(met.select("band", "block_a", "block_b", "piece", "node", "sig"), ["band", "block_a", "block_b"], candidates, "a long, b long")
    groups = components(edges).withColumnRenamed("component", "group").checkpoint()

    # exact check within groups of candidates
    sizes = classes.join(groups, "node").groupBy("group").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    wanted = classes.join(groups, "node").join(sizes, "group").select("rep", "set_b", "node", "group", "n", "total", "copies", "sig")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                sets = [shingler.shingles(t.as_py()) for t in part.column(0)]
                # a row that repeats the id with another text is not the class's
                same = [i for i, (s, k) in enumerate(zip(sets, part.column(1).to_pylist(), strict=True)) if int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "big", signed=True) == k]
                part = part.take(pa.array(same, pa.int64()))
                cols = [part.column(i) for i in range(1, part.num_columns)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([sets[i].tobytes() for i in same], pa.binary())], names=["node", "group", "n", "total", "copies", "sig", "set"])

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).where("rep is not null and text is not null")
    full = texts.join(wanted, "rep").select("text", "node", "group", "n", "total", "copies", "sig")
    full = map_arrow(full, expand, "node long, group long, n long, total long, copies long, sig binary, set binary").dropDuplicates(["node"])
    pieces = F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("total") / block_shingles))
    full = salted_blocks(full, ["group"], F.col("node"), pieces)

    def verify(t: pa.Table) -> dict | None:
        node, copies = t["node"].to_numpy(), t["copies"].to_numpy()
        sigs = np.array([np.frombuffer(s, dtype=np.uint32) for s in t["sig"].to_pylist()])
        alive = survivors(sigs, least, _across(t))
        some = np.flatnonzero(alive.any(axis=1))
        if not len(some):
            return None
        raw = t["set"].to_pylist()
        sets = [np.frombuffer(raw[i], dtype=np.uint64) for i in some]
        n = np.array([len(s) for s in sets], dtype=np.float64)
        both = overlaps(sets)
        hit = alive[np.ix_(some, some)] & (both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9)
        node, copies = node[some], copies[some]
        return {"node": node.tolist(), "links": (hit.astype(np.float64) @ copies).astype(np.int64).tolist(), "low": spanning(hit, node)}

    found = by_blocks(full.select("group", "block_a", "block_b", "piece", "node", "copies", "sig", "set"), ["group", "block_a", "block_b"], verify, "node long, links long, low long").checkpoint()
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.where("low <> node").select(F.col("node").alias("a"), F.col("low").alias("b")))
    reps = classes.select("node", "rep", "copies").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = reps.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    by_node = join_keyed(reps, first, "component", "n", classes.count()).join(links, "node", "left")
    by_node = by_node.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    keyed = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("set_a")).alias("node"))
    out = keyed.join(by_node, "node", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _across(t: pa.Table) -> np.ndarray | None:
    """Pairs that this block is to count; None for all."""
    if t["block_a"][0].as_py() == t["block_b"][0].as_py():
        return None
    piece = t["piece"].to_numpy()
    return piece[:, None] != piece[None, :]
