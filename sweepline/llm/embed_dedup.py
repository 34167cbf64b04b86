"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits at random directions, near the median, and sends vectors close to a split to
both sides (spill). Vectors meet in the leaves, where cosines are computed exactly; the trees'
findings are verified links and are united. A pair that shares several leaves is counted only in
the first of them, so links need not be written out: a leaf returns link counts and a spanning
forest of its links, both no larger than the leaf.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow, prepare, sampled
from .common import by_blocks, join_keyed, salted_blocks
from .components import components


#: Most bytes of a forest's directions, which are broadcast: 256 MB.
FOREST_BYTES = 256 << 20
#: Most levels below a tree's last nodes; each leaves a child about SPLIT_SHARE of a node's rows, spill included.
DEEPER, SPLIT_SHARE = 30, 0.6


@dataclass
class Node:
    direction: np.ndarray | None = None
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None
    leaf: int = -1
    cuts: tuple[float, ...] = ()  # of the levels below, along the forest's deep directions


@dataclass
class Forest:
    trees: list[Node]
    deep: np.ndarray  # tree, level, component
    spill: float
    n_leaves: int

    def leaves(self, x: np.ndarray) -> list[np.ndarray]:
        """Of each row of x (unit vectors) the ascending ids of all leaves that it falls in."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for tree, deep in zip(self.trees, self.deep, strict=True):
            ends: list[tuple[Node, np.ndarray]] = []

            def walk(node: Node, rows: np.ndarray, ends: list = ends) -> None:
                if not len(rows):
                    return
                if node.direction is None:
                    ends.append((node, rows))
                    return
                side = x[rows] @ node.direction - node.cut
                walk(node.low, rows[side <= self.spill])
                walk(node.high, rows[side >= -self.spill])

            walk(tree, np.arange(len(x)))
            held.append(self._below(x @ deep.T, ends))
        rows, ids = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((ids, rows))
        return np.split(ids[order], np.cumsum(np.bincount(rows, minlength=len(x)))[:-1])

    def _below(self, along: np.ndarray, ends: list[tuple[Node, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaf ids after the levels below a tree's last nodes; a row may come several times."""
        depth = np.array([len(n.cuts) for n, _ in ends], dtype=int)
        cuts = np.zeros((len(ends), max(depth, default=0)))
        for i, (n, _) in enumerate(ends):
            cuts[i, : depth[i]] = n.cuts
        end = np.repeat(np.arange(len(ends)), [len(r) for _, r in ends])
        rows = np.concatenate([np.zeros(0, dtype=int), *[r for _, r in ends]])
        path = np.ones(len(rows), dtype=np.int64)
        for level in range(cuts.shape[1]):
            on = depth[end] > level
            side = along[rows, level] - cuts[end, level]
            low, high = ~on | (side <= self.spill), on & (side >= -self.spill)
            path = np.concatenate([np.where(on, 2 * path, path)[low], 2 * path[high] + 1])
            rows, end = np.concatenate([rows[low], rows[high]]), np.concatenate([end[low], end[high]])
        return rows, np.array([n.leaf for n, _ in ends], dtype=np.int64)[end] << 32 | path


def grow(sample: np.ndarray, n_trees: int, leaf_rows: int, rows_per_sample: float, spill: float, seed: int, forest_bytes: int = FOREST_BYTES) -> Forest:
    """Trees over a sample; a node is split while it stands for more than leaf_rows rows.

    Level by level, so that the forest stays whole where the bound on its directions' bytes ends it.
    A node that still stands for too many rows when its sample rows or the bytes run out is split
    further along directions that all such nodes of a tree share; of its own it has only the cuts,
    the medians of the sample rows that it holds.
    """
    rng = np.random.default_rng(seed)
    deep = rng.standard_normal((n_trees, DEEPER, sample.shape[1]))
    deep /= np.linalg.norm(deep, axis=2)[:, :, None]
    ids = iter(range(1 << 31))
    trees = []
    for t in range(n_trees):
        left = forest_bytes // (8 * n_trees * max(1, sample.shape[1]))
        root = Node()
        front = deque([(root, np.arange(len(sample)))])
        while front:
            node, rows = front.popleft()
            many = len(rows) * rows_per_sample / leaf_rows
            known = left and len(rows) >= 8
            for _ in range(3 if known and many > 1 else 0):
                w = rng.standard_normal(sample.shape[1])
                w /= np.linalg.norm(w)
                p = sample[rows] @ w
                cut = float(np.quantile(p, rng.uniform(0.4, 0.6)))
                low, high = rows[p <= cut + spill], rows[p >= cut - spill]
                if max(len(low), len(high)) < 0.9 * len(rows):
                    node.direction, node.cut, node.low, node.high = w, cut, Node(), Node()
                    front += [(node.low, low), (node.high, high)]
                    left -= 1
                    break
            else:  # small enough, or all rows lie close together: they are compared as they are
                node.leaf = next(ids)
                if many > 1 and not known and len(rows):
                    levels = min(DEEPER, int(np.ceil(np.log(many) / -np.log(SPLIT_SHARE))))
                    node.cuts = tuple(np.median(sample[rows] @ deep[t, :levels].T, axis=0).tolist())
        trees.append(root)
    return Forest(trees, deep, spill, next(ids))


def _usable(raw: list | None) -> bool:
    if raw is None:
        return False
    if any(v is None for v in raw):
        return False
    a = np.asarray(raw, dtype=np.float64)
    return bool(len(a) and np.isfinite(a).all() and np.dot(a, a) > 0)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", least_cosine: float = 0.93, n_trees: int = 8, leaf_rows: int = 600, spill: float = 0.02, sample_rows: int = 20_000, block_rows: int = 1500, seed: int = 7) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors are compared when their labels are equal and not null (all with all where label_col is
    None) and their lengths are equal, by cosine in double precision. Vectors that are null, empty,
    zero or hold null or non-finite components, and rows with a null label or id, link with
    nothing: n_links 0, component_id their own id. n_links counts other rows linked directly,
    copies included. Rows that repeat an id count as rows and share the id. kept: vec_id =
    component_id (null for a null id). Other columns are not read; an empty table gives no rows.

    Equal vectors are first collapsed, so copies cost nothing. The forest is fitted to about
    sample_rows vectors chosen by a hash and indexes every vector; its directions take FOREST_BYTES
    at most. Below nodes of fewer than eight sample rows, levels are added with the rows a label, so
    that leaves keep their size however many rows there are; each level costs a pair at the
    threshold some hundredths of its chance to meet in a tree. A leaf above block_rows rows, such as
    a large group of near copies, is cut into blocks that meet pairwise in tasks of their own; no
    pair in it is left out.
    """
    spark = prepare(vectors.sparkSession)
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), label.alias("label"))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels, vecs, bits = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1).to_pylist(), []
            for i, v, x in zip(ids, vecs, labels, strict=True):
                bits.append(np.asarray(v, dtype=np.float64).tobytes() if i is not None and x is not None and _usable(v) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(bits, pa.binary())], names=["id", "label", "bits"])

    rows = map_arrow(raw, normal, "id long, label string, bits binary").checkpoint()
    usable = rows.where("bits is not null")
    classes = usable.groupBy("label", "bits").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    # a rep can stand for several classes if ids repeat; the class key tells them apart
    classes = classes.withColumn("node", F.xxhash64("label", "bits")).checkpoint()

    n_rows = classes.count()
    if not n_rows:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    per_label = classes.groupBy("label", F.length("bits").alias("size")).agg(F.count("*").alias("n"))
    largest = per_label.agg(F.max("n")).first()[0]
    share = min(1.0, sample_rows / n_rows)
    chosen = classes.where(sampled(share, "bits")).select("bits").collect()
    by_size: dict[int, list[np.ndarray]] = {}
    for r in chosen:
        a = np.frombuffer(bytes(r["bits"]))
        by_size.setdefault(len(a), []).append(a / np.linalg.norm(a))
    # one forest for each length of vectors; rows of a length that the sample lacks share one leaf
    forests, first = {}, 0
    for size in sorted(by_size):
        x = np.array(by_size[size])
        f = grow(x, n_trees, leaf_rows, largest / len(x), spill, seed)
        forests[size] = (f, first)
        first += f.n_leaves
    shared = spark.sparkContext.broadcast(forests)  # of each length at most FOREST_BYTES

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            vecs = [np.frombuffer(v.as_py()) for v in b.column(1)]
            leaves: list = [None] * len(vecs)
            for size in {len(v) for v in vecs}:
                at = [i for i, v in enumerate(vecs) if len(v) == size]
                if size not in known:
                    for i in at:
                        leaves[i] = np.array([-size], dtype=np.int64)
                    continue
                f, start = known[size]
                x = np.array([vecs[i] for i in at])
                for i, got in zip(at, f.leaves(x / np.linalg.norm(x, axis=1)[:, None]), strict=True):
                    leaves[i] = got + (start << 32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(leaves, pa.list_(pa.int64()))], names=["label", "bits", "copies", "node", "leaves"])

    routed = map_arrow(classes.select("label", "bits", "copies", "node"), route, "label string, bits binary, copies long, node long, leaves array<long>").checkpoint()
    met = routed.withColumn("leaf", F.explode("leaves"))
    sizes = met.groupBy("label", "leaf").agg(F.count("*").alias("n")).where("n > 1")
    met = met.join(sizes, ["label", "leaf"]).withColumn("group", F.xxhash64("label", "leaf"))
    met = salted_blocks(met, ["group"], F.col("node"), F.ceil(F.col("n") / block_rows))

    def compare(t: pa.Table) -> dict | None:
        return _block(t, least_cosine)

    found = by_blocks(met.select("group", "block_a", "block_b", "piece", "leaf", "node", "copies", "bits", "leaves"), ["group", "block_a", "block_b"], compare, "node long, links long, low long").checkpoint()
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.where("low <> node").select(F.col("node").alias("a"), F.col("low").alias("b")))
    # nodes are hashes: the component's id is the smallest vec_id among the rows of its classes
    reps = classes.select("node", "rep").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = reps.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    by_node = join_keyed(classes.select("node", "copies").join(reps.select("node", "component"), "node"), least, "component", "n", n_rows).join(links, "node", "left")
    by_node = by_node.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    keyed = rows.select("id", F.when(F.col("bits").isNotNull(), F.xxhash64("label", "bits")).alias("node"))
    out = keyed.join(by_node, "node", "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _block(t: pa.Table, least: float) -> dict | None:
    """Link counts (pairs whose first common leaf this is) and a spanning forest of all links."""
    bits, node, copies = t["bits"].to_pylist(), t["node"].to_numpy(), t["copies"].to_numpy()
    piece, leaf = t["piece"].to_numpy(), int(t["leaf"][0].as_py())
    across = t["block_a"][0].as_py() != t["block_b"][0].as_py()
    x = np.array([np.frombuffer(b) for b in bits])
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= least
    np.fill_diagonal(hit, False)
    if across:
        hit &= piece[:, None] != piece[None, :]
    some = np.flatnonzero(hit.any(axis=1))
    if not len(some):
        return None
    hit, node, copies = hit[np.ix_(some, some)], node[some], copies[some]
    leaves = [np.asarray(t["leaves"][int(i)].as_py()) for i in some]
    earlier = sorted({int(v) for a in leaves for v in a if v < leaf})
    fresh = hit
    if earlier:
        at = {v: i for i, v in enumerate(earlier)}
        member = np.zeros((len(some), len(earlier)), dtype=np.float32)
        for i, a in enumerate(leaves):
            member[i, [at[int(v)] for v in a if v < leaf]] = 1
        fresh = hit & (member @ member.T == 0)
    links = fresh.astype(np.float64) @ copies
    return {"node": node.tolist(), "links": links.astype(np.int64).tolist(), "low": spanning(hit, node)}


def spanning(hit: np.ndarray, node: np.ndarray) -> list[int]:
    """Of each row the smallest node that it reaches over hits."""
    low = np.full(len(node), -1)
    for start in np.argsort(node, kind="stable"):
        if low[start] >= 0:
            continue
        front = np.array([start])
        low[start] = start
        while len(front):
            reach = hit[front].any(axis=0) & (low < 0)
            front = np.flatnonzero(reach)
            low[front] = start
    return node[low].tolist()
