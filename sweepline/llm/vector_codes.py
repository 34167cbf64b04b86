"""Compresses vectors to codes of their parts' nearest codebook entries, trained by rounds of k-means.

Every part of a vector keeps lower bounds on its distance to groups of entries, each bound with the
stamp of the round that measured it. All earlier codebooks are kept, so that a bound is weakened by
how far its entries are in truth from where they stood at its stamp (the norm of the summed steps)
and not by the sum of the steps' norms, which is never less. Only groups whose bound does not
exceed the distance to the assigned entry are measured anew. All of it is exact: components are
integers, and bounds give way by more than the rounding of square roots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import delete, map_arrow, prepare, shared_path, written
from .common import join_keyed

#: Components of this size and more count as non-finite: sums of their squares would not fit into 64 bits.
LARGEST = float(1 << 17)
SLACK = 1e-9
GROUP = 4  # entries that share a bound


@dataclass
class Codebooks:
    """history[r][part] holds the entries that round r assigns to; the last are the final ones."""

    cuts: list[int]
    history: list[list[np.ndarray]]
    #: Of each assignment: distances measured, and distances that a full scan takes
    measured: list[tuple[int, int]] = field(default_factory=list)

    @property
    def final(self) -> list[np.ndarray]:
        return self.history[-1]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for part in self.final for v in part.ravel()).encode()).hexdigest()


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    d = x[:, None, :] - entries[None]
    return np.einsum("nkw,nkw->nk", d, d)


def assign_part(x: np.ndarray, history: list[np.ndarray], code: np.ndarray | None, bounds: np.ndarray, stamps: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entries of the last codebook, their squared distances, and how many distances were measured.

    x: rows of one part (int64). code: the entries assigned last, None at first. bounds and stamps
    (a column per group of entries) are brought up to date in place. A bound holds for the group's
    entries other than the assigned one.
    """
    now, n_now = history[-1], len(history) - 1
    k, n = len(now), len(x)
    groups = [np.arange(g, min(g + GROUP, k)) for g in range(0, k, GROUP)]
    if code is None:
        d = _distances(x, now)
        best = d.argmin(axis=1)
        nearest = d[np.arange(n), best]
        d = d.astype(np.float64)
        d[np.arange(n), best] = np.inf
        for g, members in enumerate(groups):
            bounds[:, g] = np.sqrt(d[:, members].min(axis=1)) * (1 - SLACK)
        stamps[:] = n_now
        return best, nearest, n * k
    step = x - now[code]
    nearest, best = np.einsum("nw,nw->n", step, step), code.copy()
    # how far the entries of each group are from where they stood at each stamp
    net = np.array([[np.sqrt(((now[m] - old[m]).astype(np.float64) ** 2).sum(axis=1)).max() for m in groups] for old in history])
    reach = np.sqrt(nearest.astype(np.float64)) * (1 + SLACK) + SLACK
    open_ = bounds - net[stamps, np.arange(len(groups))] * (1 + SLACK) <= reach[:, None]
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    count = n
    for g, members in enumerate(groups):
        rows = np.flatnonzero(open_[:, g])
        if not len(rows):
            continue
        d = _distances(x[rows], now[members])
        count += d.size
        at = d.argmin(axis=1)
        least, entry = d[np.arange(len(rows)), at], members[at]
        better = (least < nearest[rows]) | ((least == nearest[rows]) & (entry < best[rows]))
        nearest[rows[better]], best[rows[better]] = least[better], entry[better]
        held.append((g, rows, d))
    # the group of an entry that lost a row did not bound that entry so far
    moved = np.flatnonzero(best != code)
    for g in np.unique(code[moved] // GROUP):
        rows = moved[(code[moved] // GROUP == g) & ~open_[moved, g]]
        if len(rows):
            d = _distances(x[rows], now[groups[g]])
            count += d.size
            held.append((int(g), rows, d))
    for g, rows, d in held:
        d = d.astype(np.float64)
        own = best[rows] // GROUP == g
        d[np.flatnonzero(own), best[rows[own]] - g * GROUP] = np.inf
        bounds[rows, g] = np.sqrt(d.min(axis=1)) * (1 - SLACK)
        stamps[rows, g] = n_now
    return best, nearest, count


def to_integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(vec_id, label, bits): floor(scale * x) of every component as int32; unusable vectors are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            sizes = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            values = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
            fine = np.abs(values) < LARGEST  # null components are NaN here
            ends = np.cumsum(sizes)
            broken = np.concatenate([[0], np.cumsum(~fine)])
            keep = (broken[ends] == broken[ends - sizes]) & (sizes > 0)
            q = np.floor(np.where(fine, values, 0.0) * scale).astype(np.int32)
            bits = [q[e - s : e].tobytes() for s, e in zip(sizes[keep], ends[keep], strict=True)]
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask), pa.array(bits, pa.binary())], names=["vec_id", "label", "bits"])

    src = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return map_arrow(src, run, f"vec_id {src.schema['vec_id'].dataType.simpleString()}, label {src.schema['label'].dataType.simpleString()}, bits binary")


def _assigner(books: Codebooks, last: bool):
    """A task's work in a round: rows with new codes and bounds and, as a last row of its own, what they add to each entry."""
    cuts, history = books.cuts, books.history
    n_parts, k = len(cuts) - 1, len(history[0][0])
    n_groups = -(-k // GROUP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((k, b - a), dtype=np.int64) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        used, measured, scan = np.zeros((n_parts, k), dtype=np.int64), 0, 0
        names = None
        for b in batches:
            names, types = b.schema.names, b.schema.types
            n = b.num_rows
            if not n:
                continue
            x = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.int32).reshape(n, -1).astype(np.int64)
            first = b.column(3).null_count > 0
            if first:
                code = np.zeros((n, n_parts), dtype=np.uint8)
                bounds, stamps = np.zeros((n, n_parts, n_groups)), np.zeros((n, n_parts, n_groups), dtype=np.uint8)
            else:
                code = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=np.uint8).reshape(n, n_parts).copy()
                bounds = np.frombuffer(b"".join(b.column(4).to_pylist())).reshape(n, n_parts, n_groups).copy()
                stamps = np.frombuffer(b"".join(b.column(5).to_pylist()), dtype=np.uint8).reshape(n, n_parts, n_groups).copy()
            error = np.zeros(n, dtype=np.int64)
            for p in range(n_parts):
                part = x[:, cuts[p] : cuts[p + 1]]
                got, near, count = assign_part(part, [h[p] for h in history], None if first else code[:, p].astype(np.int64), bounds[:, p], stamps[:, p])
                code[:, p] = got
                error += near
                measured, scan = measured + count, scan + n * k
                np.add.at(sums[p], got, part)
                used[p] += np.bincount(got, minlength=k)
            if last:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in code]), pa.array(error)], names=["vec_id", "label", "code", "error"])
            else:
                rows = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (code, bounds, stamps)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *rows, pa.nulls(n, pa.list_(pa.int64()))], names=[*names[:6], "sums"])
        if names and not last:
            flat = np.concatenate([*[s.ravel() for s in sums], used.ravel(), [measured, scan]]).tolist()
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in types[:6]], pa.array([flat], pa.list_(pa.int64()))], names=[*names[:6], "sums"])

    return run


def train(rows: DataFrame, n_parts: int, n_entries: int, rounds: int, size: int) -> tuple[Codebooks, DataFrame]:
    """Codebooks after the rounds, and the rows with their last codes, bounds and stamps.

    rows: what to_integers gives, all of `size` components. Each round reads what the last one wrote
    to the shared folder, which is deleted once the next is complete. To the driver come the
    entries' sums only, added up by Spark.
    """
    spark = rows.sparkSession
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "bits").limit(n_entries).collect()
    cuts = [i * size // n_parts for i in range(n_parts + 1)]
    first = np.array([np.frombuffer(bytes(r["bits"]), dtype=np.int32) for r in start], dtype=np.int64)
    books = Codebooks(cuts, [[first[:, a:b].copy() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]])
    k = len(first)
    none = F.lit(None).cast("binary")
    state, path = rows.withColumns({"code": none, "bounds": none, "stamps": none}), None
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, bits binary, code binary, bounds binary, stamps binary, sums array<long>"
    for _ in range(rounds):
        new = shared_path(spark, "codes")
        map_arrow(state, _assigner(books, last=False), schema).write.parquet(new)
        held = spark.read.schema(schema).parquet(new)
        total = held.where("sums is not null").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        sums = [int(r["v"]) for r in sorted(total.collect(), key=lambda r: r["at"])]  # one number per component of an entry
        used, here, entries = sums[size * k :], 0, []
        for p in range(n_parts):
            w, old = cuts[p + 1] - cuts[p], books.final[p]
            mean = [[sums[here + j * w + i] // n for i in range(w)] if (n := used[p * k + j]) else old[j].tolist() for j in range(k)]
            entries.append(np.array(mean, dtype=np.int64).reshape(k, w))
            here += k * w
        books.history.append(entries)
        books.measured.append((sums[-2], sums[-1]))
        if path:
            delete(spark, path)
        state, path = held.where("sums is null").drop("sums"), new
    return books, state


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", n_parts: int = 8, n_entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error, label_error) of every usable vector, and the codebooks.

    Components become floor(scale * x). Codebooks begin with the parts of the n_entries vectors of
    smallest id (with fewer vectors, as many entries); each round assigns all parts and moves the
    entries to the floors of their means, and a last assignment gives the codes: two hex digits a
    part. Ties go to the lower entry, an entry without parts stays. error sums squared distances over parts,
    label_error over the rows of equal labels, nulls together.

    Vectors that are null or empty, that hold null or non-finite components or such of 2^17 and more,
    and those that are not as long as most (the shorter of equally many) are dropped. Parts are
    equal where n_parts divides the length, else they differ by one component. Rows that repeat an id
    count as rows, and begin the codebooks in order of their components; null ids come last. Other columns are not
    read; an empty table gives no rows and no codebooks.
    """
    spark = prepare(vectors.sparkSession)
    if not 1 <= n_entries <= 256 or not 1 <= rounds <= 255:
        raise ValueError("codes and stamps take a byte: 256 entries and 255 rounds at most")
    rows = written(to_integers(vectors, id_col, vector_col, label_col, scale))
    sizes = rows.groupBy(F.octet_length("bits").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    kind = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    if not sizes:
        return spark.createDataFrame([], f"{kind}, code string, error long, label_error long"), None
    rows = rows.where(F.octet_length("bits") == sizes[0]["size"])
    books, state = train(rows, n_parts, n_entries, rounds, sizes[0]["size"] // 4)
    coded = written(map_arrow(state, _assigner(books, last=True), f"{kind}, code string, error long"))
    keyed = coded.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = keyed.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    out = join_keyed(keyed, sums, "key", "n", sizes[0]["n"])
    return out.select("vec_id", "label", "code", "error", "label_error"), books
