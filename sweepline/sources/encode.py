"""Writes radials as chunk bytes, the inverse of the decoder in chunks.py."""

from __future__ import annotations

import bz2
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_arrow
from .chunks import CUT_BYTES, HEADER, LEGACY_RECORD, LIMIT, MOMENT, RADIAL, RRAD, RVOL, VCP_HEADER, VOLUME_HEADER, unwrap


def encode_moment(m: dict) -> bytes:
    raw = np.asarray(m["raw"], dtype=np.int32)
    word = 16 if len(raw) and raw.max() > 255 else 8
    mark = m["product"].encode().ljust(4)
    head = MOMENT.pack(mark, MOMENT.size, 1, len(raw), m["first_gate_m"], m["gate_width_m"], 0, 0, 0, word, m["scale"], m["offset"])
    return head + raw.astype(">u2" if word == 16 else "u1").tobytes()


def encode_volume(r: dict) -> bytes:
    """The RVOL block of a radial's position and VCP; what else it holds are zeros."""
    return RVOL.pack(b"RVOL", RVOL.size, 1, 0, r["latitude"], r["longitude"], r["site_amsl_m"], 0, 0, 0, 0, 0, 0, r["rvol_vcp"], 0)


def encode_constants(r: dict) -> bytes:
    """The RRAD block: unambiguous range in eighths of a kilometre, Nyquist velocity in hundredths of m/s."""
    return RRAD.pack(b"RRAD", RRAD.size, round(r["unamb_range"] * 8), 0, 0, round(r["nyquist"] * 100))


def _message(kind: int, body: bytes, date: int, ms: int) -> bytes:
    body += bytes(len(body) % 2)
    return bytes(12) + HEADER.pack((16 + len(body)) // 2, 0, kind, 0, date, ms, 1, 1) + body


def encode_radial(r: dict) -> bytes:
    """A radial message with its moments, and RVOL and RRAD blocks where rvol_vcp and nyquist are given."""
    first = [encode_volume(r) if r.get("rvol_vcp") is not None else b"", b"", encode_constants(r) if r.get("nyquist") is not None else b""]
    blocks = [*first, *(encode_moment(m) for m in r["moments"] or ())]
    at, pointers = RADIAL.size + 4 * len(blocks), []
    for b in blocks:
        pointers.append(at if b else 0)
        at += len(b)
    head = RADIAL.pack(r["site_id"].encode().ljust(4)[:4], r["scan_time_ms"], r["julian_date"], r["azimuth_number"], r["azimuth_deg"], 0, 0, 0, r["azimuth_spacing_code"], r["radial_status"], r["elevation_number"], 0, r["elevation_deg"], 0, 0, len(pointers))
    out = _message(31, head + struct.pack(f">{len(pointers)}I", *pointers) + b"".join(blocks), r["julian_date"], r["scan_time_ms"])
    return out + bytes(-len(out) % 4)


def encode_vcp(v: dict, date: int = 20000) -> bytes:
    """A volume coverage pattern (message 5) of one record; at most some fifty cuts fit."""
    body = VCP_HEADER.pack((VCP_HEADER.size + CUT_BYTES * len(v["cuts"])) // 2, 2, v["vcp_number"], len(v["cuts"]), 0, 0, 0, 0, 0, 0, 0, 0)
    for c in v["cuts"]:
        body += struct.pack(">HBBB", round(c["elevation_deg"] * 65536 / 360), c["channel_config"], c["waveform"], c["super_res"]) + bytes(CUT_BYTES - 5)
    return _message(5, body, date, 0).ljust(LEGACY_RECORD, b"\0")


def encode_chunk(kind: str, radials: list[dict], vcp: dict | None) -> bytes:
    """S: header, pattern, radials, end mark. E: one block, its length negative. I: blocks."""
    z = bz2.compress(b"".join(map(encode_radial, radials)))
    if kind == "E":
        return struct.pack(">i", -len(z)) + z
    out = struct.pack(">I", len(z)) + z
    if kind == "I":
        return out
    r = radials[0]
    p = bz2.compress(encode_vcp(vcp)) if vcp else b""
    return b"AR2V0006.001" + struct.pack(">II", r["julian_date"], r["scan_time_ms"]) + r["site_id"].encode().ljust(4)[:4] + (struct.pack(">I", len(p)) + p if p else b"") + out + b"\xff" * 4


SLICE = 200  # chunks that are turned into Python's objects at a time


def groups(lists: pa.ListArray) -> Iterator[list[dict] | None]:
    """to_pylist() of a list of structs, column by column: raw, which may be long, as views of one array."""
    flat = lists.flatten()
    names = [f.name for f in flat.type]
    columns = []
    for name, c in zip(names, flat.flatten(), strict=True):
        if pa.types.is_list(c.type) and pa.types.is_struct(c.type.value_type):
            columns.append(groups(c))
        elif pa.types.is_list(c.type):
            values, at = c.flatten().to_numpy(zero_copy_only=False), 0
            parts = []
            for k in pc.list_value_length(c).fill_null(0).to_pylist():
                parts.append(values[at : at + k])
                at += k
            columns.append(parts)
        else:
            columns.append(c.to_pylist())
    rows = (dict(zip(names, r, strict=True)) for r in zip(*columns, strict=True))
    for k in pc.list_value_length(lists).to_pylist():
        yield None if k is None else list(islice(rows, k))


OPTIONAL = ("rvol_vcp", "latitude", "longitude", "site_amsl_m", "unamb_range", "nyquist")


def encode_chunks(radials: DataFrame, keys: tuple[str, ...] = ("site", "volume_seq", "chunk_no"), vcps: DataFrame | None = None) -> DataFrame:
    """Chunks: keys, kind, content. One chunk per key, its radials by scan_time_ms.

    radials: keys, kind (I where there is no such column), site_id, julian_date, scan_time_ms,
    azimuth_deg, elevation_deg, azimuth_number, azimuth_spacing_code, radial_status,
    elevation_number, moments (array of structs), and of OPTIONAL what there is. vcps: keys,
    vcp_number, cuts; it is written to S chunks. A chunk has some hundred radials, which bounds the
    groups.
    """
    fields = ("scan_time_ms", "site_id", "julian_date", "azimuth_deg", "elevation_deg", "azimuth_number", "azimuth_spacing_code", "radial_status", "elevation_number", "moments", *(c for c in OPTIONAL if c in radials.columns))
    kind = F.min("kind") if "kind" in radials.columns else F.lit("I")
    grouped = radials.groupBy(*keys).agg(kind.alias("kind"), F.array_sort(F.collect_list(F.struct(*fields))).alias("radials"))
    if vcps is not None:
        grouped = grouped.join(vcps.select(*keys, F.struct("vcp_number", "cuts").alias("vcp")), list(keys), "left")
    else:
        grouped = grouped.withColumn("vcp", F.lit(None).cast("struct<vcp_number:int,cuts:array<struct<elevation_deg:double,channel_config:int,waveform:int,super_res:int>>>"))
    grouped = grouped.select(*keys, "kind", "radials", "vcp")
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                out = [encode_chunk(k, rs, v) for k, rs, v in zip(b.column(n).to_pylist(), groups(b.column(n + 1)), b.column(n + 2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n + 1)), pa.array(out, pa.binary())], names=[*keys, "kind", "content"])

    kinds = ", ".join(f"{k} {grouped.schema[k].dataType.simpleString()}" for k in keys)
    return map_arrow(grouped, run, f"{kinds}, kind string, content binary")


def write_volumes(chunks: DataFrame, folder: str, plain: bool = False) -> None:
    """Write chunks (site, volume_seq, chunk_no, kind, content; an S first) as one archive file a volume.

    plain: the messages as they are, without records, as old volumes have them. A volume is some tens of megabytes,
    which bounds a group.
    """
    whole = chunks.groupBy("site", "volume_seq").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "kind", "content"))).alias("c"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for b in batches:
            for site, volume, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if plain:
                    data = parts[0]["content"][:VOLUME_HEADER] + b"".join(unwrap(p["content"], p["kind"], LIMIT) for p in parts)
                else:
                    data = b"".join(p["content"][:-4] if p["kind"] == "S" else p["content"] for p in parts)
                with store.open_output_stream(f"{base}/.{site}-{volume}.part") as f:
                    f.write(data)
                store.move(f"{base}/.{site}-{volume}.part", f"{base}/{site}-{volume}")
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    map_arrow(whole, put, "n long").agg(F.sum("n")).collect()
