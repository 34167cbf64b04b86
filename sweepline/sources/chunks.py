"""Reads chunk objects and decodes them: bytes in, typed rows out, in one Python pass.

A chunk that cannot be read gives one row with its error and nothing else; other chunks of the job
are not affected.
"""

from __future__ import annotations

import bz2
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import PRODUCTS
from ..functions.rules import parse_object_keys
from ..functions.values import nexrad_timestamp
from ..runtime import map_arrow

# Fixed values of the format.
VOLUME_HEADER, LEGACY_RECORD, CTM, MESSAGE_HEADER = 24, 2432, 12, 16
BODY = CTM + MESSAGE_HEADER
LIMIT = 32 << 20  # decompressed bytes of a chunk
SNIFF_BZIP, SNIFF_VOLUME = b"BZh9", b"AR2V"
HEADER = struct.Struct(">HBBHHIHH")  # size in halfwords, channel, type, sequence, date, ms, segments, segment
RADIAL = struct.Struct(">4sIHHfBBHBBBBfBBH")
RVOL = struct.Struct(">4sHBBffhHfffffHH")
RRAD = struct.Struct(">4sHHffH")
RELV = struct.Struct(">4sHhf")
MOMENT = struct.Struct(">4sHHHHHHHBBff")
VCP_HEADER = struct.Struct(">HHHHBBBBIHHH")
CUT_BYTES = 46
SLICE = 200  # chunks that a task looks at together
STREAM_BYTES = 4 << 20  # decompressed bytes that a task hands on together


def read_chunks(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """Every chunk object below a folder: site, volume_seq, chunk_no, chunk_ts, kind, reason, path, arrival, content.

    ordered: by site, volume (as a number) and chunk, objects with other names last, by path. It sorts all
    contents, which nothing else here needs: assembly orders by the keys.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*-[SIE]").option("recursiveFileLookup", "true").load(path)
    out = _keyed(files)
    return out.orderBy(F.col("reason").isNotNull(), "site", "volume_seq", "chunk_no", "path") if ordered else out


def stream_chunks(spark: SparkSession, path: str, max_files: int = 32) -> DataFrame:
    """The same as a stream; a micro-batch is committed as a whole or not at all."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*-[SIE]").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(path)
    return _keyed(files)


def _keyed(files: DataFrame) -> DataFrame:
    key = F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)$", 1)
    out = parse_object_keys(files.withColumn("key", key), "key")
    return out.select("site", "volume_seq", "chunk_no", "chunk_ts", "kind", "reason", "path", F.col("modificationTime").alias("arrival"), "content")


def write_chunks(chunks: DataFrame, folder: str) -> None:
    """Write chunks (site, volume_seq, chunk_no, kind, content) as objects below a folder, named as read_chunks() wants them.

    A task writes each object beside its place and moves it there, so that readers see whole ones
    and a task that runs again writes the same.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        at = None
        for b in batches:
            for site, volume, number, kind, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != (at := f"{base}/{site}/{volume}"):
                    store.create_dir(at)
                name = f"20200101-000000-{number:03d}-{kind}"
                with store.open_output_stream(f"{at}/.{name}.part") as f:
                    f.write(content)
                store.move(f"{at}/.{name}.part", f"{at}/{name}")
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    spark = chunks.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    rows = chunks.select("site", F.col("volume_seq").cast("long"), F.col("chunk_no").cast("long"), "kind", "content")
    map_arrow(rows, put, "n long").agg(F.sum("n")).collect()


def sniffed_kind(content: Column) -> Column:
    """S, E or I from the first bytes (E before I: both have the same mark, E a negative length);
    null where they are too short or unknown."""
    mark = lambda at: F.substring(content, at + 1, 4)
    negative = F.conv(F.hex(F.substring(content, 1, 1)), 16, 10).cast("int") >= 128
    return F.when(F.octet_length(content) < 8, None).when(mark(0) == F.lit(SNIFF_VOLUME), "S").when(mark(4) == F.lit(SNIFF_BZIP), F.when(negative, "E").otherwise("I")).when((F.octet_length(content) >= 32) & (mark(28) == F.lit(SNIFF_BZIP)), "S")


def classify_chunks(chunks: DataFrame) -> DataFrame:
    """Add detected, and error TooShort or UnrecognizedFormat where there is none."""
    out = chunks.withColumn("detected", sniffed_kind(F.col("content")))
    return out.withColumn("error", F.when(F.col("detected").isNull(), F.when(F.coalesce(F.octet_length("content"), F.lit(0)) < 8, "TooShort").otherwise("UnrecognizedFormat")))


def check_chunk_kind(chunks: DataFrame) -> DataFrame:
    """Add (or fill) error KindMismatch where the name's kind is not the detected one."""
    before = F.col("error") if "error" in chunks.columns else F.lit(None).cast("string")
    return chunks.withColumn("error", F.coalesce(before, F.when(~F.col("kind").eqNullSafe(F.col("detected")), "KindMismatch")))


def read_volume_headers(chunks: DataFrame) -> DataFrame:
    """file_type, extension, volume_date, volume_ms, icao, volume_ts of chunks with a 24-byte header."""
    c = F.col("content")
    text = lambda at, n: F.decode(F.substring(c, at + 1, n), "US-ASCII")
    number = lambda at: F.conv(F.hex(F.substring(c, at + 1, 4)), 16, 10).cast("long")
    out = chunks.where((F.octet_length(c) >= VOLUME_HEADER) & (F.substring(c, 1, 4) == F.lit(SNIFF_VOLUME)))
    out = out.withColumns({"file_type": text(0, 9), "extension": text(9, 3), "volume_date": number(12), "volume_ms": number(16), "icao": text(20, 4)})
    return out.withColumn("volume_ts", nexrad_timestamp(F.col("volume_date"), F.col("volume_ms"))).drop("content")


class ChunkError(Exception):
    """The message is one of the error names; nothing of the chunk is kept."""


def decompress(content: bytes, kind: str, limit: int = LIMIT) -> bytes:
    """The message stream of a chunk. All blocks share one budget of decompressed bytes."""
    spans, at = [], VOLUME_HEADER if kind == "S" else 0
    if kind == "E":
        size = abs(int.from_bytes(content[:4], "big", signed=True))
        spans.append((4, 4 + size))
    else:
        if kind == "S" and len(content) < VOLUME_HEADER + 4:
            raise ChunkError("TooShort")
        while at + 4 <= len(content):
            size = int.from_bytes(content[at : at + 4], "big")
            if kind == "S" and size == 0xFFFFFFFF:
                break
            spans.append((at + 4, at + 4 + size))
            at += 4 + size
    out, left = [], limit
    for a, b in spans:
        if b > len(content):
            raise ChunkError("TooShort")
        if a == b:
            continue
        d = bz2.BZ2Decompressor()  # a block is one bzip2 stream; what follows it in the block is not read
        try:
            part = d.decompress(content[a:b], left + 1)
        except (OSError, EOFError) as e:
            raise ChunkError("Decompression") from e
        if len(part) > left:
            raise ChunkError("DecompressedTooLarge")
        if not d.eof:
            raise ChunkError("Decompression")
        out.append(part)
        left -= len(part)
    return b"".join(out)


def message_bytes(head: bytes) -> int:
    """How far the next message is from one with these first bytes."""
    size, kind = HEADER.unpack_from(head, CTM)[0] * 2, HEADER.unpack_from(head, CTM)[2]
    return (CTM + size + 3) // 4 * 4 if size and kind == 31 else LEGACY_RECORD


def walk(stream: bytes) -> Iterator[tuple[int, tuple, bytes]]:
    """(offset, header, record) of each message; a radial message that is cut off ends in an error."""
    at, n = 0, len(stream)
    while at + BODY <= n:
        head = HEADER.unpack_from(stream, at + CTM)
        size = head[0] * 2
        if size == 0:
            at += LEGACY_RECORD
        elif head[2] == 31:
            if at + CTM + size > n:
                raise ChunkError("Truncated")
            yield at, head, stream[at : at + CTM + size]
            at += (CTM + size + 3) // 4 * 4
        else:
            yield at, head, stream[at : min(at + LEGACY_RECORD, n)]
            at += LEGACY_RECORD


def _block(body: bytes, at: int, layout: struct.Struct, mark: bytes) -> tuple | None:
    """A block's fields; None if the pointer is 0 or leads out of the body, or the mark differs."""
    if at == 0 or at + layout.size > len(body) or body[at : at + 4] != mark:
        return None
    return layout.unpack_from(body, at)


SITE_NAMES = ("latitude", "longitude", "site_amsl_m", "feedhorn_agl_m", "calib_dbz", "txpower_h", "txpower_v", "sys_zdr", "phidp0", "vcp_number", "processing_status")
MARKS = {p.encode().ljust(4): p for p in PRODUCTS}


def decode_radial(record: bytes, wanted: frozenset[str]) -> dict:
    """A radial as a dict; optional blocks that cannot be read are None."""
    if len(record) < BODY + RADIAL.size:
        raise ChunkError("Truncated")
    body = record[BODY:]
    site, ms, date, az_no, az, _, _, _, spacing, status, el_no, _, el, _, _, n_blocks = RADIAL.unpack_from(body)
    n_pointers = max(n_blocks, 3)
    if RADIAL.size + 4 * n_pointers > len(body):
        raise ChunkError("Truncated")
    vol, elv, rad, *rest = struct.unpack_from(f">{n_pointers}I", body, RADIAL.size)
    rvol, rrad, relv = _block(body, vol, RVOL, b"RVOL"), _block(body, rad, RRAD, b"RRAD"), _block(body, elv, RELV, b"RELV")
    moments: dict[str, dict] = {}
    for p in rest:
        if (m := decode_moment(body, p)) and m["product"] in wanted:
            moments[m["product"]] = m  # the last one of a kind wins
    return {
        "site_id": site.decode("latin-1"), "julian_date": date, "scan_time_ms": ms, "azimuth_deg": az, "elevation_deg": el, "azimuth_number": az_no, "azimuth_spacing_code": spacing,
        "radial_status": status, "elevation_number": el_no, "unamb_range": rrad and rrad[2] / 8.0, "nyquist": rrad and rrad[5] / 100.0,
        "site_parameters": rvol and dict(zip(SITE_NAMES, rvol[4:], strict=True)), "atmos_db_km": relv and relv[2] / 1000.0, "moments": [moments[k] for k in PRODUCTS if k in moments],
    }


def decode_moment(body: bytes, at: int) -> dict | None:
    if at == 0 or at + MOMENT.size > len(body):
        return None
    mark, _, _, count, first, width, _, _, _, word, scale, offset = MOMENT.unpack_from(body, at)
    size = count * word // 8
    product = MARKS.get(mark)  # the mark of DSW has a trailing blank, others have none
    if word not in (8, 16) or product is None or at + MOMENT.size + size > len(body):
        return None
    raw = np.frombuffer(body, dtype=">u2" if word == 16 else "u1", count=count, offset=at + MOMENT.size).astype(np.int32)
    return {"product": product, "gate_count": count, "first_gate_m": first, "gate_width_m": width, "word_size": word, "scale": scale, "offset": offset, "raw": raw}


def decode_vcp(record: bytes) -> dict:
    body = record[BODY:]
    if len(body) < VCP_HEADER.size:
        raise ChunkError("Truncated")
    _, pattern, number, n_cuts, *_ = VCP_HEADER.unpack_from(body)
    if VCP_HEADER.size + n_cuts * CUT_BYTES > len(body):
        raise ChunkError("Truncated")
    cuts = []
    for i in range(n_cuts):
        angle, channel, waveform, mask = struct.unpack_from(">HBBB", body, VCP_HEADER.size + i * CUT_BYTES)
        cuts.append({"elevation_deg": angle * 360.0 / 65536.0, "channel_config": channel, "waveform": waveform, "super_res": mask})
    return {"vcp_number": number, "pattern_type": pattern, "cuts": cuts}


SITE_PARAMETERS = "latitude float, longitude float, site_amsl_m int, feedhorn_agl_m int, calib_dbz float, txpower_h float, txpower_v float, sys_zdr float, phidp0 float, vcp_number int, processing_status int"
MOMENTS = "product string, gate_count int, first_gate_m int, gate_width_m int, word_size int, scale float, offset float, raw array<int>"
RADIAL_FIELDS = f"site_id string, julian_date int, scan_time_ms long, azimuth_deg float, elevation_deg float, azimuth_number int, azimuth_spacing_code int, radial_status int, elevation_number int, unamb_range float, nyquist float, site_parameters struct<{SITE_PARAMETERS.replace(' ', ':').replace(',:', ',')}>, atmos_db_km float, moments array<struct<{MOMENTS.replace(' ', ':').replace(',:', ',')}>>"
VCP_FIELDS = "vcp_number:int,pattern_type:int,cuts:array<struct<elevation_deg:float,channel_config:int,waveform:int,super_res:int>>"
KEYS = "site string, volume_seq long, chunk_no int, kind string"


def _struct(fields: str) -> str:
    out, depth, part, parts = "", 0, "", []
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(part.strip())
            part = ""
        else:
            part += c
    parts.append(part.strip())
    for p in parts:
        name, kind = p.split(" ", 1)
        out += f"{',' if out else ''}{name}:{kind}"
    return f"struct<{out}>"


DECODED = f"{KEYS}, offset int, size_bytes int, rda_channel int, msg_type int, seq_num int, msg_date int, msg_ms long, num_segments int, segment_num int, radial {_struct(RADIAL_FIELDS)}, vcp struct<{VCP_FIELDS}>, stream_bytes long, error string"


def unwrap(content: bytes | None, kind: str, limit: int) -> bytes:
    """The message stream of a chunk of the kind that its name says."""
    if _sniff(content) != kind:
        raise ChunkError("KindMismatch")
    return decompress(content, kind, limit)


def decode(chunks: DataFrame, limit: int = LIMIT, products: tuple[str, ...] = PRODUCTS, unwrap=unwrap) -> DataFrame:
    """One row per message of every readable chunk, with its radial or VCP; one error row per bad chunk.

    chunks: site, volume_seq, chunk_no, kind, content. products names the moments to keep, so that
    others never leave the decoder. Errors: TooShort, UnrecognizedFormat, KindMismatch,
    Decompression, DecompressedTooLarge, Truncated.
    """
    wanted = frozenset(products)
    schema = T._parse_datatype_string(DECODED)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    names = [f.name for f in schema.fields]

    def rows_of(key: tuple, content: bytes | None) -> list[tuple]:
        blank = [None] * (len(names) - 5)
        try:
            stream = unwrap(content, key[3], limit)
            out = []
            for at, head, record in walk(stream):
                radial = decode_radial(record, wanted) if head[2] == 31 else None
                vcp = decode_vcp(record) if head[2] == 5 else None
                out.append((*key, at, head[0] * 2, *head[1:], radial, vcp, len(stream), None))
            return out or [(*key, *blank[:-1], len(stream), None)]
        except ChunkError as e:
            return [(*key, *blank, str(e))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                b = whole.slice(start, SLICE)
                keys = list(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
                held: list[tuple] = []
                for key, content in zip(keys, b.column(4), strict=True):
                    held += rows_of(key, content.as_py())
                    if len(held) >= 500:
                        yield _batch(held, arrow)
                        held = []
                if held:
                    yield _batch(held, arrow)

    return map_arrow(chunks.select("site", F.col("volume_seq").cast("long"), F.col("chunk_no").cast("int"), "kind", "content"), run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _sniff(content: bytes | None) -> str:
    if content is None or len(content) < 8:
        raise ChunkError("TooShort")
    if content[:4] == SNIFF_VOLUME:
        return "S"
    if content[4:8] == SNIFF_BZIP:
        return "E" if content[0] >= 128 else "I"
    if content[28:32] == SNIFF_BZIP:
        return "S"
    raise ChunkError("UnrecognizedFormat")


def decompress_chunks(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Chunks with stream (decompressed messages) and error, for those who want the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, start, size, got = b.column(3).to_pylist(), 0, 0, []
            for i, content in enumerate(b.column(4)):
                try:
                    got.append((unwrap(content.as_py(), kinds[i], limit), None))
                    size += len(got[-1][0])
                except ChunkError as e:
                    got.append((None, str(e)))
                if size >= STREAM_BYTES or len(got) == 10 * SLICE or i + 1 == b.num_rows:
                    part = b.slice(start, len(got))
                    yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(5)), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string())], names=["site", "volume_seq", "chunk_no", "kind", "content", "stream", "error"])
                    start, size, got = i + 1, 0, []

    return map_arrow(chunks.select("site", F.col("volume_seq").cast("long"), F.col("chunk_no").cast("int"), "kind", "content"), run, f"{KEYS}, content binary, stream binary, error string")


#: Numbers of a volume's chunks are below this; with the volume's number they order a site's chunks.
CHUNKS_OF_A_VOLUME = 1000


def assembly_inputs(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per chunk, as a stream or a table, with what assembly takes: site, chunk_no (in order over
    volumes), kind, arrival, vcp, radials (headers without moments), error.

    chunks: site, volume_seq, chunk_no, kind, arrival, content. A chunk that cannot be read has its error
    and nothing else; the last pattern of a chunk counts.
    """
    fields = ("elevation_number", "radial_status", "rvol_vcp", "julian_date", "scan_time_ms")
    ray = pa.struct([("radial_idx", pa.int32()), *((f, pa.int32()) for f in fields[:4]), (fields[4], pa.int64())])

    def read(kind: str, content: bytes | None) -> tuple[int | None, list[dict], str | None]:
        try:
            vcp, rays = None, []
            for _, head, record in walk(unwrap(content, kind, limit)):
                if head[2] == 5:
                    vcp = decode_vcp(record)["vcp_number"]
                elif head[2] == 31:
                    r = decode_radial(record, frozenset())
                    rays.append({"radial_idx": len(rays), "rvol_vcp": r["site_parameters"] and r["site_parameters"]["vcp_number"], **{f: r[f] for f in fields if f != "rvol_vcp"}})
            return vcp, rays, None
        except ChunkError as e:
            return None, [], str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 50):
                part = b.slice(start, 50)
                got = [read(k.as_py(), c.as_py()) for k, c in zip(part.column(2), part.column(4), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.list_(ray)), pa.array([g[2] for g in got], pa.string())], names=["site", "chunk_no", "kind", "arrival", "vcp", "radials", "error"])

    rows = chunks.select("site", (F.col("volume_seq") * CHUNKS_OF_A_VOLUME + F.col("chunk_no")).cast("long").alias("chunk_no"), "kind", F.col("arrival").cast("timestamp").alias("arrival"), "content")
    return map_arrow(rows, run, "site string, chunk_no long, kind string, arrival timestamp, vcp int, radials array<struct<radial_idx:int,elevation_number:int,radial_status:int,rvol_vcp:int,julian_date:int,scan_time_ms:bigint>>, error string")


def messages(decoded: DataFrame) -> DataFrame:
    """Message headers of readable chunks, with msg_ts."""
    out = decoded.where("error is null and msg_type is not null").drop("radial", "vcp", "stream_bytes", "error")
    return out.withColumn("msg_ts", nexrad_timestamp(F.col("msg_date"), F.col("msg_ms"))).drop("msg_date", "msg_ms")


def radials(decoded: DataFrame) -> DataFrame:
    """One row per radial: chunk key, radial_idx, its fields, site_parameters and moments."""
    from pyspark.sql import Window

    got = decoded.where("radial is not null")
    idx = F.row_number().over(Window.partitionBy("site", "volume_seq", "chunk_no").orderBy("offset")) - 1
    return got.select("site", "volume_seq", "chunk_no", "kind", idx.alias("radial_idx"), "radial.*")


def moments(radial_rows: DataFrame) -> DataFrame:
    """One row per radial and product."""
    keys = ("site", "volume_seq", "chunk_no", "radial_idx", "elevation_number", "elevation_deg", "azimuth_deg")
    return radial_rows.select(*keys, F.explode("moments").alias("m")).select(*keys, "m.*")


def vcps(decoded: DataFrame) -> DataFrame:
    """One row per chunk with a VCP definition; the last one in a chunk wins."""
    got = decoded.where("vcp is not null").groupBy("site", "volume_seq", "chunk_no").agg(F.max_by("vcp", "offset").alias("vcp"))
    return got.select("site", "volume_seq", "chunk_no", "vcp.*")


def vcp_cuts(vcp_rows: DataFrame) -> DataFrame:
    return vcp_rows.select("site", "volume_seq", "chunk_no", "vcp_number", F.posexplode("cuts").alias("i", "c")).select("site", "volume_seq", "chunk_no", "vcp_number", (F.col("i") + 1).alias("cut"), "c.*")


def bad_chunks(decoded: DataFrame) -> DataFrame:
    return decoded.where("error is not null").select("site", "volume_seq", "chunk_no", "kind", "error")
