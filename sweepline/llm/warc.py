"""Writes and reads WARC archives compressed with Zstandard, one frame per record.

An archive begins with a skippable frame that holds the dictionary (if there is one); every record
is a frame of its own. The reader loads the dictionary, finds each frame's end from its block
headers, decodes frame by frame, and validates headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import map_arrow, prepare, sampled, shared_path

# Fixed values of the formats
SKIPPABLE_DICTIONARY = 0x184D2A5D
FRAME = 0xFD2FB528
DICTIONARY = 0xEC30A437
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"


class WarcError(ValueError):
    pass


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One WARC record: a response with its payload, or a revisit of another without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    # no line end may come from the data
    target = "".join(c if c > " " else "%%%02X" % ord(c) for c in uri or "about:blank")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'null' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE_DICTIONARY, len(dictionary)) + dictionary if dictionary else b""


def frame_end(buf: memoryview, at: int) -> int:
    """Where the Zstandard frame at `at` ends, from its header and block headers."""
    if len(buf) - at < 6 or struct.unpack_from("<I", buf, at)[0] != FRAME:
        raise WarcError(f"no Zstandard frame at byte {at}")
    try:
        p = zstandard.get_frame_parameters(bytes(buf[at : at + 18]))
        pos = at + zstandard.frame_header_size(bytes(buf[at : at + 18]))
    except zstandard.ZstdError as e:
        raise WarcError(f"bad frame header at byte {at}") from e
    while True:
        if pos + 3 > len(buf):
            raise WarcError(f"the frame at byte {at} is cut off")
        head = int.from_bytes(buf[pos : pos + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        pos += 3 + (1 if kind == 1 else size)
        if last:
            break
    pos += 4 * bool(p.has_checksum)
    if pos > len(buf):
        raise WarcError(f"the frame at byte {at} is cut off")
    return pos


def read_dictionary(buf: memoryview) -> tuple[bytes, int]:
    """The dictionary of the leading skippable frame (b'' without one), and where records begin."""
    if len(buf) < 8 or struct.unpack_from("<I", buf, 0)[0] != SKIPPABLE_DICTIONARY:
        return b"", 0
    size = struct.unpack_from("<I", buf, 4)[0]
    if 8 + size > len(buf):
        raise WarcError("the dictionary is cut off")
    body = bytes(buf[8 : 8 + size])
    if body[:4] == struct.pack("<I", FRAME):
        body = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 24)
    if body[:4] != struct.pack("<I", DICTIONARY):
        raise WarcError("the leading skippable frame holds no dictionary")
    return body, 8 + size


def _headers(text: bytes) -> tuple[str, dict[str, str]]:
    try:
        lines = text.decode().split("\r\n")
    except UnicodeDecodeError as e:
        raise WarcError("headers are not UTF-8") from e
    out = {}
    for x in lines[1:]:
        name, sep, value = x.partition(":")
        if not sep or not name.strip():
            raise WarcError(f"bad header line {x[:40]!r}")
        out[name.strip().lower()] = value.strip()
    return lines[0], out


@dataclass
class Parsed:
    page_id: int | None
    uri: str
    record_type: str
    refers_to: int | None
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


def _page(urn: str | None) -> int | None:
    name = (urn or "").strip("<>")
    if not name.startswith(URN):
        raise WarcError(f"unknown record id {name[:60]!r}")
    number = name[len(URN) :]
    try:
        return None if number == "null" else int(number)
    except ValueError as e:
        raise WarcError(f"unknown record id {name[:60]!r}") from e


def parse_record(raw: bytes) -> Parsed:
    """Check and read one record."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep:
        raise WarcError("the record has no end of headers")
    version, h = _headers(head)
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"unknown version {version[:20]!r}")
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in h:
            raise WarcError(f"no {need}")
    if h["warc-type"] not in ("response", "revisit"):
        raise WarcError(f"unexpected type {h['warc-type'][:20]!r}")
    if not h["content-length"].isdigit() or int(h["content-length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("content-length does not fit the record")
    block = rest[:-4]
    if (d := h.get("warc-block-digest")) and d != f"sha1:{payload_digest(block)}":
        raise WarcError("the block digest does not fit")
    http, sep, payload = block.partition(b"\r\n\r\n")
    if not sep:
        raise WarcError("the block has no HTTP headers")
    _, fields = _headers(http)
    size = fields.get("content-length", "")
    declared = h.get("warc-payload-digest", "")
    if not size.isdigit() or not declared.startswith("sha1:"):
        raise WarcError("no payload length or digest")
    if h["warc-type"] == "response":
        if int(size) != len(payload) or declared != f"sha1:{payload_digest(payload)}":
            raise WarcError("the payload does not fit its length or digest")
        return Parsed(_page(h["warc-record-id"]), h.get("warc-target-uri", ""), "response", None, len(payload), declared[5:], payload)
    if payload:
        raise WarcError("a revisit has a payload")
    return Parsed(_page(h["warc-record-id"]), h.get("warc-target-uri", ""), "revisit", _page(h.get("warc-refers-to")), int(size), declared[5:], None)


def read_archive(content: bytes) -> Iterator[Parsed | WarcError]:
    """The records of an archive in order. A record that fails its checks gives its error and
    reading goes on behind its frame; a broken frame ends the archive."""
    buf = memoryview(content)
    try:
        dictionary, at = read_dictionary(buf)
    except WarcError as e:
        yield e
        return
    options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    decoder = zstandard.ZstdDecompressor(**options)
    while at < len(buf):
        try:
            end = frame_end(buf, at)
            raw = decoder.decompressobj().decompress(buf[at:end])
        except (WarcError, zstandard.ZstdError) as e:
            yield e if isinstance(e, WarcError) else WarcError(f"the frame at byte {at} does not decode")
            return
        at = end
        try:
            yield parse_record(raw)
        except WarcError as e:
            yield e


def train_dictionary(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_rows: int = 200, most_bytes: int = 32_768, size: int = 16_384) -> bytes:
    """A dictionary from at most sample_rows pages of at most most_bytes each, chosen by a hash.

    Pages are thinned out before they are sorted, to some 3 * sample_rows of all, so that what
    reaches the driver is bounded whatever the input. b'' where there are too few pages to train on. Pages beyond the bound are archived like all
    others; the dictionary only makes archives smaller.
    """
    html = F.col(html_col)
    small = pages.where(F.octet_length(html).between(1, most_bytes))
    share = 3 * sample_rows / max(1, small.count())
    got = small.where(sampled(share, id_col, html_col)).select(html.alias("html"), F.xxhash64(html).alias("h")).orderBy("h", "html").limit(sample_rows).collect()
    samples = [record(i, None, r["html"].encode(), "A" * 32, None) for i, r in enumerate(got)]
    if len(samples) < 20:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str | None = "url", html_col: str = "html", least_payload: int = 0, dictionary: bytes = b"", roll_bytes: int = 8_000_000, level: int = 3) -> DataFrame:
    """Write one record per row to archives in `folder`; one row per archive: path, records, bytes.

    `folder` must be visible to all executors (a file:, hdfs: or s3: address). Of rows with equal
    payloads of at least least_payload bytes the one with the smallest id is the response and
    the others revisit it; smaller payloads are all responses. Rows that repeat the smallest id
    are responses too. Rows with a null id are responses where their payload has no other id.
    A null html is an empty payload, a null url 'about:blank'. Other columns are not read; an
    empty table writes no archive. The write happens before this returns.

    Files are named after their partition and moved into place when complete; rows are sorted, so
    a task that runs again writes the same files.
    """
    spark = prepare(pages.sparkSession)
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8").alias("payload"))
    src = src.withColumn("sha", F.unhex(F.sha1("payload")))
    first = src.where(F.octet_length("payload") >= least_payload).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = src.join(first, "sha", "left").select("page_id", "url", F.when(other, F.col("first")).alias("refers_to"), "payload", F.xxhash64("sha", "page_id", "url").alias("h")).sortWithinPartitions("h", "page_id")
    shared = spark.sparkContext.broadcast(dictionary)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)  # there even if no row is

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        words = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        if words:
            words.precompute_compress(level=level)
        encoder = zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=True, write_content_size=True)
        out: list[bytes] = []
        made, held = 0, 0

        def close() -> pa.RecordBatch:
            nonlocal out, held, made
            name = f"{base}/part-{task.partitionId():06d}-{made:04d}.warc.zst"
            hidden = f"{base}/_part-{task.partitionId():06d}-{made:04d}-{task.taskAttemptId()}"
            data = dictionary_frame(shared.value) + b"".join(out)
            with store.open_output_stream(hidden) as f:
                f.write(data)
            store.move(hidden, name)
            done = pa.RecordBatch.from_pydict({"path": [name], "records": [len(out)], "bytes": [len(data)]})
            out, held, made = [], 0, made + 1
            return done

        for b in batches:
            for page_id, url, refers_to, payload in zip(*(b.column(i) for i in range(4)), strict=True):
                payload = payload.as_py()
                raw = record(page_id.as_py(), url.as_py(), payload, payload_digest(payload), refers_to.as_py())
                out.append(encoder.compress(raw))
                held += len(out[-1])
                if held >= roll_bytes:
                    yield close()
        if out:
            yield close()

    return map_arrow(rows, write, "path string, records long, bytes long").checkpoint()


def read_archives(spark: SparkSession, folder: str, strict: bool = True, with_payload: bool = False) -> DataFrame:
    """One row per record of all archives in `folder`: page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, error, and on demand payload.

    A record that fails its checks has null columns and its error, unless strict, which makes the
    job fail. One archive is in memory at a time.
    """
    prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content", "path")
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "error", *["payload"] * with_payload]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)

        for b in batches:
            for content, path in zip(b.column(0), b.column(1), strict=True):
                rows: list[tuple] = []
                for r in read_archive(content.as_buffer().to_pybytes()):
                    if isinstance(r, WarcError):
                        if strict:
                            raise WarcError(f"{path}: {r}")
                        rows.append((*[None] * 6, str(r), None))
                    else:
                        rows.append((r.page_id, r.uri, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None, r.payload))
                    if len(rows) >= 2000:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)

    return map_arrow(files, parse, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, error string" + ", payload binary" * with_payload)


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for archives in the shared one, as an address."""
    return shared_path(spark, "warc")
