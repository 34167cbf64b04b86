"""Archive volumes read in ranges of any size give what the same messages give as chunks."""

import bz2
import struct

import encoder as e
import pytest

from sweepline.sources import archive, chunks

HEAD = b"AR2V0006.001" + struct.pack(">II", 20662, 35579000) + b"KDOX"


def block(data, last=False):
    z = bz2.compress(data)
    return struct.pack(">i", -len(z) if last else len(z)) + z


def messages(n, at):
    return b"".join(e.radial(az=float(i % 360), el_no=1 + i // 8, ms=i, moments=[e.moment("REF", [0, 1, 66, 90])]) for i in range(at, at + n))


def seen(df):
    return sorted((r.site_id, r.volume_seq, r.scan_time_ms, r.azimuth_deg, r.elevation_number, r.moments[0].raw) for r in chunks.radials(df).collect())


@pytest.mark.parametrize("split", [100, 777, 1 << 20])
def test_volumes_in_ranges(spark, tmp_path, split):
    old = e.message(b"x" * 100, 2) + messages(10, 0) + e.message(b"y" * 40, 3) + messages(20, 10)
    files = {
        "new": HEAD + block(messages(10, 0)) + block(e.message(b"m" * 50, 2)) + block(messages(15, 10)) + block(messages(5, 25), last=True),
        "old": HEAD[:-4] + b"KTLX" + old,
        "empty": b"", "other": b"something else that is long enough", "short": HEAD[:-4] + b"KCUT" + block(messages(4, 0)) + block(messages(4, 4))[:-30], "bare": HEAD[:-4] + b"KNIL",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    records = archive.read_archives(spark, f"file://{tmp_path}", split)
    if split == 100:
        assert records.rdd.getNumPartitions() > 20
    bad = sorted((r.path.rsplit("/", 1)[-1], r.error) for r in records.where("error is not null").collect())
    assert bad == [("empty", "TooShort"), ("other", "UnrecognizedFormat"), ("short", "TooShort")]
    got = seen(archive.decode_archives(records.where("error is null")))
    stamp = 20662 * 86_400_000 + 35579000
    rows = [("KDOX", 1, 0, "I", block(messages(30, 0)))]
    want = [(r[0], stamp, *r[2:]) for r in seen(chunks.decode(spark.createDataFrame(rows, "site string, volume_seq long, chunk_no int, kind string, content binary")))]
    # every radial names KDOX; 30 of each whole volume, 4 of the one that is cut off
    assert got == sorted(want + want + want[:4])
    by_site = {s: [r[2] for r in chunks.radials(archive.decode_archives(records.where(f"error is null and site = '{s}'"))).select("site_id", "volume_seq", "scan_time_ms").collect()] for s in ("KDOX", "KTLX", "KCUT", "KNIL")}
    assert {s: sorted(v) for s, v in by_site.items()} == {"KDOX": list(range(30)), "KTLX": list(range(30)), "KCUT": [0, 1, 2, 3], "KNIL": []}


def test_no_files(spark, tmp_path):
    assert archive.read_archives(spark, f"file://{tmp_path}").count() == 0


def test_many_files_need_few_tasks(spark, tmp_path):
    """The number of tasks does not grow with the number of small files."""
    for i in range(300):
        (tmp_path / f"v{i}").write_bytes(HEAD[:-4] + b"K%03d" % i + block(messages(2, i)))
    records = archive.read_archives(spark, f"file://{tmp_path}", 60)
    assert records.rdd.getNumPartitions() <= 64
    assert sorted(r.site for r in records.select("site").collect()) == [f"K{i:03d}" for i in range(300)]
    assert records.select("path").distinct().count() == 300
