"""Builds chunk bytes from values, for tests only."""

import bz2
import struct


def rvol(vcp, lat=38.8258, lon=-75.4401, amsl=15):
    return struct.pack(">4sHBBffhHfffffHH", b"RVOL", 44, 1, 0, lat, lon, amsl, 34, -44.0, 700.0, 700.0, 0.4, 60.0, vcp, 0)


def rrad(range_km, nyquist):
    return struct.pack(">4sHHffH", b"RRAD", 28, round(range_km * 8), -80.0, -80.0, round(nyquist * 100)) + bytes(2)


def relv(atmos=-12):
    return struct.pack(">4sHhf", b"RELV", 12, atmos, -44.0)


def moment(name, raw, word=8, scale=2.0, offset=66.0, first=2125, width=250):
    mark = b"D" + name.encode().ljust(3)
    body = b"".join(struct.pack(">H" if word == 16 else ">B", x) for x in raw)
    return struct.pack(">4sHHHHHHHBBff", mark, 0, 0, len(raw), first, width, 50, 16, 0, word, scale, offset) + body


def message(body, kind, seq=1, date=20662, ms=35579000):
    size = (16 + len(body) + 1) // 2
    body = body + bytes(size * 2 - 16 - len(body))
    out = bytes(12) + struct.pack(">HBBHHIHH", size, 8, kind, seq, date, ms, 1, 1) + body
    if kind == 31:
        return out + bytes(-len(out) % 4)
    return out.ljust(2432, b"\0")


def radial(site="KDOX", az=226.25, el=0.39, el_no=1, status=1, moments=(), vcp=35, date=20662, ms=35579000, az_no=1, spacing=2, with_rvol=True, with_rrad=True):
    blocks = [rvol(vcp) if with_rvol else b"", relv(), rrad(583.75, 8.37) if with_rrad else b"", *moments]
    at = 32 + 4 * len(blocks)
    pointers, data = [], b""
    for b in blocks:
        pointers.append(at + len(data) if b else 0)
        data += b
    head = struct.pack(">4sIHHfBBHBBBBfBBH", site.encode(), ms, date, az_no, az, 0, 0, 0, spacing, status, el_no, 0, el, 0, 0, len(blocks))
    return message(head + struct.pack(f">{len(blocks)}I", *pointers) + data, 31, date=date, ms=ms)


def vcp(number=35, pattern=2, cuts=((0.308, 0, 1, 0b1001), (6.416, 0, 4, 0))):
    body = struct.pack(">HHHHBBBBIHHH", (22 + 46 * len(cuts)) // 2, pattern, number, len(cuts), 1, 1, 2, 2, 0, 0, 0, 0)
    for angle, channel, waveform, mask in cuts:
        body += struct.pack(">HBBB", round(angle * 65536 / 360), channel, waveform, mask) + bytes(41)
    return message(body, 5)


def start_chunk(*streams, site="KDOX", date=20662, ms=35579000):
    out = b"AR2V0006." + b"166" + struct.pack(">II", date, ms) + site.encode()
    for s in streams:
        z = bz2.compress(s)
        out += struct.pack(">I", len(z)) + z
    return out + b"\xff\xff\xff\xff"


def middle_chunk(*streams):
    return b"".join(struct.pack(">I", len(z)) + z for z in map(bz2.compress, streams))


def end_chunk(stream):
    z = bz2.compress(stream)
    return struct.pack(">i", -len(z)) + z
