"""Operator 1: media columns in Ogg containers.

Reading checks the CRC of every page, demultiplexes the logical streams by
serial number, puts packets together from lacing values (also across pages),
and derives times from granule positions. Writing makes the same structure:
a stream of 8-bit unsigned samples and a small stream of notes that holds the
unpadded length.

Edge cases: null and empty texts give one frame of padding; equal texts give
equal bytes, since serial numbers are fixed. Media that are null give a row of
nulls; broken pages are counted in ``bad_pages`` and their packets left out.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import map_arrow

FRAME = 576
PAD = b"\xff"
RATE = 8000
SAMPLES, NOTES = 0x53414D50, 0x4E4F5445
PAGE_PACKETS = 85
_HEAD = struct.Struct("<4sBBqIIIB")
#: Each byte with its bits reversed: the Ogg CRC is the reflected one of zlib, read backwards.
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_MAGIC = b"PCM     "


def page_crc(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, no reflection, start 0, as Ogg has it."""
    c = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_REVERSED), "big")


def lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def page(serial: int, seq: int, granule: int, packets: list[bytes], flags: int = 0) -> bytes:
    laces = b"".join(lacing(len(p)) for p in packets)
    return page_of(serial, seq, granule, laces, b"".join(packets), flags)


def page_of(serial: int, seq: int, granule: int, laces: bytes, body: bytes, flags: int = 0) -> bytes:
    if len(laces) > 255:
        raise ValueError("a page holds at most 255 segments")
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, seq, 0, len(laces))
    crc = page_crc(head + laces + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + laces + body


def mux(payload: bytes, n_bytes: int, rate: int = RATE) -> bytes:
    """A payload of whole frames as an Ogg file of two logical streams."""
    head = _MAGIC + struct.pack(">HHIIBBHI", 0, 0, 1, rate, 8, 1, FRAME, 0)
    out = [page(SAMPLES, 0, 0, [head], 2), page(NOTES, 0, 0, [b"NOTES   " + struct.pack("<Q", n_bytes)], 2)]
    step, seq = FRAME * PAGE_PACKETS, 1
    laces = lacing(FRAME)
    for at in range(0, len(payload), step):
        body = payload[at : at + step]
        last = 4 if at + step >= len(payload) else 0
        out.append(page_of(SAMPLES, seq, at + len(body), laces * (len(body) // FRAME), body, last))
        seq += 1
    out.append(page(NOTES, 1, len(payload), [b"end"], 4))
    return b"".join(out)


def demux(media: bytes) -> dict[int, dict]:
    """Logical streams by serial number: packets, granule of each page, bad pages.

    A page whose CRC is wrong, or that is cut short, is not believed in anything:
    it opens no stream, and counts as a bad page of the stream that it names only
    if sound pages of that stream came before; all others are under ``None``. Its
    packets are left out. A packet that a lost page interrupts is dropped; ``lost``
    counts the pages that sequence numbers show to be missing. Reading goes on at
    the next capture pattern.
    """
    streams: dict[int, dict] = {}
    unknown = 0
    at, n = 0, len(media)
    while (at := media.find(b"OggS", at)) >= 0 and at + 27 <= n:
        _, _, flags, granule, serial, seq, crc, segments = _HEAD.unpack_from(media, at)
        laces = media[at + 27 : at + 27 + segments]
        end = at + 27 + segments + sum(laces)
        if len(laces) < segments or end > n or page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            if serial in streams:
                streams[serial]["bad_pages"] += 1
                streams[serial]["part"] = None
            else:
                unknown += 1
            at += 4
            continue
        s = streams.setdefault(serial, {"packets": [], "granules": [], "pages": 0, "bad_pages": 0, "lost": 0, "part": None, "next": None, "bos": False, "eos": False})
        s["pages"] += 1
        if s["next"] is not None and seq > s["next"]:
            s["lost"] += seq - s["next"]
        if s["next"] is not None and seq != s["next"]:
            s["part"] = None
        s["next"] = seq + 1
        s["bos"] |= bool(flags & 2)
        s["eos"] |= bool(flags & 4)
        body = at + 27 + segments
        open_ = s["part"] if flags & 1 else b""
        start = pos = body
        for lace in laces:
            pos += lace
            if lace < 255:
                if open_ is not None:
                    s["packets"].append(open_ + media[start:pos])
                open_, start = b"", pos
        if laces and laces[-1] == 255:
            s["part"] = None if open_ is None else open_ + media[start:pos]
        else:
            s["part"] = None
        if granule >= 0:
            s["granules"].append((granule, len(s["packets"])))
        at = end
    if unknown:
        streams[None] = {"packets": [], "granules": [], "pages": 0, "bad_pages": unknown, "lost": 0, "part": None, "next": None, "bos": False, "eos": False}
    return streams


def packet_times(stream: dict, rate: int) -> list[float]:
    """Seconds at which each packet of a stream ends.

    A page's granule position is the end of the last packet that it finishes. The
    packets of a page end at even steps between its position and the one before;
    packets after the last position have that of the last.
    """
    out, last = [], 0
    for granule, count in stream["granules"]:
        n = count - len(out)
        out += [(last + (granule - last) * (k + 1) / n) / rate for k in range(n)]
        last = granule
    return out + [last / rate] * (len(stream["packets"]) - len(out))


def rate_of(stream: dict) -> int:
    """Granules a second: of samples as their header says, 1 for any other stream."""
    first = stream["packets"][0] if stream["packets"] else b""
    return struct.unpack_from(">I", first, 16)[0] if first.startswith(_MAGIC) and len(first) >= 20 else 1


def read_samples(media: bytes) -> tuple[bytes, int, dict]:
    """The payload, its unpadded length, and facts of the container."""
    streams = demux(media)
    audio = next((s for s in streams.values() if s["packets"] and s["packets"][0].startswith(_MAGIC)), None)
    notes = next((s for s in streams.values() if s["packets"] and s["packets"][0].startswith(b"NOTES   ")), None)
    if audio is None or notes is None:
        raise ValueError("the file lacks a stream of samples or of notes")
    rate = rate_of(audio)
    times = packet_times(audio, rate)
    facts = {"streams": len(streams) - (None in streams), "pages": sum(s["pages"] for s in streams.values()), "bad_pages": sum(s["bad_pages"] for s in streams.values()), "lost": sum(s["lost"] for s in streams.values()), "packets": len(audio["packets"]) - 1, "rate": rate, "seconds": times[-1] if times else 0.0}
    return b"".join(audio["packets"][1:]), struct.unpack_from("<Q", notes["packets"][0], 8)[0], facts


def features(samples: np.ndarray) -> dict:
    """Level, range, zero crossings and spectral tilt of 8-bit samples around 128."""
    counts = np.bincount(samples, minlength=256)
    n = max(1, len(samples))
    x = np.arange(256) - 128
    mean = float(counts @ x) / n
    power = float(counts @ (x * x)) / n
    above = samples >= 128
    p = counts[counts > 0] / n
    peaks = np.flatnonzero(counts)
    return {"mean": round(mean, 6), "rms": round(power**0.5, 6), "low": int(peaks[0]) if len(peaks) else 0, "high": int(peaks[-1]) if len(peaks) else 0, "crossings": int(np.count_nonzero(above[1:] != above[:-1])), "entropy": round(float(-(p * np.log2(p)).sum()) + 0.0, 6)}


def padded(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of the frame."""
    return data + PAD * (FRAME * max(1, -(-len(data) // FRAME)) - len(data))


OUT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def encode(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col, media binary``: every text (null: empty) as an Ogg file."""
    import pyarrow as pa

    def run(batch):
        out = [mux(padded(b), len(b)) for b in ((v or "").encode() for v in batch.column(1).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "media"])

    src = df.select(id_col, text)
    return map_arrow(src, run, f"{id_col} {src.dtypes[0][1]}, media binary", text)


def describe(df: DataFrame, media: str = "media", id_col: str = "doc_id") -> DataFrame:
    """The digest columns, all read back from the stored media."""

    def run(batch):
        cols: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for m in batch.column(1).to_pylist():
            if m is None:
                for v in cols.values():
                    v.append(None)
                continue
            payload, n_bytes, facts = read_samples(m)
            facts |= features(np.frombuffer(payload, np.uint8))
            for k, v in zip(cols, (n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), json.dumps(facts)), strict=True):
                cols[k].append(v)
        return {id_col: batch.column(0)} | cols

    src = df.select(id_col, media)
    return map_arrow(src, run, f"{id_col} {src.dtypes[0][1]}, {OUT}", media)


def streams_table(df: DataFrame, media: str = "media", id_col: str = "doc_id") -> DataFrame:
    """One row a packet: serial, number, the seconds at which it starts and ends, data.

    Streams whose header gives no rate have one granule a second.
    """
    import pyarrow as pa

    def run(batch):
        rows = []
        for key, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for serial, s in (demux(m) if m else {}).items():
                ends = packet_times(s, rate_of(s))
                rows.extend((key, serial, k, ends[k - 1] if k else 0.0, ends[k], p) for k, p in enumerate(s["packets"]))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        return dict(zip((id_col, "serial", "packet", "start", "end", "data"), map(list, cols), strict=True)) | {id_col: pa.array(list(cols[0]), batch.column(0).type)}

    src = df.select(id_col, media)
    return map_arrow(src, run, f"{id_col} {src.dtypes[0][1]}, serial long, packet long, start double, end double, data binary", media)


def op1_ogg(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Digest of every text stored as Ogg and read back; see the module."""
    return describe(encode(df, text, id_col), "media", id_col)
