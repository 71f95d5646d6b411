"""MPEG audio media columns: writing, resynchronising reading, checksums, durations and seek offsets.

A payload is stored as the ancillary data of MPEG-1 Layer III mono frames:
silent side information, a CRC-16 in every frame, an ID3v2 tag in front and an
Info/VBR table in the first frame.  Reading finds frames by their headers
(after damage too), checks each CRC, and gives the exact duration in samples
and the byte offset of every frame.  A frame's CRC covers its header and side
information only, so the tag carries a digest of the payload too.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.base import Scratch

# Fixed values of MPEG audio: kbit/s by version and layer, and samples a second by version.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
ALIGN = 64
SIDE_MONO, RATE_INDEX, RATE = 17, 2, 32000


def crc16(data: bytes, value: int = 0xFFFF) -> int:
    """CRC-16 with polynomial 0x8005, most significant bit first."""
    for byte in data:
        value ^= byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
    return value


_CRC_CACHE: dict[bytes, int] = {}


def frame_crc(covered: bytes) -> int:
    """crc16 of the two header bytes and the side information; frames repeat few of these."""
    if covered not in _CRC_CACHE:
        if len(_CRC_CACHE) > 10_000:
            _CRC_CACHE.clear()
        _CRC_CACHE[covered] = crc16(covered)
    return _CRC_CACHE[covered]


def header(data: bytes, at: int) -> dict | None:
    """The frame header at `at`, or None if there is none or its length isn't known (free format)."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1], data[at + 2], data[at + 3]
    version, layer = {0: 2.5, 2: 2, 3: 1}.get(b1 >> 3 & 3), 4 - (b1 >> 1 & 3)
    rate_at, bit_at, padding = b2 >> 2 & 3, b2 >> 4, b2 >> 1 & 1
    if version is None or layer == 4 or rate_at == 3 or bit_at in (0, 15) or b3 & 3 == 2:
        return None
    rate, kbps = RATES[version][rate_at], BITRATES[(1 if version == 1 else 2, layer)][bit_at - 1]
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    length = (12 * kbps * 1000 // rate + padding) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + padding
    mono = b3 >> 6 == 3
    side = (0 if layer != 3 else 17 if mono else 32) if version == 1 else (0 if layer != 3 else 9 if mono else 17)
    crc = not b1 & 1
    return {"version": version, "layer": layer, "rate": rate, "kbps": kbps, "samples": samples, "length": length, "channels": 1 if mono else 2, "crc": crc, "body": 4 + 2 * crc + side, "side": side}


def _frame(body: bytes, index: int) -> bytes:
    head = bytes([0xFF, 0xFA, index << 4 | RATE_INDEX << 2, 0xC0])
    side = bytes(SIDE_MONO)
    return head + frame_crc(head[2:] + side).to_bytes(2, "big") + side + body


def _room(index: int) -> int:
    return 144 * BITRATES[(1, 3)][index - 1] * 1000 // RATE - 6 - SIDE_MONO


ROOM = {i: _room(i) for i in range(1, 15)}


def syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def encode(payload: bytes) -> bytes:
    """`payload` as an MPEG audio file; the ID3v2 tag carries its length, and an ID3v1 tag ends it, so that no payload can pass for one."""
    frames, at = [], 0
    while at < len(payload):
        rest = len(payload) - at
        index = next((i for i in range(1, 15) if ROOM[i] >= rest), 14)
        frames.append(_frame(payload[at : at + ROOM[index]].ljust(ROOM[index], b"\0"), index))
        at += ROOM[index]
    info = ROOM[9]
    total = info + 6 + SIDE_MONO + sum(map(len, frames))
    starts, pos = [], info + 6 + SIDE_MONO
    for f in frames:
        starts.append(pos)
        pos += len(f)
    toc = bytes(min(255, starts[min(len(starts) - 1, k * len(starts) // 100)] * 256 // total) if starts else 0 for k in range(100))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    fields = {"payload_bytes": len(payload), "payload_crc32": zlib.crc32(payload)}
    texts = [f"\x03{k}\0{v}".encode() for k, v in fields.items()]
    tag = b"".join(b"TXXX" + syncsafe(len(t)) + b"\0\0" + t for t in texts)
    return b"ID3\x04\0\0" + syncsafe(len(tag)) + tag + _frame(table.ljust(info, b"\0"), 9) + b"".join(frames) + b"TAG" + bytes(124) + b"\xff"


def tags(data: bytes) -> tuple[int, dict[str, str]]:
    """Where audio begins after any ID3v2 tag, and the tag's text fields (v2.3, v2.4)."""
    at, out = 0, {}
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        size = sum((b & 0x7F) << s for b, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0), strict=True))
        major, pos, end = data[at + 3], at + 10, min(len(data), at + 10 + size)
        while pos + 10 <= end and data[pos : pos + 4].strip(b"\0"):
            raw = data[pos + 4 : pos + 8]
            n = sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if major >= 4 else int.from_bytes(raw, "big")
            name, value = data[pos : pos + 4].decode("latin-1"), data[pos + 10 : min(end, pos + 10 + n)]
            if name[0] == "T" and value:
                code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1")
                text = value[1:].decode(code, "replace").rstrip("\0")
                key, _, text = text.partition("\0") if name == "TXXX" else (name, "", text)
                out[key] = text
            pos += 10 + n
        at += 10 + size
    return at, out


def old_tag(data: bytes) -> dict[str, str]:
    """The text fields of the ID3v1 tag that ends `data`."""
    fields = {"TIT2": data[-125:-95], "TPE1": data[-95:-65], "TALB": data[-65:-35]}
    return {k: v.decode("latin-1").rstrip("\0 ") for k, v in fields.items()}


def frames_of(data: bytes, at: int) -> Iterator[tuple[int, dict, bool]]:
    """(offset, header, resynchronised) of each whole frame from `at` on.

    Once in step, a frame follows where the last one ends.  Out of step, a
    header counts only if a like header, or the end, follows its frame.  'TAG'
    128 bytes before the end is an ID3v1 tag unless a frame of which the same
    is true runs over it.
    """
    end = len(data)
    tag = end - 128 if data[-128:-125] == b"TAG" else end
    step, lost = False, False
    while at < tag:
        h = header(data, at)
        after = at + h["length"] if h else end + 1
        ok = after <= end
        if ok and (not step or after > tag):
            g = header(data, after)
            ok = after in (tag, end) or g is not None and (g["version"], g["layer"], g["rate"]) == (h["version"], h["layer"], h["rate"])
        if ok:
            yield at, h, lost
            at, step, lost = after, True, False
            tag = end if at > tag else tag
        else:
            at, step, lost = data.find(b"\xff", at + 1, tag), False, True
            if at < 0:
                return


def vbr_table(data: bytes, at: int, h: dict) -> dict | None:
    """The Xing, Info or VBRI table of a first frame: frames, bytes, seek table (of VBRI: bytes of each run of frames)."""
    number = lambda pos, n: int.from_bytes(data[pos : pos + n], "big")
    if data[at + 36 : at + 40] == b"VBRI":
        pos = at + 40
        entries, scale, width, run = (number(pos + k, 2) for k in (14, 16, 18, 20))
        toc = [number(pos + 22 + k * width, width) * scale for k in range(entries) if pos + 22 + (k + 1) * width <= len(data)] if 1 <= width <= 4 else []
        return {"kind": "VBRI", "bytes": number(pos + 6, 4), "frames": number(pos + 10, 4), "toc": toc, "frames_a_run": run}
    pos = at + h["body"]
    if data[pos : pos + 4] not in (b"Xing", b"Info"):
        return None
    flags, out = number(pos + 4, 4), {"kind": data[pos : pos + 4].decode()}
    pos += 8
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            out[name] = number(pos, 4)
            pos += 4
    if flags & 4:
        out["toc"] = list(data[pos : pos + 100])
    return out


# Bits of allocation of a Layer II subband, by (subbands that have that many bits, bits), for each of the four tables.
ALLOCATION = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "lsf": ((4, 4), (7, 3), (19, 2))}


def _layer2_table(h: dict) -> str:
    each = h["kbps"] // h["channels"]
    if h["version"] != 1:
        return "lsf"
    if h["rate"] == 48000 and each >= 56 or 56 <= each <= 80:
        return "a"
    if h["rate"] != 48000 and each >= 96:
        return "b"
    return "d" if h["rate"] == 32000 and each <= 48 else "c"


def covered_bits(data: bytes, at: int, h: dict) -> int | None:
    """How many bits after the CRC it covers: side information in Layer III, allocation in I, allocation and scale selectors in II."""
    if h["layer"] == 3:
        return 8 * h["side"]
    joint = h["channels"] == 2 and data[at + 3] >> 6 == 1
    bound = 4 * ((data[at + 3] >> 4 & 3) + 1) if joint else 32
    if h["layer"] == 1:
        return 4 * (min(bound, 32) * h["channels"] + (32 - min(bound, 32)))
    widths = [n for count, n in ALLOCATION[_layer2_table(h)] for _ in range(count)]
    pos, selectors = 8 * (at + 6), 0
    bits = lambda p, n: int.from_bytes(data[p // 8 : p // 8 + 2].ljust(2, b"\0"), "big") >> (16 - n - p % 8) & ((1 << n) - 1)
    start = pos
    for k, width in enumerate(widths):
        shared = k >= bound
        for _ in range(1 if shared else h["channels"]):
            used = bits(pos, width) > 0
            selectors += 2 * used * (h["channels"] if shared else 1)
            pos += width
    return pos - start + selectors


def crc_holds(data: bytes, at: int, h: dict) -> bool:
    """Whether a frame's CRC-16 agrees with the bits that it covers."""
    bits, stated = covered_bits(data, at, h), int.from_bytes(data[at + 4 : at + 6], "big")
    body = data[at + 6 : at + 6 + -(-bits // 8)]
    if bits % 8 == 0:
        return frame_crc(data[at + 2 : at + 4] + body) == stated
    value = crc16(data[at + 2 : at + 4] + body[:-1])
    for k in range(bits % 8):
        value = (value << 1 ^ (0x8005 if (value >> 15 ^ body[-1] >> (7 - k)) & 1 else 0)) & 0xFFFF
    return value == stated


def parse(data: bytes) -> dict:
    """Tags, table, frames, CRC results, duration and offsets of an MPEG audio file, and the frames' bodies joined."""
    start, fields = tags(data)
    found, bodies, good, bad, resyncs, table, first = [], [], 0, 0, 0, None, None
    samples, rate, last = 0, 0, start
    for at, h, lost in frames_of(data, start):
        resyncs, last = resyncs + lost, at + h["length"]
        if h["crc"]:
            ok = crc_holds(data, at, h)
            good, bad = good + ok, bad + (not ok)
        if first is None:
            first, table = h, vbr_table(data, at, h)
            if table:
                continue
        samples, rate = samples + h["samples"], h["rate"]
        found.append(at)
        bodies.append(data[at + h["body"] : at + h["length"]])
    if data[-128:-125] == b"TAG" and last <= len(data) - 128:
        fields = old_tag(data) | fields
    return {"tags": fields, "table": table, "first": first, "offsets": found, "crc_good": good, "crc_bad": bad, "resyncs": resyncs, "samples": samples, "rate": rate or RATE, "body": b"".join(bodies)}


def payload_of(got: dict) -> bytes | None:
    """The payload in a parsed file; None if the file states none, or frames of it are lost."""
    stated = got["tags"].get("payload_bytes", "")
    n = int(stated) if stated.isascii() and stated.isdigit() else -1
    return got["body"][:n] if 0 <= n <= len(got["body"]) else None


def decode(data: bytes) -> bytes | None:
    """The payload of a file that `encode` wrote."""
    return payload_of(parse(data))


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw.ljust(max(ALIGN, -(-len(raw) // ALIGN) * ALIGN), b"\0")


STORED = "doc_id long, n_bytes long, media binary"
COLUMNS = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, duration_samples long, sample_rate int, frame_offsets array<long>, crc_failures int, intact boolean"
)


def _store(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            texts = part.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([encode(padded(t)) for t in texts], pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )


def _feature(data: bytes, got: dict) -> str | None:
    if not got["samples"]:
        return None
    return json.dumps({
        "frames": len(got["offsets"]), "seconds": round(got["samples"] / got["rate"], 6), "rate": got["rate"],
        "layer": got["first"]["layer"], "channels": got["first"]["channels"], "crc_good": got["crc_good"], "crc_bad": got["crc_bad"],
        "resyncs": got["resyncs"], "table_frames": (got["table"] or {}).get("frames"), "kbps": round(8 * len(data) * got["rate"] / got["samples"] / 1000, 3),
    })


def _row(doc, n, data: bytes | None) -> tuple:
    if data is None:
        return (doc, n, *[None] * 11)
    got = parse(data)
    payload, stated = payload_of(got), got["tags"].get("payload_crc32")
    digests = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:])) if payload is not None else (None,) * 3
    intact = None if stated is None else payload is not None and str(zlib.crc32(payload)) == stated
    return (doc, n, *digests, len(data), hashlib.sha256(data).hexdigest(), _feature(data, got), got["samples"], got["rate"], got["offsets"], got["crc_bad"], intact)


def _read(batches):
    types = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.bool_()]
    names = [c.strip().split()[0] for c in COLUMNS.split(", ")]
    for batch in batches:
        rows = [_row(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        cols = list(zip(*rows, strict=True)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the text's padded bytes as an MPEG audio file in column `media`."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_store, STORED)


def read_media(stored: DataFrame) -> DataFrame:
    """What the stored files say: payload digests, durations, frame offsets, checksum results.

    Defined cases: a null file gives nulls; a file without frames has no
    feature, 0 samples and no offsets; a file that states no payload, or has
    lost frames of it, has null payload digests; `intact` compares the payload
    with the digest in the tag, and is null if that is absent.
    """
    return stored.select(F.col("doc_id").cast("long"), F.col("n_bytes").cast("long"), "media").mapInArrow(_read, COLUMNS)


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text of `docs` as media in the shared folder and reads all of it back.

    Defined cases: a null text is empty and becomes 64 zero bytes; a null
    doc_id stays null; repeated rows and equal texts give equal values; an
    empty table gives an empty result; other columns are ignored.
    """
    return read_media(Scratch(docs.sparkSession, "media").write(store_media(docs), "media"))
