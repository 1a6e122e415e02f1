"""Media columns: signature sniffing, correction of declared types, carving.

An Aho-Corasick automaton locates the magic bytes of all known formats in one pass over a blob. Each
place is confirmed by its format's validator, which walks the structure (chunks, blocks, lengths)
and says where the object ends; magic bytes without structure are not media. The outermost confirmed
object at 0 gives the blob's type, whatever it was declared as; confirmed objects elsewhere are
embedded media, carved as (format, start, end). Objects inside a carved one are not reported again.

``store`` wraps a payload losslessly as 8-bit PCM samples in a WAVE container and ``unpack`` reads the
stored samples back through the sniffer, from the place the validator found.

End markers are looked for once a blob, so that false magic bytes cost no second pass over it.

Edge cases: null or empty blobs are of type "empty"; a null text is an empty one; blobs of any length
are read whole; truncated structures are rejected; equal blobs give equal values; ids are of any type;
an empty table gives no rows; other columns are ignored or, by ``inspect_column``, kept.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, col_of, with_rid


def _riff(b: bytes, at: int, marks: Marks) -> tuple[int, dict] | None:
    if len(b) < at + 12:
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    form = b[at + 8 : at + 12]
    if end > len(b) or form not in (b"WAVE", b"WEBP", b"AVI "):
        return None
    p, info = at + 12, {"type": {b"WAVE": "wav", b"WEBP": "webp", b"AVI ": "avi"}[form]}
    while p + 8 <= end:
        name, n = b[p : p + 4], struct.unpack_from("<I", b, p + 4)[0]
        if p + 8 + n > end:
            return None
        if name == b"fmt " and n >= 16:
            info["fmt"] = struct.unpack_from("<HHIIHH", b, p + 8)
        elif name == b"data":
            info["data"] = (p + 8, n)
        p += 8 + n + (n & 1)
    if p < end or (form == b"WAVE" and not {"fmt", "data"} <= info.keys()):
        return None
    return end, info


def _png(b: bytes, at: int, marks: Marks) -> tuple[int, dict] | None:
    p, info = at + 8, {"type": "png"}
    while p + 12 <= len(b):
        n, name = struct.unpack_from(">I", b, p)[0], b[p + 4 : p + 8]
        if p + 12 + n > len(b) or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        if p == at + 8 and name != b"IHDR":
            return None
        if name == b"IHDR":
            info["size"] = struct.unpack_from(">II", b, p + 8)
        p += 12 + n
        if name == b"IEND":
            return p, info
    return None


def _gif(b: bytes, at: int, marks: Marks) -> tuple[int, dict] | None:
    if len(b) < at + 13:
        return None
    w, h, flags = struct.unpack_from("<HHB", b, at + 6)
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return p + 1, {"type": "gif", "size": (w, h)}
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            flags = b[p + 9]
            p = blocks(p + 11 + (3 << (flags & 7) + 1 if flags & 128 else 0))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int, marks: Marks) -> tuple[int, dict] | None:
    p, frame = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or p + 2 + n > len(b):
            return None
        frame |= 0xC0 <= kind <= 0xC2
        p += 2 + n
        if kind == 0xDA:
            if not frame or marks.next(b"\xff\xd9", p) < 0:
                return None
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b):
                if b[p + 1] == 0xD9:
                    return (p + 2, {"type": "jpeg"}) if frame else None
                if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
            if p < 0:
                return None
    return None


def _bmp(b: bytes, at: int, marks: Marks) -> tuple[int, dict] | None:
    if len(b) < at + 30:
        return None
    size, _, off, head, w, h, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if head not in (40, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or w <= 0 or not h or off < 14 + head or at + size > len(b) or off + (w * bits + 31) // 32 * 4 * abs(h) > size:
        return None
    return at + size, {"type": "bmp", "size": (w, abs(h))}


class Marks:
    """Where end markers stand in a blob: each is looked for once, however many objects ask."""

    def __init__(self, b: bytes):
        self.b, self.seen, self.zips = b, {}, None

    def next(self, mark: bytes, at: int) -> int:
        lo, pos = self.seen.get(mark, (at + 1, 0))
        if lo > at or -1 < pos < at:
            lo, pos = at, self.b.find(mark, at)
            self.seen[mark] = lo, pos
        return pos

    def archives(self) -> dict[int, int]:
        """Where archives begin, by their end records, and where each ends."""
        if self.zips is None:
            b, p, self.zips = self.b, self.b.find(b"PK\x05\x06"), {}
            while p >= 0 and p + 22 <= len(b):
                n, size, off, note = struct.unpack_from("<HIIH", b, p + 10)
                at = p - off - size
                if at >= 0 and p + 22 + note <= len(b) and (not n or b[at + off : at + off + 4] == b"PK\x01\x02"):
                    self.zips.setdefault(at, p + 22 + note)
                p = b.find(b"PK\x05\x06", p + 4)
        return self.zips


def _zip(b: bytes, at: int, marks: Marks) -> tuple[int, dict] | None:
    end = marks.archives().get(at)
    return (end, {"type": "zip"}) if end else None


def _gzip(b: bytes, at: int, marks: Marks) -> tuple[int, dict] | None:
    if at + 18 > len(b) or b[at + 3] & 0xE0 or b[at + 8] not in (0, 2, 4) or (b[at + 9] > 13 and b[at + 9] != 255):
        return None
    z, p = zlib.decompressobj(31), at
    try:
        while p < len(b) and not z.eof:
            piece = b[p : p + (1 << 16)]
            p += len(piece)
            while piece and not z.eof:
                z.decompress(piece, 1 << 20)
                piece = z.unconsumed_tail
    except zlib.error:
        return None
    return (p - len(z.unused_data), {"type": "gzip"}) if z.eof else None


def _pdf(b: bytes, at: int, marks: Marks) -> tuple[int, dict] | None:
    end = marks.next(b"%%EOF", at)
    return (end + 5, {"type": "pdf"}) if end >= 0 and -1 < marks.next(b"startxref", at) < end else None


def _flac(b: bytes, at: int, marks: Marks) -> tuple[int, dict] | None:
    """Frames have no total length: from a frame after the metadata to the blob's end."""
    p = at + 4
    while p + 4 <= len(b):
        n = int.from_bytes(b[p + 1 : p + 4], "big")
        if p == at + 4 and (b[p] & 127 or n != 34) or p + 4 + n > len(b):
            return None
        if b[p] & 128:
            frame = b[p + 4 + n : p + 6 + n]
            return (len(b), {"type": "flac"}) if frame in (b"\xff\xf8", b"\xff\xf9") else None
        p += 4 + n
    return None


#: The formats' magic bytes.
MAGIC: dict[bytes, Callable[[bytes, int, Marks], tuple[int, dict] | None]] = {
    b"RIFF": _riff,
    b"\x89PNG\r\n\x1a\n": _png,
    b"GIF87a": _gif,
    b"GIF89a": _gif,
    b"\xff\xd8\xff": _jpeg,
    b"BM": _bmp,
    b"PK\x03\x04": _zip,
    b"\x1f\x8b\x08": _gzip,
    b"%PDF-": _pdf,
    b"fLaC": _flac,
}
_auto: list = []


def _automaton():
    if not _auto:
        a = ahocorasick.Automaton()
        for k in MAGIC:
            a.add_word(k.decode("latin-1"), k)
        a.make_automaton()
        _auto.append(a)
    return _auto[0]


def sniff(blob: bytes) -> list[tuple[int, int, dict]]:
    """Confirmed outermost objects (start, end, structure) in order."""
    out, upto, marks = [], 0, Marks(blob)
    for last, magic in _automaton().iter(blob.decode("latin-1")):
        at = last - len(magic) + 1
        if at >= upto and (got := MAGIC[magic](blob, at, marks)):
            out.append((at, got[0], got[1]))
            upto = got[0]
    return out


def payload_of(text: str, unit: int = 64) -> bytes:
    """UTF-8, then bytes 0 up to a positive multiple of the unit."""
    b = text.encode()
    return b + bytes(max(unit, -(-len(b) // unit) * unit) - len(b))


def store(payload: bytes, rate: int = 8000) -> bytes:
    """The payload as 8-bit mono samples in a WAVE container."""
    pad = len(payload) & 1
    return b"RIFF" + struct.pack("<I", 36 + len(payload) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + bytes(pad)


def unpack(media: bytes) -> bytes:
    """The samples of a stored payload, from where the sniffer finds them."""
    at, _, info = sniff(media)[0]
    if at or info["type"] != "wav" or info["fmt"][:2] + info["fmt"][5:] != (1, 1, 8):
        raise ValueError("not 8-bit mono samples")
    start, n = info["data"]
    return media[start : start + n]


def inspect(blob: bytes | None, declared: str | None = None) -> dict:
    """A blob's true type, whether it differs from the declared one, and what is embedded in it."""
    if not blob:
        return {"type": "empty", "corrected": bool(declared) and declared != "empty", "embedded": []}
    found = sniff(blob)
    kind = found[0][2]["type"] if found and not found[0][0] else "data"
    inner = found[1:] if found and not found[0][0] else found
    if kind == "wav":  # containers of samples: what the samples hold
        start, n = found[0][2]["data"]
        inner = [(start + a, start + e, i) for a, e, i in sniff(blob[start : start + n])] + inner
    return {"type": kind, "corrected": declared is not None and declared != kind, "embedded": [{"format": i["type"], "start": a, "end": e} for a, e, i in inner]}


INSPECTED = "struct<type: string, corrected: boolean, embedded: array<struct<format: string, start: long, end: long>>>"


def inspect_column(df: DataFrame, blob_col: str, declared_col: str | None = None, out: str = "media_info") -> DataFrame:
    """df with a column of ``inspect``'s results."""

    @F.pandas_udf(INSPECTED)
    def run(blobs: pd.Series, declared: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([inspect(b, d if isinstance(d, str) else None) for b, d in zip(blobs, declared, strict=True)], columns=["type", "corrected", "embedded"])

    return df.withColumn(out, run(col_of(df, blob_col), col_of(df, declared_col) if declared_col else F.lit(None).cast("string")))


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__rid, id, n_bytes, media binary): every text's payload as a WAVE blob."""

    def run(batches):
        for pdf in batches:
            yield pdf[[RID, "i"]].assign(n_bytes=[len(t.encode()) for t in pdf["t"]], media=[store(payload_of(t)) for t in pdf["t"]])

    src = with_rid(docs.select(col_of(docs, id_col).cast("string").alias("i"), F.coalesce(col_of(docs, text_col).cast("string"), F.lit("")).alias("t")))
    return src.mapInPandas(run, f"{RID} long, i string, n_bytes long, media binary")


def read_back(stored: DataFrame, id_type="long", id_col: str = "doc_id", unit: int = 64) -> DataFrame:
    """Digests of the stored form and of what is read from it, and the sniffer's findings."""

    def run(batches):
        for pdf in batches:
            rows = []
            for rid, i, n, m in zip(pdf[RID], pdf["i"], pdf["n_bytes"], pdf["media"], strict=True):
                data = unpack(m)
                info = inspect(m, "text")
                inner = ",".join(f"{e['format']}:{e['start']}:{e['end']}" for e in info["embedded"])
                feature = f"type={info['type']};corrected={int(info['corrected'])};samples={len(data)};embedded={inner}"
                rows.append((rid, i, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-unit:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=[RID, "i", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = f"{RID} long, i string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    out = stored.mapInPandas(run, kind)
    return out.select(RID, F.col("i").cast(id_type).alias(id_col), *[c for c in out.columns if c not in (RID, "i")])
