"""Sequence packing along a space-filling curve.

A document's token ids are hashed into a bag vector, projected to three dimensions with a fixed
Gaussian matrix, and mapped to the cube by the normal distribution function; the cell's Hilbert
index orders the documents. The stream of documents along the curve is cut every ``max_len`` ids, so
neighbours on the curve share sequences and only the corpus's last sequence has padding.

Two passes: ids are written once to the shared folder; the order and the global offsets are computed
on (row, key, length) alone and joined back. Ties on the curve are broken by row number, so copies
spread over the range partitions like any other rows.

Edge cases: null or empty text is the end id alone; null ids and repeated rows are packed as they
are; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import RID, col_of, materialise, shuffle_partitions, trim, with_rid

DIMS, BITS, BUCKETS = 3, 16, 1024
_state: dict = {}
_ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"  # no apostrophe: the pre-tokenizer knows endings such as 's
_PLAIN, _PIECE = re.compile(f"[{_LETTERS}0-9{_MARKS}]+"), re.compile(f"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")


def _tokenizer(path: str):
    if _state.get("path") != path:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        rng = np.random.default_rng(7)
        proj = rng.standard_normal((BUCKETS, DIMS))
        size = tok.get_vocab_size()
        ids = np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sign = np.where((ids >> np.uint64(63)).astype(bool), 1.0, -1.0)
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level BPE
        shown = dict(zip([*kept, *sorted(set(range(256)) - set(kept))], map(chr, [*kept, *range(256, 512 - len(kept))]), strict=True))
        _state.update(path=path, tok=tok, pieces={}, before={}, model=tok.model, shown=shown, proj=proj, bucket=((ids >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64), sign=sign)
    return _state["tok"]


def _piece_ids(piece: str) -> bytes:
    """Ids of a piece that the pre-tokenizer leaves whole, from the tokenizer's model alone: a piece is
    normal already, and its bytes stand as the pre-tokenizer would write them."""
    piece = piece if piece.isascii() else "".join(map(_state["shown"].__getitem__, piece.encode()))
    return array("I", [t.id for t in _state["model"].tokenize(piece)]).tobytes()


def _known(pieces: list[str], limit: int) -> list[bytes]:
    """Ids of pieces, through two bounded caches: what the young one gathers till it is full, and what it
    held before, from which a piece that comes again goes back to the young one."""
    young, old, out = _state["pieces"], _state["before"], []
    for p in pieces:
        ids = young.get(p)
        if ids is None:
            if len(young) >= limit:
                _state["before"], _state["pieces"] = old, young = young, {}
            young[p] = ids = old.get(p) or _piece_ids(p)
        out.append(ids)
    return out


def _learn(words: list[str], limit: int) -> list[bytes]:
    """Ids of distinct words. Words of Latin letters, digits and marks fall into the pieces that the
    pre-tokenizer would cut (lower-cased, as its normaliser would), so each piece is encoded once
    whatever its case and the marks around it; other words go through the tokenizer whole."""
    pieces, size, other = [], [], []
    for k, w in enumerate(words):
        if w.isascii() and w.isalpha():
            pieces.append(w.lower())
            size.append(1)
        elif _PLAIN.fullmatch(w):
            cut = _PIECE.findall(w.lower())
            pieces += cut
            size.append(len(cut))
        else:
            other.append(k)
            size.append(0)
    ids = iter(_known(pieces, limit))
    out = [next(ids) if n == 1 else b"".join(islice(ids, n)) for n in size]
    for k, e in zip(other, _state["tok"].encode_batch_fast([words[k] for k in other], add_special_tokens=False), strict=True):
        out[k] = array("I", e.ids).tobytes()
    return out


def encode(texts: list[str], path: str, limit: int = 150_000) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit, through bounded caches of pieces.
    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids laid
    end to end; the few texts with control characters or special tokens go through it whole."""
    tok = _tokenizer(path)
    odd = {k: np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for k, t in enumerate(texts) if any(map(t.__contains__, _ODD))}
    split = pc.ascii_split_whitespace(pa.array(["" if k in odd else t for k, t in enumerate(texts)], pa.large_string()))
    coded = split.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    parts = _learn(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), limit)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    flat = np.frombuffer(b"".join(parts), "<u4")
    length = size[codes]
    upto = np.concatenate([[0], np.cumsum(length)])
    ids = flat[np.repeat((np.cumsum(size) - size)[codes] - upto[:-1], length) + np.arange(upto[-1])]
    cut = upto[split.offsets.to_numpy()]
    return [odd[k] if k in odd else ids[a:b].tobytes() for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]


def portions(texts: pd.Series, rows: int = 1000, chars: int = 4_000_000):
    """Cuts of consecutive texts: at most ``rows`` and about ``chars`` characters each."""
    size = texts.str.len().to_numpy()
    lo, n = 0, 0
    for k, c in enumerate(size):
        if k > lo and (k - lo == rows or n + c > chars):
            yield lo, k
            lo, n = k, 0
        n += c
    if lo < len(size):
        yield lo, len(size)


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer cells (n, dims), by Skilling's transpose."""
    x = [cells[:, i].astype(np.int64).copy() for i in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(up, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ t) >> b) & 1)
    return out


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents given as id arrays."""
    at = np.zeros((len(ids), DIMS))
    for k, a in enumerate(ids):
        v = np.bincount(_state["bucket"][a], weights=_state["sign"][a], minlength=BUCKETS)
        norm = np.sqrt(v @ v)
        if norm:
            at[k] = (v / norm) @ _state["proj"]
    cdf = 1.0 / (1.0 + np.exp(-1.702 * at))  # the logistic approximation of the normal distribution
    return hilbert_index(np.minimum((cdf * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces (id, start, length, ids binary, doc_tokens, sequence_id, offset, curve_key)."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def tokens(batches):
        for pdf in batches:
            _tokenizer(tokenizer_path)
            for lo, hi in portions(pdf["t"]):
                part = pdf.iloc[lo:hi]
                ids = encode(part["t"].tolist(), tokenizer_path)
                keys = curve_keys([np.frombuffer(x, "<u4") for x in ids])
                full = [x + end for x in ids]
                yield pd.DataFrame({RID: part[RID].to_numpy(), "i": part["i"], "key": keys, "n": [len(x) // 4 for x in full], "ids": full})
        trim()

    src = with_rid(docs.select(col_of(docs, id_col).cast("string").alias("i"), F.coalesce(col_of(docs, text_col).cast("string"), F.lit("")).alias("t")))
    coded = materialise(src.select(RID, "i", "t").mapInPandas(tokens, f"{RID} long, i string, key long, n long, ids binary"), "ids")
    spark = docs.sparkSession
    ranged = coded.select(RID, "key", "n").repartitionByRange(shuffle_partitions(spark), "key", RID).withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "order")
    base = ranged.groupBy("part").agg(F.sum("n").alias("s")).withColumn("base", F.sum("s").over(Window.orderBy("part")) - F.col("s"))  # a row for each range
    along = Window.partitionBy("part").orderBy("key", RID)
    placed = ranged.withColumn("upto", F.sum("n").over(along)).join(base, "part").select(RID, (F.col("base") + F.col("upto") - F.col("n")).alias("at"))
    whole = coded.join(placed, RID)
    cut = whole.select("i", "key", "n", "at", "ids", F.explode(F.sequence(F.floor(F.col("at") / max_len), F.floor((F.col("at") + F.col("n") - 1) / max_len))).alias("sequence_id"))
    start = F.greatest(F.lit(0).cast("long"), F.col("sequence_id") * max_len - F.col("at"))
    stop = F.least(F.col("n"), (F.col("sequence_id") + 1) * max_len - F.col("at"))
    cut = cut.withColumn("start", start).withColumn("length", stop - start)
    return cut.select(
        F.col("i").cast(docs.schema[id_col].dataType).alias(id_col),
        "start",
        "length",
        F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))").alias("ids"),
        F.col("n").alias("doc_tokens"),
        "sequence_id",
        (F.col("at") + F.col("start") - F.col("sequence_id") * max_len).alias("offset"),
        F.col("key").alias("curve_key"),
    )
