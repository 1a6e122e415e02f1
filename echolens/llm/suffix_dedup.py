"""Repeated byte strings, by prefix-free parsing.

A rolling hash over ``GRAM`` bytes names a trigger for every window of ``span`` bytes: the window's
smallest gram hash. Consecutive windows with one trigger form a phrase, whose bytes reach to the end
of its last window, so that phrases overlap by span - 1 bytes, every window lies in exactly one
phrase, and equal windows have equal triggers wherever they stand. The parse is each document's
sequence of phrases; the dictionary is the set of distinct phrases.

Corpus order of windows comes from both parts. The dictionary's phrases are sorted by their bytes, and
where a trigger has several phrases, so are all suffixes of these phrases, up to ``span`` bytes: the
dictionary's suffix array, cut at the depth that the answer needs. The parse says which documents hold
a phrase; a run of equal suffixes takes the smallest document of its phrases, and the window is removed
from every document above that one. Equality is always decided on bytes; hashes only deal out work.

There are two exchanges (``common.exchange``). In the first, blocks send their distinct triggers, by 48
bits; most occur in one block only, and that block sorts its own phrases. In the second, the phrases of
triggers that several blocks hold go, with their bytes and smallest document, to the owner of the
trigger's range, who sorts them. Triggers are mixed once more before: the smallest of many hashes lie
low, and the first ranges would hold most of them. A trigger of more than ``hot`` phrases (some string of GRAM bytes in
very many contexts) is not gathered: its windows go singly, by their own hashes, to owners of their own.
A block sends each distinct phrase, trigger or window once, so a passage in a third of all documents is
a single row per block. Triggers that agree in 48 bits only share an owner.

Edge cases: null text is empty; texts shorter than span keep all bytes; very long texts are parsed in
tiles that overlap; ids are integers, a null id counts as larger than any other; rows with the same id
never remove each other's bytes; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, answers, cuts, dump, exchange, join48, load, mix64, n_blocks, narrow, restore_id, runs, split48, stored, to_blocks

GRAM = 24
TILE = 1 << 17
_B = 0x9FB21C651E98DF25
_rng = np.random.default_rng(11)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)


def _powers(n: int) -> list[np.uint64]:
    return [np.uint64(pow(_B, i, 1 << 64)) for i in range(n + 1)]


_POW = _powers(64)
#: Suffixes that are sorted at once, about.
AT_ONCE = 1 << 18


def _grown(parts: dict[int, np.ndarray], want: int) -> np.ndarray:
    """Polynomial hashes of every substring of ``want`` bytes, from those of powers of two."""
    out, length = None, 0
    for k in sorted(parts, reverse=True):
        while length + k <= want:
            if out is None:
                out = parts[k]
            else:
                n = min(len(out), len(parts[k]) - length)
                out = out[:n] * _POW[k] + parts[k][length : length + n]
            length += k
    return out


def phrases(data: np.ndarray, ends: np.ndarray, span: int):
    """Phrases of texts laid end to end: (first window, number of windows, trigger), and the window
    hashes. ends: where each text stops. Windows that leave their text are in no phrase."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    n = len(data) - span + 1
    if n <= 0:
        return none
    parts = {1: _BYTE[data]}
    k = 1
    while 2 * k <= span:
        h = parts[k]
        if len(h) <= k:
            break
        parts[2 * k] = h[:-k] * _POW[k] + h[k:]
        k *= 2
    gram, window = mix64(_grown(parts, GRAM)), mix64(_grown(parts, span))
    w = span - GRAM + 1
    low, k = gram, 1
    while 2 * k <= w:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    low = np.minimum(low[:n], low[w - k : w - k + n])
    inside = np.ones(n, bool)
    for e in ends[:-1]:
        inside[max(0, e - span + 1) : min(e, n)] = False
    new = np.ones(n, bool)
    new[1:] = (low[1:] != low[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, n))
    if len(length) and length.max() > w:  # a trigger that repeats in its own window
        since = np.arange(n) - np.repeat(first, length)
        first = np.flatnonzero(new | (since % w == 0))
        length = np.diff(np.append(first, n))
    keep = inside[first]
    first, length = first[keep], length[keep]
    return first, length, low[first], window


class Block:
    """The parse of a block's documents, tile by tile."""

    def __init__(self, pdf: pd.DataFrame, span: int):
        self.rows = pdf.sort_values(RID)
        self.texts = [t.encode() for t in self.rows["text"]]
        self.ids = self.rows["id"].to_numpy()
        self.span = span
        doc, at, length, trigger, key = [], [], [], [], []
        for docs, starts, data, ends in self._tiles():
            first, run, trig, window = phrases(data, ends, span)
            if len(first):
                which = np.searchsorted(ends, first, side="right")
                doc.append(docs[which])
                at.append(first - (ends[which] - starts[which][:, 1]) + starts[which][:, 0])
                length.append(run)
                trigger.append(trig)
                key.append(_phrase_key(window[first], window[first + run - 1], run))
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.doc, self.at, self.length = cat(doc, np.int64), cat(at, np.int64), cat(length, np.int64)
        self.trigger, key = mix64(cat(trigger, np.uint64)), cat(key, np.uint64)
        for salt in range(100):
            _, self.first, self.phrase = np.unique(key, return_index=True, return_inverse=True)
            odd = self._unlike(np.flatnonzero(self.first[self.phrase] != np.arange(len(key))))
            if not len(odd):
                break
            for k in odd:  # equal hashes, other bytes
                key[k] = int.from_bytes(hashlib.blake2b(self._piece(k) + bytes([salt]), digest_size=8).digest(), "big")
        self.low = np.full(len(self.first), np.iinfo(np.int64).max)
        np.minimum.at(self.low, self.phrase, self.ids[self.doc])

    def _piece(self, k: int) -> bytes:
        return self.texts[self.doc[k]][self.at[k] : self.at[k] + self.length[k] + self.span - 1]

    def _unlike(self, which: np.ndarray) -> np.ndarray:
        """Those occurrences whose bytes are not those of their phrase's first occurrence."""
        out = []
        for lo in range(0, len(which), 1 << 15):
            part = which[lo : lo + (1 << 15)]
            of = self.first[self.phrase[part]]
            if (self.length[part] != self.length[of]).any() or self.bytes(part) != self.bytes(of):
                out += [k for k, f in zip(part.tolist(), of.tolist(), strict=True) if self._piece(k) != self._piece(f)]
        return np.array(out, np.int64)

    def bytes(self, which: np.ndarray) -> bytes:
        """These occurrences' bytes end to end."""
        size = self.length[which] + self.span - 1
        return b"".join([self.texts[d][a : a + n] for d, a, n in zip(self.doc[which].tolist(), self.at[which].tolist(), size.tolist(), strict=True)])

    def _tiles(self):
        """(documents, [offset in the document, bytes], the bytes, where each ends): short texts together, long ones cut with overlap."""
        docs, starts, parts, size = [], [], [], 0
        for d, t in enumerate(self.texts):
            for lo in range(0, max(1, len(t) - self.span + 1), TILE):
                piece = t[lo : lo + TILE + self.span - 1]
                if len(piece) < self.span:
                    continue
                docs.append(d)
                starts.append((lo, len(piece)))
                parts.append(piece)
                size += len(piece)
                if size >= TILE:
                    yield self._tile(docs, starts, parts)
                    docs, starts, parts, size = [], [], [], 0
        if docs:
            yield self._tile(docs, starts, parts)

    @staticmethod
    def _tile(docs, starts, parts):
        s = np.array(starts, np.int64)
        return np.array(docs), s, np.frombuffer(b"".join(parts), np.uint8), np.cumsum(s[:, 1])


def _phrase_key(first: np.ndarray, last: np.ndarray, run: np.ndarray) -> np.ndarray:
    """A phrase's hash, from its first and last windows, which cover it."""
    return mix64(first * np.uint64(3) + mix64(last) + run.astype(np.uint64))


def byte_runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (n, width) of bytes in order: the order, where each run of equal rows begins in it, each row's run."""
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    new = np.ones(n, bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]).any(1)
    run = np.empty(n, np.int64)
    run[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), run


def _cut(data: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes from each place on, zeros beyond the end; rows are copied when taken."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(width, np.uint8)]), width)


def smallest_documents(trigger: np.ndarray, data: np.ndarray, run: np.ndarray, ids: np.ndarray, span: int) -> np.ndarray:
    """For phrases laid end to end (run: their windows), with a document each, the smallest document of
    every window: the dictionary is sorted by phrases, then by suffixes where a trigger has several."""
    if not len(run):
        return np.zeros(0, np.int64)
    size = run + span - 1
    start = np.cumsum(size) - size
    widest = int(size.max())
    whole = _cut(data, widest + 2)[start]
    whole[np.arange(widest + 2) >= size[:, None]] = 0
    whole[:, widest:] = (run[:, None] >> np.array([8, 0])) & 255  # phrases that differ in length differ
    order, first, phrase = byte_runs(whole)
    low = np.minimum.reduceat(ids[order], first)
    out = np.repeat(low[phrase], run)

    of = np.unique(trigger, return_inverse=True)[1]
    least, most = np.full(of.max() + 1, len(first)), np.full(of.max() + 1, -1)
    np.minimum.at(least, of, phrase)
    np.maximum.at(most, of, phrase)
    several = np.flatnonzero((least != most)[of])
    if not len(several):
        return out
    distinct, one = np.unique(phrase[several], return_index=True)
    rep = several[one][np.argsort(of[several[one]], kind="stable")]  # a phrase of each kind, by trigger
    suffix, base = _cut(data, span), np.zeros(len(first), np.int64)
    done = [np.zeros(0, np.int64)]
    upto, total = np.cumsum(run[rep]), 0
    last = np.append(of[rep[1:]] != of[rep[:-1]], True)
    lo = 0
    for hi in np.flatnonzero(last) + 1:
        if hi < len(rep) and upto[hi - 1] - total < AT_ONCE:
            continue
        part = rep[lo:hi]
        k = run[part]
        base[phrase[part]] = total + np.cumsum(k) - k
        place = np.repeat(start[part], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        order, begin, group = byte_runs(suffix[place])
        done.append(np.minimum.reduceat(np.repeat(low[phrase[part]], k)[order], begin)[group])
        lo, total = hi, int(upto[hi - 1])
    k = run[several]
    within = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    at = np.repeat((np.cumsum(run) - run)[several], k) + within
    out[at] = np.concatenate(done)[np.repeat(base[phrase[several]], k) + within]
    return out


def _pack(ids: np.ndarray) -> tuple:
    """Ids as 16 bits and the rest, which compresses well."""
    x = ids.astype(np.int64).view(np.uint64)
    rest = narrow(x >> np.uint64(16))
    return (x & np.uint64(0xFFFF)).astype(np.uint16), rest.dtype.str, zlib.compress(rest.view(np.uint8).reshape(len(x), rest.itemsize).T.tobytes(), 1)


def _unpack(packed: tuple) -> np.ndarray:
    low, kind, rest = packed
    high = np.frombuffer(zlib.decompress(rest), np.uint8).reshape(np.dtype(kind).itemsize, len(low)).T.copy().view(kind)[:, 0]
    return ((high.astype(np.uint64) << np.uint64(16)) | low).view(np.int64)


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _expand(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


class Known(Block):
    """A block with what it has been told of its triggers."""

    def __init__(self, pdf: pd.DataFrame, got: pd.DataFrame, span: int):
        super().__init__(pdf, span)
        told = answers(got)
        of = np.unique(self.trigger, return_inverse=True)[1]
        flags = [np.concatenate([np.unpackbits(d[f], count=d[-1]).astype(bool) for d in told.get(1, [])] or [np.zeros(0, bool)]) for f in (0, 1)]
        shared, hot = (f[of[self.first]] if len(f) else np.zeros(len(self.first), bool) for f in flags)
        order = np.argsort(self.trigger[self.first], kind="stable")  # distinct phrases by trigger
        self.own, self.sent, self.hot = (order[on[order]] for on in (~shared, shared & ~hot, hot))
        self.told = told

    def hot_windows(self):
        """Distinct windows of hot triggers by hash: their bytes, hashes and smallest documents; which is each window of ``hot``'s phrases."""
        occ = self.first[self.hot]
        run = self.length[occ]
        if not len(run):
            return np.zeros((0, self.span), np.uint8), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = run + self.span - 1
        place = np.repeat(np.cumsum(size) - size, run) + np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
        rows = _cut(np.frombuffer(self.bytes(occ), np.uint8), self.span)[place]
        order, begin, group = byte_runs(rows)
        low = np.minimum.reduceat(np.repeat(self.low[self.hot], run)[order], begin)
        rows = rows[order[begin]]
        words = np.zeros((len(rows), -(-self.span // 8) * 8), np.uint8)
        words[:, : self.span] = rows
        key = np.zeros(len(rows), np.uint64)
        for w in words.view("<u8").T:
            key = mix64(key * np.uint64(_B) + w)
        by = np.argsort(key, kind="stable")
        back = np.empty(len(by), np.int64)
        back[by] = np.arange(len(by))
        return rows[by], key[by], low[by], back[group]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 50, hot: int = 2048) -> DataFrame:
    """(__rid, id_col, n_bytes, spans array<struct<start,end>>, kept binary): what of each text also
    starts, span bytes at a time, in a document with a smaller id."""
    docs = stored(docs)
    buckets = n_blocks(docs, 3)
    blocks = to_blocks(docs, id_col, text_col, n_blocks(docs, 2))

    def parse(pdf: pd.DataFrame):
        b = Block(pdf, span)
        trig, count = np.unique(b.trigger[b.first], return_counts=True)
        at = cuts(trig, buckets)
        for c in range(buckets):
            if at[c] < at[c + 1]:
                part = slice(at[c], at[c + 1])
                yield 1, c, dump(*split48(trig[part]), zlib.compress(np.minimum(count[part], 255).astype(np.uint8).tobytes(), 1))

    def meet(_: int, data: list[tuple]) -> list[bytes]:
        """Is a trigger in several blocks? Has it more than ``hot`` phrases?"""
        group, n, at = runs([join48(d[0], d[1]) for d in data])
        many = np.bincount(group, minlength=n) > 1
        phrases = np.bincount(group, weights=np.concatenate([np.frombuffer(zlib.decompress(d[2]), np.uint8) for d in data]), minlength=n)
        over = (many & (phrases > hot))[group]
        return [dump(np.packbits(many[group[x:y]]), np.packbits(over[x:y]), int(y - x)) for x, y in zip(at[:-1], at[1:], strict=True)]

    def ask(pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame([], columns=["kind", "bucket", "block", "data"])
        b = Known(pdf, got, span)
        block, out = int(pdf["block"].iloc[0]), []
        occ = b.first[b.sent]
        at = cuts(b.trigger[occ], buckets)
        for c in range(buckets):
            if at[c] < at[c + 1]:
                part = occ[at[c] : at[c + 1]]
                out.append((2, c, block, dump(*split48(b.trigger[part]), narrow(b.length[part]), _squeeze(b.bytes(part)), _pack(b.low[b.sent[at[c] : at[c + 1]]]))))
        rows, key, low, _ = b.hot_windows()
        at = cuts(key, buckets)
        for c in range(buckets):
            if at[c] < at[c + 1]:
                out.append((3, c, block, dump(_squeeze(rows[at[c] : at[c + 1]].tobytes()), _pack(low[at[c] : at[c + 1]]))))
        return pd.DataFrame(out, columns=["kind", "bucket", "block", "data"])

    def owner(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each block's phrases, or hot windows: is a window's smallest document below that of the block's phrase?"""
        data = [load(d) for d in pdf["data"]]
        ids = [_unpack(d[-1]) for d in data]
        every = np.concatenate(ids)
        if pdf["kind"].iloc[0] == 2:
            run = [d[2].astype(np.int64) for d in data]
            trigger = np.concatenate([join48(d[0], d[1]) for d in data])
            low = smallest_documents(trigger, np.concatenate([_expand(d[3]) for d in data]), np.concatenate(run), every, span)
            below, sizes = low < np.repeat(every, np.concatenate(run)), [int(r.sum()) for r in run]
        else:
            order, begin, group = byte_runs(np.concatenate([_expand(d[0]) for d in data]).reshape(-1, span))
            below, sizes = np.minimum.reduceat(every[order], begin)[group] < every, [len(i) for i in ids]
        at = np.cumsum([0, *sizes])
        return pdf[["block", "kind", "bucket"]].assign(data=[dump(np.packbits(below[x:y]), int(y - x)) for x, y in zip(at[:-1], at[1:], strict=True)])

    def cover(pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame([], columns=[RID, "id", "n_bytes", "spans", "kept"])
        b = Known(pdf, got, span)
        run = b.length[b.first]
        base = np.cumsum(run) - run
        below = np.zeros(int(run.sum()), bool)  # for each window of each distinct phrase

        def put(which: np.ndarray, flags: np.ndarray) -> None:
            k = run[which]
            below[np.repeat(base[which], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)] = flags

        said = lambda kind: np.concatenate([np.unpackbits(d[0], count=d[1]).astype(bool) for d in b.told.get(kind, [])] or [np.zeros(0, bool)])
        if len(b.own):  # triggers of this block alone: only those with several phrases can repeat anything
            t = b.trigger[b.first[b.own]]
            alike = np.zeros(len(t), bool)
            alike[1:] |= t[1:] == t[:-1]
            alike[:-1] |= t[1:] == t[:-1]
            own = b.own[alike]
            low = smallest_documents(t[alike], np.frombuffer(b.bytes(b.first[own]), np.uint8), run[own], b.low[own], span)
            put(own, low < np.repeat(b.low[own], run[own]))
        put(b.sent, said(2))
        if len(b.hot):
            _, _, low, of = b.hot_windows()
            put(b.hot, said(3)[of] | (low[of] < np.repeat(b.low[b.hot], run[b.hot])))

        size = np.array([len(t) for t in b.texts], np.int64) + 1
        place = np.cumsum(size) - size
        removed = np.zeros(int(size.sum()) + 1, np.int32)

        def mark(doc, start, windows):
            np.add.at(removed, place[doc] + start, 1)
            np.add.at(removed, place[doc] + start + windows + span - 1, -1)

        above = b.ids[b.doc] > b.low[b.phrase]
        gone = np.flatnonzero(above)
        mark(b.doc[gone], b.at[gone], b.length[gone])
        some = np.add.reduceat(below, base) > 0 if len(base) else np.zeros(0, bool)
        left = np.flatnonzero(~above & some[b.phrase]) if len(base) else np.zeros(0, np.int64)
        k = b.length[left]
        offset = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        hit = below[np.repeat(base[b.phrase[left]], k) + offset] if len(left) else np.zeros(0, bool)
        occ = np.repeat(left, k)[hit]
        mark(b.doc[occ], b.at[occ] + offset[hit], np.ones(len(occ), np.int64))
        rows = []
        covered = np.cumsum(removed) > 0
        for rid, i, t, lo in zip(b.rows[RID].to_numpy(), b.ids, b.texts, place, strict=True):
            on = covered[lo : lo + len(t)]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]])))
            spans = [{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)]
            rows.append((rid, i, len(t), spans, np.frombuffer(t, np.uint8)[~on].tobytes() if spans else t))
        return pd.DataFrame(rows, columns=[RID, "id", "n_bytes", "spans", "kept"])

    by_block = blocks.groupBy("block")
    known = exchange(blocks, parse, meet)
    asked = by_block.cogroup(known.groupBy("block")).applyInPandas(ask, "kind int, bucket int, block long, data binary")
    known = known.union(asked.groupBy("kind", "bucket").applyInPandas(owner, "block long, kind int, bucket int, data binary"))
    final = by_block.cogroup(known.groupBy("block")).applyInPandas(cover, f"{RID} long, id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return final.select(RID, restore_id("id").alias(id_col), "n_bytes", "spans", "kept")
