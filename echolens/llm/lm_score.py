"""Language-model scoring with a causal self-attention model over subword ids.

P(text) is a product over the text's words and an end. A word's probability mixes two models:
``word_share`` of its share of all training words, and the rest of what the attention model gives to
its ids. An id's probability is that of its class, from the attention model, which reads the subword
ids before it, times that of the id in its class, from counts over every training text of the corpus.
Classes hold about equal shares of the counted ids and gather ids with like neighbours. A word is its ids, given that a word starts, and the start of another word behind
them, so that words' probabilities sum to at most one. The model (one attention layer with position
embeddings and one hidden layer, written in numpy) is trained by Adam on every window of every
training text, as are the classes; counts of ids and words cover all texts.

Training is spread: the windows of the corpus are dealt by hash into ``ROUNDS`` parts, one after the
other; a part is dealt into shards of about ``SHARD`` windows. Each shard starts from the network so
far and goes once over its windows; the part's result is the shards' mean, by windows, and for an id's
own embedding by how often each shard met the id. Corpora of fewer than ``LEAST`` windows are gone over
again until that many windows were seen, at most four times. No task holds more than a shard.

Scoring cuts a text into windows of ``WINDOW`` inputs that overlap by ``OVERLAP``; a window scores the
positions the one before has not, with the overlap as context, so that each id is scored exactly
once. Windows of many texts go through the layers as one batch under a causal mask.

The base score beside it is that of a smoothed word unigram model. Word counts go by 64-bit word
hashes through ``common.exchange``: a block sends each of its distinct words once.

Edge cases: null and empty texts are the end alone; a null id is in the fold of the empty string;
texts are scored whole; with no training text at all every count is 0 and the model is uniform.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, answers, col_of, cuts, dump, exchange, load, materialise, n_blocks, narrow, restore_id, runs, stored, to_blocks, trim, with_rid

WINDOW, OVERLAP, WIDTH, HIDDEN, CLASSES = 32, 8, 16, 24, 64
ROUNDS, SHARD, SHARDS, LEAST = 4, 50_000, 1024, 100_000
RANGES = 32  # of ids, in which counts and embeddings of many tasks are merged
_state: dict = {}


def split_words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _encoding(path: str):
    if _state.get("path") != path:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _state.update(path=path, enc=tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), words={}, end=len(ranks))
        _state["opens"] = np.array([*(t.startswith(b" ") for t in sorted(ranks, key=ranks.get)), True])
    return _state["enc"]


def distinct_words(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of texts (as ``split_words`` cuts them), which of them each word is, and how many words each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    flat = split.flatten()
    word = pc.binary_length(flat).to_numpy() > 0  # white space at a rim leaves an empty piece
    upto = np.append(0, np.cumsum(word))[split.offsets.to_numpy()]
    coded = flat.cast(pa.large_binary()).filter(pa.array(word)).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.diff(upto)


def coded_ids(words: list[bytes], codes: np.ndarray, lens: np.ndarray, path: str, limit: int = 400_000) -> list[np.ndarray]:
    """Subword ids of texts as ``distinct_words`` gives them, each word with a space before it, then the
    end id. A bounded cache holds words already encoded."""
    enc = _encoding(path)
    known = _state["words"]
    if len(known) > limit:
        known.clear()
    parts = []
    for w in words:
        ids = known.get(w)
        if ids is None:
            known[w] = ids = np.array(enc._encode_single_piece(b" " + w), "<u4").tobytes()
        parts.append(ids)
    size = np.append(np.fromiter(map(len, parts), np.int64, len(parts)) // 4, 1)
    flat = np.append(np.frombuffer(b"".join(parts), "<u4"), _state["end"]).astype(np.int64)
    ends = np.cumsum(lens)
    codes = np.insert(codes.astype(np.int64), ends, len(parts))  # the end stands for a last word
    length = size[codes]
    upto = np.append(0, np.cumsum(length))
    ids = flat[np.repeat((np.cumsum(size) - size)[codes] - upto[:-1], length) + np.arange(upto[-1])]
    return np.split(ids, upto[ends[:-1] + np.arange(1, len(ends))])


def text_ids(texts: list[list[bytes]], path: str) -> list[np.ndarray]:
    """``coded_ids`` of texts given as words."""
    at: dict[bytes, int] = {}
    codes = np.array([at.setdefault(w, len(at)) for words in texts for w in words], np.int64)
    return coded_ids(list(at), codes, np.array([len(words) for words in texts]), path)


def side_counts(texts: list[np.ndarray], cls: np.ndarray, classes: int) -> np.ndarray:
    """(2, ids, classes + 1): how often each class (and a text's rim) is before and behind each id."""
    every, k = np.concatenate(texts), classes + 1
    lens = np.array([len(t) for t in texts])
    ends = np.cumsum(lens)
    c = cls[every]
    before, behind = np.append(classes, c[:-1]), np.append(c[1:], classes)
    before[ends[:-1]], behind[ends - 1] = classes, classes
    return np.stack([np.bincount(every * k + side, minlength=len(cls) * k).reshape(len(cls), k) for side in (before, behind)])


def neighbours(sides: np.ndarray) -> np.ndarray:
    """For each id the square roots of the shares of classes (and of a text's rim) before and behind it, drawn to
    those of all ids where it is rare: ids of like use lie near each other."""
    out = []
    for side in sides:
        n = side + 8 * side.sum(0) / side.sum()
        out.append(np.sqrt(n / n.sum(1, keepdims=True)))
    return np.concatenate(out, 1)


def flat_classes(counts: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of each id: ids by falling count, cut at equal mass."""
    weight = counts + 0.5
    order = np.argsort(-counts, kind="stable")
    mass = np.cumsum(weight[order])
    cls = np.empty(len(counts), np.int64)
    cls[order] = np.minimum((mass - weight[order] / 2) / mass[-1] * classes, classes - 1).astype(np.int64)
    return cls


def make_classes(counts: np.ndarray, texts: list[np.ndarray] = (), classes: int = CLASSES, sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Class of each id and log10 of its share there. Without texts: ids by falling count, cut at equal mass. With
    texts (or their ``sides``, counted before), ids of like neighbours: all ids are halved at equal mass along the main
    direction of their neighbours' shares, then each half, until there are ``classes`` (a power of two) of them."""
    weight = counts + 0.5
    cls = flat_classes(counts, classes)
    if texts:
        sides = side_counts(texts, cls, classes)
    if sides is not None:
        near, groups = neighbours(sides), [np.arange(len(counts))]
        while len(groups) < classes:
            halves = []
            for g in groups:
                at = 0
                if len(g) > 1:
                    d = near[g] - np.average(near[g], 0, weight[g])
                    g = g[np.argsort(d @ np.linalg.eigh((d * weight[g, None]).T @ d)[1][:, -1], kind="stable")]
                    mass = np.cumsum(weight[g])
                    at = min(max(1, int(np.searchsorted(mass, mass[-1] / 2))), len(g) - 1)
                halves += [g[:at], g[at:]]
            groups = halves
        for k, g in enumerate(groups):
            cls[g] = k
    total = np.bincount(cls, weights=weight, minlength=classes)
    return cls, np.log10(weight / total[cls])


def _flat(t: np.ndarray) -> np.ndarray:
    return t.reshape(-1, t.shape[-1])


def adam(state: np.ndarray, g: np.ndarray, rate: float, step: int) -> None:
    """One step of Adam on (values, first moments, second moments), in place."""
    p, m, s = state
    m *= np.float32(0.9)
    m += np.float32(0.1) * g
    s *= np.float32(0.99)
    s += np.float32(0.01) * (g * g)
    down = np.sqrt(s * np.float32(1 / (1 - 0.99**step)))
    down += np.float32(1e-8)
    p -= m * np.float32(rate / (1 - 0.9**step)) / down


class Attention:
    """Predicts each position's class from the subword ids before it in the window. ``cls`` is the class of each
    id; one further id, ``len(cls)``, starts a text. An id's embedding is its class's plus its own, which
    starts at zero: an id that training has not met is read as its class."""

    def __init__(self, cls: np.ndarray | None = None, seed: int = 1):
        self.cls = np.append(np.arange(CLASSES) if cls is None else cls, CLASSES)
        self.table = None
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) * 0.3 / math.sqrt(s[0] if len(s) > 1 else 1)).astype(np.float32)
        self.p = {
            "emb": (r.standard_normal((CLASSES + 1, WIDTH)) * 0.5).astype(np.float32), "own": np.zeros((len(self.cls), WIDTH), np.float32), "pos": (r.standard_normal((WINDOW, WIDTH)) * 0.2).astype(np.float32),
            "q": g(WIDTH, WIDTH) * 3, "k": g(WIDTH, WIDTH) * 3, "v": g(WIDTH, WIDTH) * 3, "o": g(WIDTH, WIDTH) * 3,
            "h": g(2 * WIDTH, HIDDEN) * 3, "hb": np.zeros(HIDDEN, np.float32), "out": g(HIDDEN, CLASSES), "b": np.zeros(CLASSES, np.float32),
        }
        self.mask = np.tril(np.ones((WINDOW, WINDOW), np.float32))

    def forward(self, x: np.ndarray, first: int = 0):
        """Logits (batch, WINDOW - first, CLASSES) of windows x (batch, WINDOW), and what the gradient needs."""
        return self.layers(self.p["emb"][self.cls[x]] + self.p["own"][x] if self.table is None else self.table[x], first)

    def layers(self, e: np.ndarray, first: int):
        """As ``forward``, from the windows' embeddings, to which it adds the positions'."""
        p = self.p
        e += p["pos"]
        top = np.ascontiguousarray(e[:, first:])
        q, k, v = ((_flat(t) @ w).reshape(t.shape) for t, w in ((top, p["q"] / np.float32(math.sqrt(WIDTH))), (e, p["k"]), (e, p["v"])))  # a product each, not one a window
        s = q @ k.transpose(0, 2, 1)
        np.clip(s, -60, 60, out=s)  # in place of taking off each row's largest
        np.exp(s, out=s)
        s *= self.mask[first:]
        r = 1 / (_flat(s) @ np.ones(WINDOW, s.dtype)).reshape(*top.shape[:2], 1)
        a = s @ v
        a *= r  # WIDTH columns in place of WINDOW
        z = np.concatenate([top, a], 2)
        w = np.concatenate([p["h"][:WIDTH], p["o"] @ p["h"][WIDTH:]])  # one product from what was attended to into the hidden layer
        h = _flat(z) @ w
        h += p["hb"]
        np.maximum(h, 0, out=h)
        d = h @ p["out"]
        d += p["b"]
        return d.reshape(len(e), -1, CLASSES), (e, top, q, k, v, s, r, a, z, w, h)

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Mean loss and its gradient over positions of weight 1."""
        loss, g, at, rows = self.sparse_gradient(x, y, weight)
        g["own"] = np.zeros_like(self.p["own"])
        g["own"][at] = rows
        return loss, g

    def sparse_gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """As ``gradient``, but own embeddings' as the ids that occur and a row for each of them."""
        p = self.p
        first = 0 if weight[:, :OVERLAP].any() else OVERLAP  # what is only context is not predicted
        y, weight = y[:, first:].ravel(), weight[:, first:].ravel()
        order = np.argsort(narrow(x), axis=None, kind="stable")  # 16 bits are sorted by their digits
        ids = x.ravel()[order]
        change = np.append(True, ids[1:] != ids[:-1])
        starts = np.flatnonzero(change)
        ids = ids[starts]
        cls = self.cls[ids]
        place = np.empty(x.shape, np.int64)
        place.ravel()[order] = np.cumsum(change) - 1
        d, (e, top, q, k, v, s, r, a, z, w, h) = self.layers((p["emb"][cls] + p["own"][ids])[place], first)  # each id is looked up once
        d = _flat(d)
        np.clip(d, -60, 60, out=d)
        np.exp(d, out=d)
        n = weight.sum()
        ones = np.ones(len(d), d.dtype)
        total, part = d @ np.ones(CLASSES, d.dtype), (weight / n).astype(d.dtype)
        own = np.arange(0, d.size, CLASSES) + y
        at = d.ravel()[own] / total
        d *= (part / total)[:, None]
        d.ravel()[own] -= part
        g = {"out": h.T @ d, "b": ones @ d}
        dh = d @ p["out"].T
        dh *= h > 0
        dw = _flat(z).T @ dh
        g["h"], g["hb"] = np.concatenate([dw[:WIDTH], p["o"].T @ dw[WIDTH:]]), ones @ dh
        g["o"] = dw[WIDTH:] @ p["h"][WIDTH:].T
        dz = (dh @ w.T).reshape(z.shape)
        da = dz[..., WIDTH:] * r
        ds = da @ v.transpose(0, 2, 1)
        dv = s.transpose(0, 2, 1) @ da
        ds -= (_flat(da * a) @ np.ones(WIDTH, a.dtype)).reshape(r.shape)  # the mean of ds by shares, from fewer columns
        ds *= s
        scale = np.float32(1 / math.sqrt(WIDTH))
        dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
        g["q"], g["k"], g["v"] = _flat(top).T @ _flat(dq) * scale, _flat(e).T @ _flat(dk), _flat(e).T @ _flat(dv)
        de = _flat(dk) @ p["k"].T
        de += _flat(dv) @ p["v"].T
        late = de.reshape(e.shape)[:, first:]
        late += dz[..., :WIDTH]
        late += (_flat(dq) @ (p["q"].T * scale)).reshape(top.shape)
        g["pos"] = (np.ones(len(e), de.dtype) @ de.reshape(len(e), -1)).reshape(WINDOW, WIDTH)
        rows = np.add.reduceat(de[order], starts)
        order = np.argsort(narrow(cls), kind="stable")
        cls = cls[order]
        starts = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
        g["emb"] = np.zeros_like(p["emb"])
        g["emb"][cls[starts]] = np.add.reduceat(rows[order], starts)
        return float(-(np.log(at + 1e-12) * weight).sum() / n), g, ids, rows

    def train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 2, batch: int = 64, rate: float = 0.01, seed: int = 2, span: tuple[float, float] = (0.0, 1.0)) -> float:
        """``span`` is the part of the whole training, from 0 to 1, that these windows are. All parameters but own
        embeddings lie end to end while it runs, so that a step is a few operations for all of them."""
        rng = np.random.default_rng(seed)
        names = [k for k in self.p if k != "own"]
        dense = np.stack([np.concatenate([self.p[k].ravel() for k in names])] + 2 * [np.zeros(sum(self.p[k].size for k in names), np.float32)])  # values, first and second moments
        own = np.stack([self.p["own"], *2 * [np.zeros_like(self.p["own"])]])
        ends = np.cumsum([self.p[k].size for k in names])
        self.p |= {k: part.reshape(self.p[k].shape) for k, part in zip(names, np.split(dense[0], ends[:-1]), strict=True)} | {"own": own[0]}
        opens = weight[:, :OVERLAP].any(1)
        parts = [np.flatnonzero(opens), np.flatnonzero(~opens)]
        step, loss, steps = 0, 0.0, max(1, epochs * sum(-(-len(i) // batch) for i in parts))
        for _ in range(epochs):
            batches = [i[lo : lo + batch] for i in map(rng.permutation, parts) for lo in range(0, len(i), batch)]
            for i in map(batches.__getitem__, rng.permutation(len(batches))):
                if not weight[i].any():
                    continue
                loss, g, ids, rows = self.sparse_gradient(x[i], y[i], weight[i])
                step += 1
                lr = rate * (1 - 0.95 * (span[0] + (span[1] - span[0]) * step / steps))
                adam(dense, np.concatenate([g[k].ravel() for k in names]), lr, step)
                some = own[:, ids]  # ids that a batch lacks rest
                adam(some, rows, lr, step)
                own[:, ids] = some
        self.p = {k: v.copy() for k, v in self.p.items()}
        self.finish()
        return loss

    def finish(self) -> None:
        """To be called when ``p`` has changed: the sum of both embeddings of each id."""
        self.table = self.p["emb"][self.cls] + self.p["own"]


def windows(texts: list[np.ndarray], start: int = CLASSES):
    """Inputs (n, WINDOW), targets, and which text each scored position is of (-1: not scored here)."""
    x, y, of = [], [], []
    step = WINDOW - OVERLAP
    for t, c in enumerate(texts):
        n = 1 + max(0, -(-(len(c) - WINDOW) // step))
        size = WINDOW + (n - 1) * step
        inp, out, own = np.full(size, 0, np.int64), np.zeros(size, np.int64), np.full(size, -1, np.int64)
        inp[0], inp[1 : len(c)], out[: len(c)], own[: len(c)] = start, c[:-1], c, t
        at = np.arange(n)[:, None] * step + np.arange(WINDOW)
        w = own[at]
        w[1:, :OVERLAP] = -1
        x.append(inp[at])
        y.append(out[at])
        of.append(w)
    return np.concatenate(x), np.concatenate(y), np.concatenate(of)


class Scorer:
    """``opens`` marks the ids that start a word; the end is one of them."""

    def __init__(self, counts: np.ndarray, sample: list[np.ndarray], opens: np.ndarray, train_windows: int | None = None, sides: np.ndarray | None = None):
        self.cls, self.within = make_classes(counts, sample, sides=sides)
        self.opens = opens
        self.share = np.bincount(self.cls, weights=opens * 10**self.within, minlength=CLASSES).astype(np.float32)
        self.net = Attention(self.cls)
        if sample:
            x, y, of = windows(sample, len(self.cls))
            pick = np.random.default_rng(4).permutation(len(x))[:train_windows]
            self.net.train(x[pick], self.cls[y[pick]], (of[pick] >= 0).astype(np.float64))

    def ids(self, ids: list[np.ndarray], batch: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """For the ids laid end to end: log10 probability of each, and of any word start in its place."""
        x, y, of = windows(ids, len(self.cls))
        y = self.cls[y]
        every = np.concatenate(ids)
        place = np.full(of.shape, -1)
        place[of >= 0] = np.arange(len(every))  # windows score the ids in their order
        lp, start = np.empty(len(every)), np.empty(len(every))
        opening = np.flatnonzero((of[:, 0] >= 0) & (x[:, 0] == len(self.cls)))
        both = np.stack([np.ones_like(self.share), self.share], 1)
        for rows, first in ((opening, 0), (np.setdiff1d(np.arange(len(x)), opening, assume_unique=True), OVERLAP)):
            for lo in range(0, len(rows), batch):
                r = rows[lo : lo + batch]
                logits = _flat(self.net.forward(x[r], first)[0])
                np.clip(logits, -60, 60, out=logits)
                own, target = place[r, first:].ravel(), y[r, first:].ravel()
                on = np.flatnonzero(own >= 0)
                at = logits.ravel()[on * CLASSES + target[on]]
                np.exp(logits, out=logits)
                total, opening_mass = np.log(logits @ both)[on].T
                lp[own[on]] = at - total
                start[own[on]] = opening_mass - total
        return lp / math.log(10) + self.within[every], start / math.log(10)

    def words(self, ids: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each word, ends included, of texts laid end to end."""
        lp, start = self.ids(ids)
        first = np.flatnonzero(self.opens[np.concatenate(ids)])
        behind = np.append(start[first[1:]], 0.0)
        last = np.cumsum([self.opens[i].sum() for i in ids]) - 1
        behind[last] = 0.0  # nothing follows an end
        return np.add.reduceat(lp, first) - start[first] + behind


def mixed(word: np.ndarray, share: np.ndarray, word_share: float) -> np.ndarray:
    """log10 of word_share * share + (1 - word_share) * 10 ** word."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(word_share * share), word * math.log(10) + math.log1p(-word_share)) / math.log(10)


def id_type(end: int) -> str:
    return "<u2" if end < 1 << 16 else "<u4"


def encoded(texts: DataFrame, tokenizer_path: str, end: int, rows: int = 16) -> DataFrame:
    """(r, texts, windows, ids) for every ``rows`` texts of column t: their ids end to end, each text closed by the end id."""

    def run(batches):
        for pdf in batches:
            chars = np.append(0, np.cumsum(pdf["t"].str.len()))
            lo = 0
            while lo < len(pdf):
                hi = lo + rows
                while hi < len(pdf) and chars[min(hi + rows, len(pdf))] - chars[lo] <= 4_000_000:
                    hi += rows
                every = coded_ids(*distinct_words(pdf["t"].iloc[lo:hi].tolist()), tokenizer_path)
                for k in range(0, len(every), rows):
                    ids = every[k : k + rows]
                    n = sum(1 + max(0, -(-(len(i) - WINDOW) // (WINDOW - OVERLAP))) for i in ids)
                    yield pd.DataFrame({"r": [int(pdf[RID].iloc[lo + k])], "texts": [len(ids)], "windows": [n], "ids": [np.concatenate(ids).astype(id_type(end)).tobytes()]})
                lo = hi
        trim()

    return materialise(with_rid(texts.select("t")).mapInPandas(run, "r long, texts long, windows long, ids binary"), "ids")


def decoded(data: bytes, end: int) -> list[np.ndarray]:
    """The texts of a row of ``encoded``."""
    ids = np.frombuffer(data, id_type(end)).astype(np.int64)
    return np.split(ids, np.flatnonzero(ids == end)[:-1] + 1)


def _ranges(n: int) -> np.ndarray:
    return np.arange(RANGES + 1) * n // RANGES


def count_ids(table: DataFrame, end: int) -> np.ndarray:
    """How often each id occurs in all rows of ``encoded``."""

    def run(batches):
        n = np.zeros(end + 1, np.int64)
        for pdf in batches:
            for d in pdf["ids"]:
                n += np.bincount(np.frombuffer(d, id_type(end)), minlength=end + 1)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"id": at, "n": n[at]})

    out = np.zeros(end + 1)
    for r in table.select("ids").mapInPandas(run, "id long, n long").groupBy("id").sum("n").collect():  # one row per id of the vocabulary in all
        out[r[0]] = r[1]
    return out


def count_sides(table: DataFrame, cls: np.ndarray, end: int, classes: int = CLASSES) -> np.ndarray:
    """``side_counts`` over all rows of ``encoded``."""
    k, at = classes + 1, _ranges(end + 1)

    def run(batches):
        n = np.zeros((2, end + 1, k), np.int64)
        for pdf in batches:
            for lo in range(0, len(pdf), 64):
                n += side_counts([t for d in pdf["ids"].iloc[lo : lo + 64] for t in decoded(d, end)], cls, classes)
        data = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            flat = n[:, a:b].ravel()
            on = np.flatnonzero(flat)
            data.append(dump(on.astype(np.uint32), narrow(flat[on])))
        yield pd.DataFrame({"part": range(RANGES), "data": data})
        trim()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        n = np.zeros(2 * int(at[part + 1] - at[part]) * k, np.int64)
        for on, v in map(load, pdf["data"]):
            n[on] += v.astype(np.int64)
        on = np.flatnonzero(n)
        return pd.DataFrame({"part": [part], "data": [dump(on.astype(np.uint32), narrow(n[on]))]})

    tasks = max(1, table.rdd.getNumPartitions() // 4)
    out = np.zeros((2, end + 1, k), np.int64)
    for part, data in table.select("ids").coalesce(tasks).mapInPandas(run, "part int, data binary").groupBy("part").applyInPandas(merge, "part int, data binary").collect():
        on, v = load(data)
        n = np.zeros(2 * int(at[part + 1] - at[part]) * k, np.int64)
        n[on] = v
        out[:, at[part] : at[part + 1]] = n.reshape(2, -1, k)
    return out


def train_round(net: Attention, table: DataFrame, shards: int, end: int, span: tuple[float, float]) -> int:
    """One pass of each shard over its windows, then the shards' mean; returns the number of windows."""
    old, at = {k: v.copy() for k, v in net.p.items()}, _ranges(len(net.cls))
    cls = net.cls[:-1]

    def run(batches):
        rows = sorted((int(r), int(n), d) for pdf in batches for r, n, d in zip(pdf["r"], pdf["windows"], pdf["ids"], strict=True))
        if not rows:
            return
        mine, seen, total = Attention(cls), np.zeros(len(cls) + 1, np.int64), sum(n for _, n, _ in rows)
        mine.p = {k: v.copy() for k, v in old.items()}
        order, done, lo = np.random.default_rng(rows[0][0]).permutation(len(rows)), 0, 0
        while lo < len(order):  # a shard of a vast corpus goes in slices
            hi, n = lo, 0
            while hi < len(order) and (hi == lo or n + rows[order[hi]][1] <= 2 * SHARD):
                n += rows[order[hi]][1]
                hi += 1
            x, y, of = windows([t for i in order[lo:hi] for t in decoded(rows[i][2], end)], len(cls))
            part = [span[0] + (span[1] - span[0]) * d / total for d in (done, done + n)]
            mine.table = None  # it trains on
            mine.train(x, cls[y], (of >= 0).astype(np.float64), epochs=1, seed=lo, span=tuple(part))
            seen += np.bincount(x.ravel(), minlength=len(seen))
            lo, done = hi, done + n
        small = {k: v for k, v in mine.p.items() if k != "own"}
        data = [dump(small, total), *(dump(mine.p["own"][a:b] - old["own"][a:b], seen[a:b]) for a, b in zip(at[:-1], at[1:], strict=True))]
        yield pd.DataFrame({"part": range(-1, RANGES), "shard": rows[0][0], "data": data})
        trim()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        part, got = int(pdf["part"].iloc[0]), (load(d) for d in pdf.sort_values("shard")["data"])  # sums in a fixed order
        if part < 0:
            every, total = {k: np.zeros(v.shape) for k, v in old.items() if k != "own"}, 0
            for p, n in got:
                total += n
                for k, v in p.items():
                    every[k] += n * v.astype(np.float64)
            return pd.DataFrame({"part": [part], "data": [dump({k: (v / total).astype(np.float32) for k, v in every.items()}, total)]})
        move, met = np.zeros((int(at[part + 1] - at[part]), WIDTH)), 0
        for d, n in got:
            move += n[:, None] * d.astype(np.float64)
            met = met + n
        return pd.DataFrame({"part": [part], "data": [dump((move / np.maximum(met, 1)[:, None]).astype(np.float32))]})

    windows_seen = 0
    for part, data in table.repartition(shards, "r").mapInPandas(run, "part int, shard long, data binary").groupBy("part").applyInPandas(merge, "part int, data binary").collect():
        got = load(data)
        if part < 0:
            net.p.update(got[0])
            windows_seen = got[1]
        else:
            net.p["own"][at[part] : at[part + 1]] += got[0]
    net.finish()
    return windows_seen


def train_corpus(net: Attention, table: DataFrame, end: int, total: int) -> int:
    """Trains on every one of the ``total`` windows of ``encoded``'s rows; returns how many were seen."""
    if not total:
        return 0
    rounds, seen = ROUNDS * min(4, -(-LEAST // total)), 0
    shards = min(SHARDS, max(1, round(total / ROUNDS / SHARD)))
    for k in range(rounds):
        part = table.where(F.pmod(F.xxhash64("r"), F.lit(ROUNDS)) == k % ROUNDS)
        seen += train_round(net, part, shards, end, (k / rounds, (k + 1) / rounds))
    return seen


def score_corpus(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1, word_share: float = 0.5) -> DataFrame:
    """(__rid, id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) per document."""
    docs = stored(docs)
    count = n_blocks(docs, 4)
    fold = F.crc32(F.coalesce(col_of(docs, id_col).cast("string"), F.lit(""))) % folds
    blocks = to_blocks(docs, id_col, text_col, n_blocks(docs, 2), (fold != held).alias("train"))

    def parse(pdf: pd.DataFrame):
        pdf = pdf.sort_values(RID)
        words, codes, lens = distinct_words(pdf["text"].tolist())
        keys, inverse = np.unique(word_keys(words), return_inverse=True)
        learnt = np.repeat(pdf["train"].to_numpy(), lens)
        counts = np.bincount(inverse[codes[learnt]], minlength=len(keys))
        at = cuts(keys, count)
        for b in range(count):
            if at[b] < at[b + 1]:
                yield 0, b, dump(keys[at[b] : at[b + 1]], narrow(counts[at[b] : at[b + 1]]))

    def merge(kind: int, data: list[tuple]) -> list[bytes]:
        group, n, at = runs([d[0] for d in data])
        total = np.bincount(group, weights=np.concatenate([d[1] for d in data]), minlength=n).astype(np.int64)
        known = int((total > 0).sum()), int(total.sum())
        return [dump(narrow(total[group[a:b]]), *(known if not a else (0, 0))) for a, b in zip(at[:-1], at[1:], strict=True)]

    told = materialise(exchange(blocks, parse, merge), "counts")

    def sums(batches):
        for pdf in batches:
            got = [load(d)[1:] for d in pdf["data"]]
            yield pd.DataFrame({"v": [sum(g[0] for g in got)], "n": [sum(g[1] for g in got)]})

    v, n = told.select("data").mapInPandas(sums, "v long, n long").agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    texts = docs.where(fold != held).select(F.coalesce(col_of(docs, text_col).cast("string"), F.lit("")).alias("t"))
    _encoding(tokenizer_path)
    end = _state["end"]
    table = encoded(texts, tokenizer_path, end)
    n_train, n_windows = table.agg(F.coalesce(F.sum("texts"), F.lit(0)), F.coalesce(F.sum("windows"), F.lit(0))).first()
    v, n = v + (n_train > 0), n + n_train
    id_counts = count_ids(table, end)
    sides = count_sides(table, flat_classes(id_counts), end) if n_train else None
    scorer = Scorer(id_counts, [], _state["opens"], sides=sides)
    train_corpus(scorer.net, table, end, n_windows)
    floor = n + 0.5 * (v + 1)

    def score(pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(RID)
        words, codes, lens = distinct_words(pdf["text"].tolist())
        keys, inverse = np.unique(word_keys(words), return_inverse=True)
        inverse = inverse[codes]
        ids = coded_ids(words, codes, lens, tokenizer_path)
        counts = [a[0] for a in answers(got).get(0, [])]
        c = np.concatenate(counts).astype(np.int64) if counts else np.zeros(len(keys), np.int64)
        row = np.repeat(np.arange(len(pdf)), lens)
        logs = np.log10((c + 0.5) / floor)
        base = np.bincount(row, weights=logs[inverse], minlength=len(pdf)) + math.log10((n_train + 0.5) / floor)
        known = np.bincount(row, weights=(c > 0)[inverse], minlength=len(pdf)).astype(np.int64) + (n_train > 0)
        scores, upto = [], np.cumsum([0, *lens])
        for lo in range(0, len(pdf), 64):
            hi = min(lo + 64, len(pdf))
            of_words = np.append(c[inverse[upto[lo] : upto[hi]]], 0)  # the last entry stands for an end
            place = np.insert(np.arange(upto[hi] - upto[lo]), upto[lo + 1 : hi + 1] - upto[lo], -1)
            share = np.where(place < 0, n_train, of_words[place]) / max(1, n)
            per_word = mixed(scorer.words(ids[lo:hi]), share, word_share)
            scores.append(np.add.reduceat(per_word, upto[lo:hi] - upto[lo] + np.arange(hi - lo)))
        return pd.DataFrame({RID: pdf[RID].to_numpy(), "id": pdf["id"].to_numpy(), "held_out": ~pdf["train"].to_numpy(), "n_tokens": lens + 1, "n_known": known, "base_score": base, "score": np.concatenate(scores)})

    out = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(score, f"{RID} long, id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(RID, restore_id("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")
