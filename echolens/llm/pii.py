"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The model sees regions around digits and address signs, as tokens. A segmentation cuts a region into
entity segments of up to ``MAX_LEN`` tokens and single other tokens; its score is the sum of its
segments' scores, each a weighted sum of facts about the whole span (digit count, group pattern,
check sum, octets, separators, words beside it), so boundaries and types are chosen jointly by
dynamic programming. Weights maximise the conditional likelihood of generated labelled regions
(fixed seed) by forward-backward sums over all segmentations.

Spans of the fixed patterns always stay; the model adds entities that overlap none of them, such as
spelled-out addresses, numbers without a country code, and other separators.

Edge cases: null and empty texts have no spans; very long texts are scanned whole, region by region;
offsets are code points, end exclusive; repeated rows are scanned one by one.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, col_of, with_rid

KINDS = ("email", "ip", "card", "phone")
#: Tokens of an entity: 10[.]0[.]0[.]1 has 13, john.smith [at] mail [dot] example [dot] com 15.
MAX_LEN = 24
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_SPELLED = re.compile(r"(?:[\[({<] ?at ?[\])}>]| at )[^\n]{1,80}?(?:[\[({<] ?dot ?[\])}>]| dot )", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_TRIGGER = re.compile(r"[0-9]+|@")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in text.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, by kind and start. Each kind's search is linear in the text."""
    out, upto, p = [], 0, text.find("@")
    while p >= 0:
        s = p
        while s > upto and text[s - 1] in _LOCAL:
            s -= 1
        if s < p and (m := _DOMAIN.match(text, p + 1)):
            out.append(("email", s, m.end()))
            upto = m.end()
        p = text.find("@", max(p + 1, upto))
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


# ---- the model ---------------------------------------------------------------------------------
_BESIDE = (("mail", "email", "contact", "write"), ("phone", "tel", "call", "fax", "mobile", "telefon"), ("card", "visa", "credit", "pan", "payment"), ("ip", "host", "server", "address", "addr"), ("order", "invoice", "id", "no", "ref", "version", "isbn", "page", "sku", "token", "key", "password"))
_GROUPS = {"16": 0, "4-4-4-4": 1, "15": 2, "4-6-5": 3, "3-3-4": 4, "1-3-3-4": 5, "10": 6, "2-2-2-2-2": 7, "4-2-2": 8, "2-2-4": 9, "3-4": 10, "11": 11, "2-3-3-4": 12, "3-4-4": 13, "14": 14, "2-4-6": 15}
_MORE = re.compile(r"\s?[\[({<]\s?dot\s?[\])}>]\s?[a-z0-9]| dot [a-z0-9]", re.IGNORECASE)
N_FACTS = 81


def facts(text: str, toks: list[tuple[int, int]], i: int, j: int) -> list[int]:
    """Facts that hold of the span of tokens i..j (inclusive)."""
    a, b = toks[i][0], toks[j][1]
    s = text[a:b]
    groups = re.findall(r"[0-9]+", s)
    n = sum(map(len, groups))
    letters = sum(c.isascii() and c.isalpha() for c in s)
    low = s.lower()
    f = [0, 1 + min(n, 20)]
    pattern = _GROUPS.get("-".join(str(len(g)) for g in groups))
    if pattern is not None:
        f.append(22 + pattern)
    if 13 <= n <= 19:
        f.append(38 + luhn("".join(groups)))
    if len(groups) == 4 and not letters:
        f.append(40 + all(len(g) <= 3 and int(g) <= 255 for g in groups))
    at = "@" in s or bool(re.search(r"[\[({<\s]at[\])}>\s]", low))
    dot = bool(re.search(r"\.[a-z]{2,8}$|[\[({<\s]dot[\])}>\s] ?[a-z]{2,8}$", low))
    f.append(42 + at + 2 * dot)
    f.append(46 if not letters else 47 if not n else 48)
    seps = {c for c in s if not c.isalnum()}
    f += [k for k, c in ((49, " "), (50, "-"), (51, "."), (52, "("), (53, "/"), (54, ":"), (55, "_"), (56, "\n"), (57, ",")) if c in seps]
    f.append(58 if s[0] == "+" else 59 if s[0].isdigit() else 60 if s[0].isalpha() else 61 if s[0] == "(" else 62)
    f.append(63 if s[-1].isdigit() else 64 if s[-1].isalpha() else 65)
    if a and (text[a - 1].isalnum() or text[a - 1] in "_-=\"@+"):
        f.append(66)
    if a and text[a - 1] == ".":
        f.append(67)
    if b < len(text) and (text[b].isalnum() or text[b] in "_-@\""):
        f.append(68)
    if b + 1 < len(text) and text[b] == "." and text[b + 1].isalnum():
        f.append(69)
    if letters and _MORE.match(text, b):
        f.append(80)
    near = re.findall(r"[a-z]+", text[max(0, a - 24) : a].lower())[-2:]
    f += [70 + k for k, words in enumerate(_BESIDE) if any(x in words for x in near)]
    f.append(75 if j == i else 76 if j - i < 4 else 77)
    if n and letters and re.search(r"[0-9][A-Za-z]|[A-Za-z][0-9]", s) and not at:
        f.append(78)
    if at and dot and re.fullmatch(r"[a-z0-9._%+-]+\s?(?:@|[\[({<]\s?at\s?[\])}>]|\bat\b)\s?[a-z0-9-]+(?:\s?(?:\.|[\[({<]\s?dot\s?[\])}>]|\bdot\b)\s?[a-z0-9-]+)+", low):
        f.append(79)
    return f


def segments(text: str, toks: list[tuple[int, int]]):
    """All spans that may be an entity: (first, last) token and facts. An entity has a digit or an address sign, and no line break."""
    marked = [text[a].isdigit() or text[a] == "@" or text[a:b].lower() == "at" for a, b in toks]
    out = []
    for i in range(len(toks)):
        seen = False
        for j in range(i, min(len(toks), i + MAX_LEN)):
            if j > i and (toks[j][0] - toks[j - 1][1] > 1 or "\n" in text[toks[j - 1][1] : toks[j][0]]):
                break
            seen |= marked[j]
            if seen:
                out.append((i, j, facts(text, toks, i, j)))
    return out


def _logsum(x: list[np.ndarray]) -> float:
    v = np.concatenate(x)
    m = v.max()
    return float(m + np.log(np.exp(v - m).sum()))


class SemiCRF:
    """Weights by kind and fact; a token outside entities scores 0."""

    def __init__(self, seed: int = 9, regions: int = 360, epochs: int = 14):
        self.w = np.zeros((len(KINDS), N_FACTS))
        data = [self._prepare(t, gold) for t, gold in labelled_regions(seed, regions)]
        m, v, step = np.zeros_like(self.w), np.zeros_like(self.w), 0
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(data)):
                g = self._gradient(*data[k]) - 0.002 * self.w
                step += 1
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                self.w += 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)

    @staticmethod
    def _prepare(text: str, gold: list[tuple[str, int, int]]):
        toks = [m.span() for m in _TOKEN.finditer(text)]
        segs = segments(text, toks)
        hot = np.zeros((len(segs), N_FACTS))
        for k, (_, _, f) in enumerate(segs):
            hot[k, f] = 1
        want = {(a, b): KINDS.index(kind) for kind, a, b in gold}
        truth = [(k, want[(toks[i][0], toks[j][1])]) for k, (i, j, _) in enumerate(segs) if (toks[i][0], toks[j][1]) in want]
        if len(truth) < len(want):
            raise ValueError(f"not every entity of {text!r} is a segment")
        return len(toks), segs, hot, truth

    def _gradient(self, n: int, segs, hot, truth) -> np.ndarray:
        """Observed minus expected facts."""
        g = np.zeros_like(self.w)
        for k, kind in truth:
            g[kind] += hot[k]
        if not segs:
            return g
        score = hot @ self.w.T
        ends: list[list[int]] = [[] for _ in range(n)]
        starts: list[list[int]] = [[] for _ in range(n)]
        for k, (i, j, _) in enumerate(segs):
            ends[j].append(k)
            starts[i].append(k)
        fore, back = np.zeros(n + 1), np.zeros(n + 1)
        for t in range(n):
            fore[t + 1] = _logsum([fore[t : t + 1], *(score[k] + fore[segs[k][0]] for k in ends[t])])
        for t in range(n - 1, -1, -1):
            back[t] = _logsum([back[t + 1 : t + 2], *(score[k] + back[segs[k][1] + 1] for k in starts[t])])
        at = np.array([(i, j + 1) for i, j, _ in segs])
        p = np.exp(score + (fore[at[:, 0]] + back[at[:, 1]] - fore[n])[:, None])
        return g - p.T @ hot

    def decode(self, text: str) -> list[tuple[str, int, int]]:
        """The best segmentation's entities."""
        toks = [m.span() for m in _TOKEN.finditer(text)]
        ends: dict[int, list] = {}
        for i, j, f in segments(text, toks):
            s = self.w[:, f].sum(1)
            k = int(s.argmax())
            if s[k] > 0:
                ends.setdefault(j, []).append((float(s[k]), i, k))
        best, back = [0.0], []
        for t in range(len(toks)):
            top, how = best[t], None
            for s, i, k in ends.get(t, ()):
                if best[i] + s > top:
                    top, how = best[i] + s, (i, k)
            best.append(top)
            back.append(how)
        out, t = [], len(toks) - 1
        while t >= 0:
            if back[t]:
                i, k = back[t]
                out.append((KINDS[k], toks[i][0], toks[t][1]))
                t = i - 1
            else:
                t -= 1
        return out[::-1]


def labelled_regions(seed: int, n: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated regions with entities in plain and disguised forms, and numbers that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    num = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    syl = ["an", "the", "ter", "ou", "ed", "re", "mo", "la", "ver", "que", "ci", "st"]
    word = lambda: "".join(pick(syl) for _ in range(int(rng.integers(1, 4))))

    def card() -> str:
        d = pick(["4", "51", "37", "6011"])
        d += num((15 if d == "37" else 16) - len(d) - 1)
        return next(d + str(c) for c in range(10) if luhn(d + str(c)))

    def entity(kind: str) -> str:
        if kind == "email":
            name, host = pick([word(), f"{word()}.{num(2)}", f"{word()}.{word()}"]), pick([word(), f"mail{num(1)}"])
            at, dot = pick([("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("@", ".")])
            return f"{name}{at}{host}{dot}{pick(['com', 'org', 'net', 'de', 'example.com', f'example{dot}com'])}"
        if kind == "ip":
            return pick([".", ".", " . ", "[.]"]).join(str(int(x)) for x in rng.integers(1, 255, 4))
        if kind == "card":
            d = card()
            cut = pick([[16], [4, 4, 4, 4], [4, 4, 4, 4]]) if len(d) == 16 else pick([[15], [4, 6, 5]])
            sep, parts, at = pick([" ", "-", "."]), [], 0
            for c in cut:
                parts.append(d[at : at + c])
                at += c
            return sep.join(parts)
        a, b, c = num(3), num(3), num(4)
        return pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+49 {num(3)} {num(7)}", f"+1 {a} {b} {c}", f"({a}) {b} {c}"])

    def other() -> str:
        h = "".join(pick("0123456789abcdef") for _ in range(int(rng.integers(16, 41))))
        return pick([num(int(rng.integers(1, 13))), num(16), f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", f"{num(1)}.{num(1)}.{num(1)}", f"${num(2)}.{num(2)}", f"password={h}", f'token = "{h}"', f"AKIA{h[:16].upper()}", f"page {num(3)}", f"{num(3)}-{num(4)}", f"{num(2)}/{num(2)}/{num(4)}", f"{word()}{num(2)}", f"isbn {num(3)}-{num(1)}-{num(5)}-{num(3)}-{num(1)}", f"{num(1)}.{num(3)}.{num(3)}", f"{word()} at {word()}", f"@{word()}", f"{num(3)} {num(3)}"])

    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(int(rng.integers(1, 4))):
            text += " ".join(word() for _ in range(int(rng.integers(1, 5)))) + pick([" ", " ", ", ", "\n", ": "])
            if rng.random() < 0.55:
                kind = pick(KINDS)
                e = entity(kind)
                gold.append((kind, len(text), len(text) + len(e)))
                text += e
            else:
                text += other()
            text += pick([" ", ". ", ", ", " "])
        out.append((text, gold))
    return out


def regions(text: str, reach: int = 48):
    """Stretches around triggers, widened to white space; far apart ones are separate. A stretch of
    dense triggers is cut only where more than ``reach`` characters hold none."""
    hits = [m.span() for m in _TRIGGER.finditer(text)]
    if " dot " in text.lower() or "dot" in text.lower() and re.search(r"[\[({<] ?dot", text, re.IGNORECASE):
        hits += [m.span() for m in _SPELLED.finditer(text)]
    hits.sort()
    k = 0
    while k < len(hits):
        a, b = hits[k]
        k += 1
        while k < len(hits) and hits[k][0] - b < 2 * reach:
            b = max(b, hits[k][1])
            k += 1
        a = max(0, a - reach)
        while a and not text[a - 1].isspace():
            a -= 1
        b = min(len(text), b + reach)
        while b < len(text) and not text[b].isspace():
            b += 1
        yield a, b


def find(text: str, model: SemiCRF) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each sorted by start, then kind."""
    key = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=key)
    taken: list[list[int]] = []  # disjoint
    for _, a, b in base:
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    more, t = [], 0
    for lo, hi in regions(text):
        for kind, a, b in model.decode(text[lo:hi]):
            a, b = a + lo, b + lo
            if more and a < more[-1][2]:
                continue
            while t < len(taken) and taken[t][1] <= a:
                t += 1
            if t == len(taken) or taken[t][0] >= b:
                more.append((kind, a, b))
    return base, sorted(base + more, key=key)


def detect(docs: DataFrame, model: SemiCRF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__rid, id_col, base and spans as array<struct<kind,start,end>>) for every row."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for pdf in batches:
            got = [find(t, model) for t in pdf["t"]]
            yield pdf[[RID, "i"]].assign(base=[as_rows(b) for b, _ in got], spans=[as_rows(s) for _, s in got])

    span = "array<struct<kind: string, start: long, end: long>>"
    src = with_rid(docs.select(col_of(docs, id_col).cast("string").alias("i"), F.coalesce(col_of(docs, text_col).cast("string"), F.lit("")).alias("t")))
    out = src.mapInPandas(run, f"{RID} long, i string, base {span}, spans {span}")
    return out.select(RID, F.col("i").cast(kind).alias(id_col), "base", "spans")
