"""Secret scans: pattern candidates, then a random forest that removes false positives.

Candidates are private-key blocks from first to last line, runs that could be a key (16 or more key
characters with a digit and a letter) and values assigned to a secret-like name; all whole, however long. The forest sees each candidate's length and alphabet, its
character transitions under a bigram model of ordinary words, the share of it that dictionary words
cover, whether it is part of a path or address, and the words beside it.

Labelled findings: the tables have none, so ``labelled_findings`` makes them by rule from a fixed
seed - keys of the common forms in secret-like contexts, and the look-alikes that scanners report by
mistake (digests of files and commits, UUIDs, placeholders, paths, long words, numbers) in theirs -
with neighbouring words from the dictionary: the ``dictionary_words`` most frequent words of all texts,
as an ordinary word is a frequent one.

Edge cases: null and empty texts have no candidates; very long texts are scanned whole; repeated
rows are scanned one by one; spans are in code points, end exclusive, sorted and disjoint; an empty
table gives no rows, and a dictionary without words; ids are of any type; other columns are ignored or,
by ``redact``, kept, whatever their names (but ``__rid``).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, col_of, with_rid

NAMES = r"password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer"
_NAME = rf"(?:{NAMES})[a-z_]{{0,12}}"
#: Either a value given to a secret-like name, or a run of key characters; both whole, however long.
#: A run is tried once, where its key characters begin, so that the search is linear.
CANDIDATE = re.compile(
    rf"(?P<name>{_NAME})[\"']?[ \t]*(?::=|=>|[:=])[ \t]*(?P<q>[\"']?)(?P<value>[^\s\"',;]{{6,}})|(?<![A-Za-z0-9_\-/+.])[_\-/+.]*+(?P<run>(?=[A-Za-z_\-/+.]*+[0-9])[A-Za-z0-9][A-Za-z0-9_\-/+.]{{14,}}[A-Za-z0-9]={{0,2}})",
    re.IGNORECASE,
)
#: A private key's block; its ends are found by search, so that no pattern runs over what is between.
_OPENS = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_CLOSES = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
_LAST_NAME = re.compile(rf"{_NAME}=*\Z", re.IGNORECASE)
#: Nothing can match in a text without one of these.
MAYBE = re.compile(r"(?::=|=>|[:=])[ \t]*[\"']?[^\s\"',;]{6}|[A-Za-z0-9_\-/+.]{15}[A-Za-z0-9]", re.IGNORECASE)
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "login", "private")
HARMLESS_WORDS = ("sha", "md5", "digest", "checksum", "commit", "uuid", "guid", "example", "sample", "placeholder", "test", "hash", "revision", "version", "isbn", "doi", "id")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "xox", "sk_live_", "sk_test_", "AIza", "glpat-", "eyJ", "SG.")
FIELDS = 24


class Dictionary:
    """Ordinary words: a set for coverage and log bigram rates for transitions."""

    def __init__(self, words: list[str]):
        self.words = {w for w in words if 4 <= len(w) <= 12}
        rate = np.full((128, 128), 0.5)
        for w in words:
            b = b" " + w.encode("ascii", "ignore").lower() + b" "
            for x, y in zip(b, b[1:], strict=False):
                rate[x, y] += 1
        self.log = np.log(rate / rate.sum(1, keepdims=True))

    def transitions(self, s: str) -> float:
        b = s.lower().encode("ascii", "replace")
        return sum(self.log[x, y] for x, y in zip(b, b[1:], strict=False)) / max(1, len(b) - 1)

    def coverage(self, s: str) -> float:
        t, i, got = s.lower(), 0, 0
        while i < len(t):
            n = next((n for n in range(min(12, len(t) - i), 3, -1) if t[i : i + n] in self.words), 0)
            got += n
            i += n or 1
        return got / max(1, len(t))


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def describe(value: str, before: str, after: str, named: bool, words: Dictionary) -> list[float]:
    """The forest's view of a candidate and about 40 characters on each side of it."""
    n = len(value)
    digits = sum(c.isdigit() for c in value)
    upper = sum("A" <= c <= "Z" for c in value)
    lower = sum("a" <= c <= "z" for c in value)
    b, a = before.lower(), after.lower()
    near = re.findall(r"[a-z0-9]+", b)[-4:]
    switches = sum(x.isdigit() != y.isdigit() or x.isupper() != y.isupper() for x, y in zip(value, value[1:], strict=False))
    return [
        n, digits / n, upper / n, lower / n, (n - digits - upper - lower) / n, entropy(value), switches / n, len(set(value)) / n,
        words.transitions(value), words.coverage(value), float(named), float(value.startswith(PREFIXES)),
        float(re.fullmatch(r"[0-9a-fA-F]+", value) is not None), float(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value) is not None),
        float(b.endswith(("/", "\\", ".", "@", "#"))), value.count("/"), value.count("."), value.count("-"), float("://" in b[-12:] or "://" in value or "www." in value),
        float(any(w in x for w in SECRET_WORDS for x in near)), float(any(x.startswith(HARMLESS_WORDS) for x in near)), float(b.rstrip().endswith(("=", ":"))), float(bool(before) and before[-1] in "\"'" and bool(after) and after[0] in "\"'"), float(bool(a) and a[0].isalnum()),
    ]


def blocks(text: str) -> list[tuple[int, int]]:
    """Private-key blocks: from the last opening line before a closing line to that line's end."""
    opens = [m.start() for m in _OPENS.finditer(text)] if "-----BEGIN " in text else []
    out, k = [], 0
    for m in _CLOSES.finditer(text) if opens else ():
        j = bisect_left(opens, m.start(), k)
        if j > k:
            out.append((opens[j - 1], m.end()))
            k = j
    return out


def candidates(text: str):
    """(start, end, has a secret-like name) of every candidate, in order."""
    at = 0
    for a, b in blocks(text):
        yield from _between(text, at, a)
        yield a, b, True
        at = b
    yield from _between(text, at, len(text))


def _between(text: str, at: int, stop: int):
    """Candidates between two places, where no block is."""
    at = at if MAYBE.search(text, at, stop) else stop
    while m := CANDIDATE.search(text, at, stop):
        at = m.end()
        if m["value"] is None:
            start, end, value = m.start("run"), m.end("run"), None
            if name := _LAST_NAME.search(text, max(start, end - 40), end):  # a run that ends in a name has its value too
                value = CANDIDATE.match(text, name.start(), stop)
                if value and value["value"] is not None:
                    end, at = min(end, value.start("value")), value.end()
                else:
                    value = None
            run = text[start:end]
            if any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
                yield start, end, False
            m = value
        if m is not None:
            yield m.start("value"), m.start("value") + len(m["value"].rstrip(".")), True


def labelled_findings(words: Dictionary, n: int = 2400, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Findings made by rule: features and labels."""
    rng = np.random.default_rng(seed)
    some = sorted(words.words) or ["some", "words", "here"]
    pick = lambda x: x[int(rng.integers(len(x)))]
    run = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    hexa, up, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    text = lambda k: " ".join(pick(some) for _ in range(k))
    name = lambda: pick(["password", "passwd", "secret", "token", "api_key", "access_key", "auth_token", "client_secret", "TOKEN", "Password"])
    x, y = [], []
    for i in range(n):
        yes, named = i % 2 == 0, False
        before, after = text(3) + " ", " " + text(3)
        if yes:
            kind = i // 2 % 7
            if kind < 3:
                value = (run(hexa, pick([16, 18, 20, 24, 32, 40, 64])), run(alnum, pick([10, 12, 16, 20, 24, 32, 40])), run(alnum + "!#%*", pick([8, 10, 12])))[kind]
                sep = pick(["=", " = ", ": ", ":"])
                quote = pick(["", '"', "'"])
                before, after, named = before + name() + sep + quote, quote + after, True
            elif kind == 3:
                value = pick(["AKIA", "ASIA"]) + run(up, 16)
            elif kind == 4:
                value = pick(["ghp_", "gho_", "sk_live_", "glpat-", "AIza", "xoxb-"]) + run(alnum, pick([24, 32, 36]))
            elif kind == 5:
                body = "\n".join(run(alnum + "+/", 64) for _ in range(int(rng.integers(1, 30))))
                form, named = pick(["RSA ", "EC ", "OPENSSH ", "ENCRYPTED ", ""]), True
                value = f"-----BEGIN {form}PRIVATE KEY-----\n{body}\n-----END {form}PRIVATE KEY-----"
            else:
                value = "eyJ" + run(alnum, 30) + "." + run(alnum, 40) + "." + run(alnum, 30)
        else:
            kind = i // 2 % 10
            if kind == 0:
                value, before = run(hexa, pick([32, 40, 64])), before + pick(["sha256 ", "md5: ", "commit ", "checksum ", "revision ", "digest "])
            elif kind == 1:
                h = run(hexa, 32)
                value, before = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", before + pick(["", "id ", "uuid "])
            elif kind == 2:
                value, named = pick(["changeme", "your_password", "xxxxxxxxxx", "********", "<password>", "example123", "placeholder", "${TOKEN}", "none_here", "required", "password"]), True
                before += name() + pick(["=", ": ", " = "])
            elif kind == 3:
                value, before = "/".join(pick(some) for _ in range(4)) + str(rng.integers(100)), before + pick(["", "https://", "/", "./"])
            elif kind == 4:
                value = "".join(pick(some) for _ in range(3)) + str(rng.integers(100))
            elif kind == 5:
                value, before = run("0123456789", 12) + pick(["x", "abc", "e5"]) + run("0123456789", 3), before + pick(["isbn ", "version ", "", "no. "])
            elif kind == 6:
                value, named = pick(some) + pick(some), True
                before += name() + pick([": ", "="])
            elif kind == 7:
                value = "-".join(pick(some) for _ in range(4)) + "-" + str(rng.integers(2000))
            elif kind == 8:
                value, before = f"{pick(some)}.{pick(some)}{rng.integers(9)}.{pick(some)}.com", before + pick(["www.", "", "https://"])
            else:
                value = f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}T{rng.integers(24):02d}.{rng.integers(60):02d}.00Z"
        x.append(describe(value, before[-40:], after[:40], named, words))
        y.append(int(yes))
    return np.array(x), np.array(y)


class Forest:
    """Random forest of depth-bounded Gini trees, stored as arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.depth = depth
        self.feature = np.full((trees, 2 ** (depth + 1)), -1, np.int16)
        self.cut = np.zeros((trees, 2 ** (depth + 1)))
        self.value = np.zeros((trees, 2 ** (depth + 1)))
        for t in range(trees):
            rows = rng.integers(0, len(x), len(x))
            self._grow(t, 1, x[rows], y[rows], depth, rng)

    def _grow(self, t: int, node: int, x: np.ndarray, y: np.ndarray, depth: int, rng) -> None:
        self.value[t, node] = (y.sum() + 0.5) / (len(y) + 1)
        if not depth or len(y) < 6 or y.min() == y.max():
            return
        best = (1e-9, -1, 0.0)
        base = y.mean() * (1 - y.mean())
        for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1])) + 1), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(y[order])
            k = np.flatnonzero(v[1:] > v[:-1]) + 1
            if len(k):
                p, q = c[k - 1] / k, (c[-1] - c[k - 1]) / (len(y) - k)
                gain = base - (k * p * (1 - p) + (len(y) - k) * q * (1 - q)) / len(y)
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (gain[j], int(f), float(v[k[j]] + v[k[j] - 1]) / 2)
        if best[1] < 0:
            return
        self.feature[t, node], self.cut[t, node] = best[1], best[2]
        left = x[:, best[1]] <= best[2]
        self._grow(t, 2 * node, x[left], y[left], depth - 1, rng)
        self._grow(t, 2 * node + 1, x[~left], y[~left], depth - 1, rng)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t in range(len(self.feature)):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, node]
                down = f >= 0
                go = x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[t, node]
                node = np.where(down, 2 * node + go, node)
            out += self.value[t, node]
        return out / len(self.feature)


class Scanner:
    """The fitted dictionary and forest."""

    def __init__(self, words: list[str], threshold: float = 0.5):
        self.words = Dictionary(words)
        self.forest = Forest(*labelled_findings(self.words))
        self.threshold = threshold

    def scan(self, texts: list[str]) -> list[tuple[int, list[tuple[int, int, float]]]]:
        """Per text: number of candidates and the kept findings (start, end, probability)."""
        x, of, spans = [], [], []
        counts = [0] * len(texts)
        for k, t in enumerate(texts):
            for a, b, named in candidates(t):
                counts[k] += 1
                x.append(describe(t[a:b], t[max(0, a - 40) : a], t[b : b + 40], named, self.words))
                of.append(k)
                spans.append((a, b))
        out: list[tuple[int, list]] = [(c, []) for c in counts]
        if x:
            for k, (a, b), p in zip(of, spans, self.forest.predict(np.array(x)), strict=True):
                if p >= self.threshold:
                    out[k][1].append((a, b, float(p)))
        return out


def word_counts(docs: DataFrame, text_col: str = "text", limit: int = 200_000) -> DataFrame:
    """(w, n): how often each word occurs in all texts. A task hands on its counts at ``limit`` words."""

    def run(batches):
        n: Counter = Counter()
        for pdf in batches:
            for t in map(str.lower, pdf["t"]):
                n.update(re.findall("[a-z]+", t) if len(t) < 1 << 20 else (m[0] for m in re.finditer("[a-z]+", t)))
                if len(n) > limit:
                    yield pd.DataFrame({"w": list(n), "n": list(n.values())})
                    n.clear()
        if n:
            yield pd.DataFrame({"w": list(n), "n": list(n.values())})

    rows = docs.select(col_of(docs, text_col).cast("string").alias("t")).where("t is not null")
    return rows.mapInPandas(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_col: str = "text", dictionary_words: int = 20_000) -> Scanner:
    """A scanner whose dictionary is the most frequent words of all texts."""
    return Scanner([r.w for r in word_counts(docs, text_col).orderBy(F.desc("n"), "w").limit(dictionary_words).collect()])


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__rid, id_col, n_candidates, findings array<struct<start,end,p>>) for every row."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for pdf in batches:
            got = scanner.scan(pdf["t"].tolist())
            yield pdf[[RID, "i"]].assign(n_candidates=[n for n, _ in got], findings=[[{"start": a, "end": b, "p": p} for a, b, p in f] for _, f in got])

    src = with_rid(docs.select(col_of(docs, id_col).cast("string").alias("i"), F.coalesce(col_of(docs, text_col).cast("string"), F.lit("")).alias("t")))
    out = src.mapInPandas(run, f"{RID} long, i string, n_candidates long, findings array<struct<start: long, end: long, p: double>>")
    return out.select(RID, F.col("i").cast(kind).alias(id_col), "n_candidates", "findings")


def redact(docs: DataFrame, scanner: Scanner, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every finding in the text replaced by a mask; null texts stay null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        given = [t if isinstance(t, str) else None for t in texts]
        out = []
        for t, (_, found) in zip(given, scanner.scan([t or "" for t in given]), strict=True):
            for a, b, _ in reversed(found):
                t = t[:a] + mask + t[b:]
            out.append(t)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, run(col_of(docs, text_col).cast("string")))
