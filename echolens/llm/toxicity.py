"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding undoes disguises: case, look-alike letters of other scripts and full-width forms, accents
combined onto letters, digits and signs inside words. Entries are whole words and word stems (the
first 4 to 7 letters), learnt from labelled rows: an entry's weight is the log ratio of its document
rates in toxic and other rows, with the rate in other rows taken high while it rests on few rows.
Exception phrases (a hit word, or the word before it and the word) that only ever occur in rows
labelled clean cancel the hits they cover. A text's mass is the sum over its hit words; score is a
logistic function of the mass, the mass by the square root of the length, and whether anything was
hit.

Everything is learnt from a bounded sample of the labelled rows (``labelled_rows``): labels are chosen
by a hash of their id, broadcast to the texts, and the chosen texts are written once; every pass of the
fit reads only those. No list of entries or exceptions is cut, and every document is scored.

Edge cases: null and empty texts get the score of a text without hits; very long texts are scored
whole; a label that is neither 0 nor 1 is not learnt from, of several labels of an id the larger
counts; without labels of both kinds, or without labelled rows at all, every score is 0; repeated rows
are scored one by one; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, col_of, in_sample, materialise, shuffle_partitions, with_rid

#: Look-alike letters and signs, and the Latin letters they stand for.
LOOKALIKES = {
    "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ѕ": "s", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "в": "b", "к": "k", "м": "m", "н": "h", "т": "t",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ᴏ": "o", "ß": "ss", "​": "", "‌": "", "‍": "", "﻿": "", "­": "",
}
#: Digits and signs inside words.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
_TABLE = str.maketrans(LOOKALIKES | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
_SIGN_TABLE = str.maketrans(SIGNS)
_SIGNED = re.compile(r"[^\W_]*[0134578@$!|][\w@$!|]*[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+")
_COMBINING = re.compile("[̀-ͯ]")


def fold(text: str) -> list[str]:
    """A text's words without disguises."""
    t = text.lower()
    if not t.isascii():
        t = t.translate(_TABLE)
        if _COMBINING.search(t):
            t = _COMBINING.sub("", unicodedata.normalize("NFC", t))
    if _SIGNED.search(t):
        t = _SIGNED.sub(lambda m: m[0].translate(_SIGN_TABLE), t)
    return _WORD.findall(t)


def entries(words: set[str]) -> set[str]:
    """Whole words as " word " and stems as " stem"."""
    out = {f" {w} " for w in words if len(w) > 2}
    for w in words:
        for n in range(4, min(8, len(w))):
            out.add(f" {w[:n]}")
    return out


def automaton(weights: dict[str, float], exceptions: set[str]):
    a = ahocorasick.Automaton()
    for k, v in weights.items():
        a.add_word(k, (k, v))
    for k in exceptions:
        a.add_word(k, (k, weights.get(k, 0.0)))
    if len(a):
        a.make_automaton()
    return a


def hits(words: list[str], auto, exceptions: set[str]) -> dict[int, float]:
    """Place in the joined words -> weight of the strongest entry there, unless an exception covers it."""
    if not len(auto) or not words:
        return {}
    text = " " + " ".join(words) + " "
    found: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (k, v) in auto.iter(text):
        at = end - len(k) + 1
        if k in exceptions:
            spared.append((at, end))
        elif v > found.get(at, 0.0):
            found[at] = v
    for a, b in spared:
        for p in [p for p in found if a <= p < b]:
            del found[p]
    return found


def features(words: list[str], found: dict[int, float]) -> tuple[float, float, float]:
    mass = sum(found.values())
    return min(mass, 60.0) / 10, mass / math.sqrt(len(words) + 1.0), float(bool(found))


class Lexicon:
    """A fitted model: small, and the same on every executor."""

    def __init__(self, weights: dict[str, float], exceptions: set[str], beta: np.ndarray | None):
        self.weights, self.exceptions, self.beta = weights, exceptions, beta
        self._auto = None

    def __getstate__(self):
        return {**self.__dict__, "_auto": None}

    def found(self, words: list[str]) -> dict[int, float]:
        if self._auto is None:
            self._auto = automaton(self.weights, self.exceptions)
        return hits(words, self._auto, self.exceptions)

    def score(self, text: str) -> float:
        words = fold(text)
        if self.beta is None:
            return 0.0
        z = self.beta[0] + float(np.dot(self.beta[1:], features(words, self.found(words))))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Weights by Newton steps; the constant is not shrunk. Features only ever add to the score."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    pen = np.full(len(b), ridge)
    pen[0] = 1e-4
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (p - y) / len(y) + pen * b / len(y)
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(pen) / len(y) + 1e-9 * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b = b - step * min(1.0, 4.0 / (np.abs(step).max() + 1e-9))
        b[1:] = np.maximum(b[1:], 0)
    return b


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of their values; stored, so that passes read it and not its source."""
    kept = rows.withColumn("h", F.xxhash64(*rows.columns)).orderBy("h", *rows.columns).limit(most).drop("h")
    return materialise(kept.repartition(shuffle_partitions(rows.sparkSession)), "training")


def fit(labelled: DataFrame, text_col: str = "t", label_col: str = "y", labelled_rows: int = 20_000, least_ratio: float = 10.0) -> Lexicon:
    """Learn from rows (text, label 0/1), from at most ``labelled_rows`` of them."""
    rows = labelled.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    rows = bounded(rows, labelled_rows)
    total = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    pos, neg = total.get(1, 0), total.get(0, 0)
    if not pos or not neg:
        return Lexicon({}, set(), None)

    def count_entries(wanted: set[str] | None):
        def run(batches):
            for pdf in batches:
                c: Counter = Counter()
                for t in pdf["t"]:
                    e = entries(set(fold(t)))
                    c.update(e if wanted is None else e & wanted)
                yield pd.DataFrame(c.items(), columns=["e", "n"])

        return run

    least = max(3, pos // 400)  # so there are at most 400 times as many as a toxic row has on average, however many rows
    top = rows.where("y = 1").mapInPandas(count_entries(None), "e string, n long").groupBy("e").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    up = {r[0]: r[1] for r in top.collect()}
    seen = rows.where("y = 0").mapInPandas(count_entries(set(up)), "e string, n long").groupBy("e").agg(F.sum("n"))
    down = {r[0]: r[1] for r in seen.collect()}
    weights = {e: math.log((n / (pos + 1)) / ((down.get(e, 0) + 2) / (neg + 2))) for e, n in up.items()}
    weights = {e: w for e, w in weights.items() if w >= math.log(least_ratio)}
    for e in sorted(weights, key=len):  # a longer entry that adds nothing to a shorter one goes
        word = e.rstrip()
        if any(word[:n] in weights and weights[word[:n]] >= weights[e] - 0.2 for n in range(5, len(word) + (e != word))):
            del weights[e]
    model = Lexicon(weights, set(), np.zeros(4))

    def count_phrases(batches):
        for pdf in batches:
            c: Counter = Counter()
            for t, y in zip(pdf["t"], pdf["y"], strict=True):
                words = fold(t)
                found = model.found(words)
                if found:
                    at, phrases = 0, set()
                    for k, w in enumerate(words):
                        if at in found:
                            phrases.add(f" {w} ")
                            if k:
                                phrases.add(f" {words[k - 1]} {w} ")
                        at += len(w) + 1
                    c.update((p, y) for p in phrases)
            yield pd.DataFrame([(p, n * (y == 1), n * (y == 0)) for (p, y), n in c.items()], columns=["p", "bad", "good"])

    phrases = rows.mapInPandas(count_phrases, "p string, bad long, good long").groupBy("p").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("good >= 2 and bad = 0")
    model = Lexicon(weights, {r[0] for r in phrases.collect()}, np.zeros(4))

    def measure(batches):
        for pdf in batches:
            out = []
            for t, y in zip(pdf["t"], pdf["y"], strict=True):
                words = fold(t)
                out.append((*features(words, model.found(words)), y))
            yield pd.DataFrame(out, columns=["a", "b", "c", "y"])

    sample = rows.mapInPandas(measure, "a double, b double, c double, y int").toPandas().sort_values(["a", "b", "c", "y"])
    model.beta = _logistic(sample[["a", "b", "c"]].to_numpy(), sample["y"].to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__rid, id_col, score) for every row."""

    def run(batches):
        for pdf in batches:
            yield pdf[[RID, "i"]].assign(score=[model.score(t) for t in pdf["t"]])

    src = with_rid(docs.select(col_of(docs, id_col).cast("string").alias("i"), F.coalesce(col_of(docs, text_col).cast("string"), F.lit("")).alias("t")))
    kind = docs.schema[id_col].dataType
    return src.mapInPandas(run, f"{RID} long, i string, score double").select(RID, F.col("i").cast(kind).alias(id_col), "score")


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1, labelled_rows: int = 20_000) -> DataFrame:
    """Labelled rows (t, y) outside the held-out fold of crc32(id as text), for about ``labelled_rows``
    labels chosen by their id's hash. At most twice as many labels are broadcast."""
    lab = labels.select(col_of(labels, id_col).cast("string").alias("i"), col_of(labels, label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    lab = lab.where(~held_out("i", folds, held))
    n = lab.agg(F.approx_count_distinct("i", 0.02)).first()[0]
    chosen = lab.where(in_sample("i", labelled_rows, n)).groupBy("i").agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("i"), "i").limit(2 * labelled_rows)
    src = docs.select(col_of(docs, id_col).cast("string").alias("i"), col_of(docs, text_col).cast("string").alias("t"))
    return src.join(F.broadcast(chosen), "i").select("t", "y")


def held_out(col: str, folds: int, held: int):
    return F.coalesce(F.crc32(F.col(col).cast("string")), F.lit(0)) % folds == held


def keep_clean(docs: DataFrame, model: Lexicon, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs that score below the threshold, with all their columns."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t if isinstance(t, str) else "") for t in texts], dtype=float)

    return docs.where(run(col_of(docs, text_col).cast("string")) < threshold)
