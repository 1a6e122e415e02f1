"""Near duplicates by a grouped prefix join on word shingles.

1. Every block of documents sends its distinct shingles with counts to the owners of their ranges
   (``common.exchange``) and gets back in how many documents of the corpus each occurs. This fixes
   one global order of shingles, rare first.
2. A document's shingles that occur nowhere else cannot be in an intersection; they only take places
   at the front of its prefix. Where they fill the prefix, the document has no partner. The others
   keep their shared shingles, in the global order.
3. Documents with the same set become one class; classes with the same prefix and size become one
   group. A group's prefix, size and positions are its members', so it stands for them wherever
   candidates are sought: groups meet on prefix shingles under the size and position bounds, and only
   pairs of groups that pass are expanded to members and verified.
4. Members are first compared with their group's leader, and each group with a few of its shingles'
   leaders. A shingle's leader (by size class) is a group with few shingles of its own, that is, near
   the middle of its cluster, so that large clusters connect after a linear number of comparisons. The
   components found are contracted and this is done again with other leaders (``rounds``); a group is
   then split by component. A last round takes all pairs of these units that still are in different
   components and pass the bounds. Every pair of documents that could link is thus verified or already
   connected; nothing is capped.
5. Verification intersects the shared shingles of both documents.

Shingles are counted by the top 48 bits of their hashes. Two that agree there may look shared though
each occurs once; that only lengthens a prefix. Sets are intersected by all 64 bits.

Results: one row per input row with its set size and the smallest id reachable by links.

Edge cases: null or empty text, or white space alone, has an empty set and no link; fewer words
than a shingle form one shingle; very long texts count whole; repeated rows are in one class; ids are
integers, a null id counts as larger than any other and is returned as null where no other id is
reachable; an empty table gives no rows; other columns are ignored or, by ``keep_one``, kept, whatever
their names (but ``__rid``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, RID, answers, components, cuts, dump, exchange, join48, load, materialise, mix64, n_blocks, narrow, restore_id, runs, split48, stored, to_blocks, with_rid

_M = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space, A-Z lower-cased."""
    words = text.encode().lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; fewer words are one shingle."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(size, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = h * _M + w[j : j + n]
    return np.unique(mix64(h))


def _block_sets(pdf: pd.DataFrame, size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """A block's sets in row order; its distinct shingles, where each entry is among them, counts."""
    sets = [shingle_set(t, size) for t in pdf["text"]]
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    keys, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    return sets, keys, inverse, counts


def _needed(n, num: int, den: int):
    """Least overlap with any partner: ceil(threshold * n)."""
    return -(-n * num // den)


def shared_sets(blocks: DataFrame, buckets: int, size: int, num: int, den: int) -> DataFrame:
    """A row per document: its set size n, how many of its shingles occur nowhere else (alone), a
    digest of the set, and the shared shingles in global order, rare first, unless no partner is possible."""

    def emit(pdf: pd.DataFrame):
        _, keys, _, counts = _block_sets(pdf.sort_values(RID), size)
        at = cuts(keys, buckets)
        for b in range(buckets):
            if at[b] < at[b + 1]:
                part = slice(at[b], at[b + 1])
                yield 0, b, dump(*split48(keys[part]), narrow(counts[part]))

    def merge(_: int, data: list[tuple]) -> list[bytes]:
        group, n, at = runs([join48(hi, lo) for hi, lo, _ in data])
        total = np.bincount(group, weights=np.concatenate([c for _, _, c in data]), minlength=n).astype(np.int64)[group]
        return [dump(np.packbits((d := total[a:b]) > 1), b - a, narrow(d[d > 1])) for a, b in zip(at[:-1], at[1:], strict=True)]

    def apply(docs: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values(RID)
        sets, keys, inverse, _ = _block_sets(docs, size)
        df = np.ones(len(keys), np.int64)
        at = 0
        for bits, n, counts in answers(got).get(0, []):
            shared = np.unpackbits(bits, count=n).astype(bool)
            df[at : at + n][shared] = counts
            at += n
        rows, lo = [], 0
        every = df[inverse]
        for rid, i, s in zip(docs[RID].to_numpy(), docs["id"].to_numpy(), sets, strict=True):
            d = every[lo : lo + len(s)]
            lo += len(s)
            alone = int((d < 2).sum())
            keep = len(s) > 0 and len(s) - alone >= _needed(len(s), num, den)
            toks = sig = None
            if keep:
                sig = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                both = d > 1
                toks = s[both][np.lexsort((s[both], d[both]))].tobytes()
            rows.append((rid, i, len(s), alone, sig, toks))
        return pd.DataFrame(rows, columns=[RID, "id", "n", "alone", "sig", "toks"])

    answered = exchange(blocks, emit, merge)
    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(apply, f"{RID} long, id long, n long, alone long, sig binary, toks binary")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose Jaccard similarity reaches num/den."""

    def check(batches):
        for pdf in batches:
            ok = []
            for x, y, n, m in zip(pdf["x"], pdf["y"], pdf["n"], pdf["m"], strict=True):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                ok.append(den * both >= num * (n + m - both))
            yield pdf.loc[ok, ["a", "b"]]

    left = sets.select(F.col("node").alias("a"), F.col("toks").alias("x"), "n")
    right = sets.select(F.col("node").alias("b"), F.col("toks").alias("y"), F.col("n").alias("m"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "n", "m").mapInPandas(check, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100, leaders: int = 3, rounds: int = 2) -> DataFrame:
    """(__rid, id_col, n_shingles, component_id, component_rid): near-duplicate classes at Jaccard >=
    num/den. component_rid names the component by a row number, whatever the ids."""
    docs = stored(docs)
    blocks = to_blocks(docs, id_col, text_col, n_blocks(docs, 2))
    every = materialise(shared_sets(blocks, n_blocks(docs, 4), shingle, num, den), "sets")
    classes = every.where("toks is not null").groupBy("sig").agg(F.min(RID).alias("node"), F.min("id").alias("low"))
    classes = materialise(classes, "classes")

    def prefixes(batches):
        """Nodes with the shared part of their prefixes, and their groups' keys."""
        for pdf in batches:
            rows = []
            for node, n, alone, toks in zip(pdf["node"], pdf["n"], pdf["alone"], pdf["toks"], strict=True):
                front = toks[: 8 * max(0, n - int(_needed(n, num, den)) + 1 - alone)]
                if front:
                    rows.append((node, n, alone, hashlib.blake2b(front + bytes(f"{n}:{alone}", "ascii"), digest_size=16).digest(), np.frombuffer(front, np.int64)))
            yield pd.DataFrame(rows, columns=["node", "n", "alone", "grp", "front"])

    sets = every.join(classes.select("node", F.col("node").alias(RID)), RID).select("node", "n", "alone", "toks")
    sets = materialise(sets, "nodes")
    front = materialise(sets.mapInPandas(prefixes, "node long, n long, alone long, grp binary, front array<long>"), "prefixes")
    groups = front.groupBy("grp").agg(F.min("node").alias("leader"))
    within = front.join(groups, "grp").where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))

    def members(found: DataFrame | None) -> DataFrame:
        """Every node with its component and its unit: the smallest node of its group in its component."""
        nodes = front.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node")) if found is not None else front.join(groups, "grp").withColumn("comp", F.col("leader")).drop("leader")
        return nodes.join(nodes.groupBy("grp", "comp").agg(F.min("node").alias("unit"), F.count("*").alias("size")), ["grp", "comp"])

    def spread(nodes: DataFrame) -> DataFrame:
        """A row for each unit and shared prefix shingle, with its place in the unit's order."""
        units = nodes.where("node = unit").select("unit", "size", "comp", "n", "alone", F.posexplode("front").alias("p", "tok"))
        return units.select("tok", "unit", "size", "comp", "n", "alone", (F.col("p") + F.col("alone")).alias("pos"), F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).alias("cls"))

    def bound(n1, p1, n2, p2):
        """Can two sets reach the threshold if their first common shingle is at these places?"""
        big, small = F.greatest(n1, n2), F.least(n1, n2)
        most = F.least(n1 - p1, n2 - p2)
        return (small * den >= big * num) & (most * (num + den) >= (n1 + n2) * num)

    def starred(rows: DataFrame, seed: int) -> DataFrame:
        """Of each shingle and size class one leader; (a, b) of each unit with the first few of its
        shingles' leaders that are in another component and within the bounds."""
        centre = F.struct(F.floor(F.log2(F.col("alone") + 1.0)).alias("own"), F.hash("unit", F.lit(seed)).alias("h"), "unit", "n", "pos", "comp")
        lead = rows.groupBy("tok", "cls").agg(F.min(centre).alias("l"))
        lead = lead.select("tok", "cls", "l.h", F.col("l.unit").alias("b"), F.col("l.n").alias("m"), F.col("l.pos").alias("q"), F.col("l.comp").alias("comp2"))
        met = rows.join(lead, ["tok", "cls"]).where("comp <> comp2").where(bound(F.col("n"), F.col("pos"), F.col("m"), F.col("q")))
        near = met.groupBy("unit").agg(F.slice(F.sort_array(F.collect_set(F.struct("h", "b"))), 1, leaders).alias("l"))
        return near.select(F.col("unit").alias("a"), F.explode("l").alias("l")).select("a", F.col("l.b").alias("b"))

    def opened(nodes: DataFrame) -> DataFrame:
        """Prefix shingles that stand in several components, with each unit's."""
        tagged = spread(nodes)
        several = tagged.groupBy("tok").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("tok")
        return materialise(tagged.join(several, "tok"), "open")

    ordered = lambda p: p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    compared = materialise(ordered(starred(spread(members(None)), 0).union(within)), "star")
    links = materialise(_verified(compared, sets, num, den), "links")
    found = components(links)
    for seed in range(1, rounds):
        more = materialise(ordered(starred(opened(members(found)), seed)).join(compared, ["a", "b"], "left_anti"), "star")
        if more.isEmpty():
            continue
        compared = compared.union(more)
        links = materialise(links.union(_verified(more, sets, num, den)), "links")
        found = components(links)

    # what is left: pairs of units with a common prefix shingle in different components. A shingle's
    # largest component is never paired with itself.
    nodes = materialise(members(found).select("node", "unit", "size", "comp", "n", "alone", "front"), "members")
    tagged = opened(nodes)
    sizes = tagged.groupBy("tok", "comp").agg(F.count("*").alias("k"))
    major = sizes.groupBy("tok").agg(F.max_by("comp", F.struct("k", "comp")).alias("major"))
    unit = tagged.join(major, "tok")
    minor = unit.where("comp <> major").select("tok", F.col("unit").alias("unit2"), F.col("n").alias("m"), F.col("pos").alias("q"), F.col("comp").alias("comp2"))
    both = unit.join(minor, "tok").where("comp <> comp2").where(bound(F.col("n"), F.col("pos"), F.col("m"), F.col("q")))
    both = both.select(F.least("unit", "unit2").alias("u"), F.greatest("unit", "unit2").alias("v")).distinct()
    of = nodes.select("unit", "node")
    rest = both.join(of.toDF("u", "x"), "u").join(of.toDF("v", "y"), "v").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).join(compared, ["a", "b"], "left_anti")
    more = materialise(_verified(rest, sets, num, den), "links")
    if not more.isEmpty():
        found = components(links.union(more))

    reach = classes.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    low = reach.groupBy("comp").agg(F.min("low").alias("least"))
    of_class = reach.select("sig", "comp").join(low, "comp").select("sig", "least", "comp")
    least = F.coalesce("least", "id")
    out = every.select(RID, "id", "n", "sig").join(of_class, "sig", "left")
    return out.select(RID, restore_id("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(least != NULL_ID, least).alias("component_id"), F.coalesce("comp", RID).alias("component_rid"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but the smallest id (then row) of each near-duplicate component."""
    docs = stored(docs)
    rows = jaccard_components(docs, id_col, text_col)
    first = rows.groupBy("component_rid").agg(F.min(F.struct(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("i"), RID)).alias("m")).select(F.col(f"m.{RID}").alias(RID))
    return with_rid(docs).join(first, RID, "left_semi").drop(RID)
