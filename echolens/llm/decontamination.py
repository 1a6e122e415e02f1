"""Benchmark decontamination by winnowing, in DataFrame operations only.

Every window of ``window`` words keeps its smallest ``gram``-word hash, so a document and a benchmark
item that share a window share that window's fingerprint: no shared span of that length is missed.
Fingerprints of documents are joined with the benchmark's; only in documents that hit are the
windows behind the hit fingerprints compared word for word, and the document's covered words and
the items are gathered. Items shorter than the window are one window each and are searched by
hashes of their own length, for the lengths that occur.

The benchmark's distinct fingerprints are broadcast only below ``broadcast_rows``; beyond it, the
same join runs as a shuffle join. Windows that several items share are one row that names a list of
items; lists are stored once and meet a document once, however many of its windows name them, so
neither a passage in many documents nor one in many items multiplies rows.

Edge cases: null or empty texts have no words; a null item id takes part in hits but not in the
items; repeated rows and ids are answered row by row; an empty benchmark contaminates nothing, an empty
table gives no rows; texts of any length are read whole; other columns are ignored or, by
``keep_uncontaminated``, kept, whatever their names (but ``__rid``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RID, col_of, materialise, stored, with_rid

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """A-Z lower-cased; runs of ASCII letters, digits and all non-ASCII characters."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), NO_WORD), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row: a plain column would be copied into the body's
    lambdas and computed again for every element."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def _places(words: Column, length: int) -> Column:
    """1-based starts of spans of this length; empty if there are none."""
    n = F.size(words)
    return F.when(n >= length, F.sequence(F.lit(1), n - (length - 1))).otherwise(F.array().cast("array<int>"))


def _grams(words: Column, length: int) -> Column:
    return F.transform(_places(words, length), lambda i: F.xxhash64(F.slice(words, i, length)))


def window_marks(words: Column, window: int, gram: int) -> Column:
    """For each window of words, in order, its smallest gram hash."""
    per = window - gram + 1
    return let(_grams(words, gram), lambda g: F.transform(_places(g, per), lambda i: F.array_min(F.slice(g, i, per))))


def _hit_windows(words: Column, window: int, gram: int) -> Column:
    """(at, key) of the windows whose mark is in the column ``marks``."""
    return let(
        window_marks(words, window, gram),
        lambda m: F.transform(F.filter(_places(m, 1), lambda i: F.array_contains("marks", m[i - 1])), lambda i: F.struct(i.alias("at"), F.slice(words, i, window).alias("key"))),
    )


def _hit_grams(words: Column, length: int) -> Column:
    return F.transform(
        F.filter(_places(words, length), lambda i: F.array_contains("marks", F.xxhash64(F.slice(words, i, length)))),
        lambda i: F.struct(i.alias("at"), F.slice(words, i, length).alias("key")),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, gram: int = 7, share: int = 20, broadcast_rows: int = 2_000_000) -> DataFrame:
    """(__rid, id_col, n_words, n_hit, n_items, items array<string>, contaminated, passage) per document.
    contaminated: n_hit > 0 and share * n_hit >= n_words; passage: a window of full length occurs."""
    docs = stored(docs)
    items = benchmark.select(col_of(benchmark, item_col).cast("string").alias("item"), words_of(col_of(benchmark, item_text)).alias("w")).where("size(w) > 0")
    cut = F.when(F.size("w") < window, F.array("w")).otherwise(F.transform(_places(F.col("w"), window), lambda i: F.slice("w", i, window)))
    spans = items.select("item", F.explode(cut).alias("key")).groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    mark = F.when(F.size("key") >= window, let(F.col("key"), lambda k: F.array_min(window_marks(k, window, gram)))).otherwise(F.xxhash64("key"))
    spans = materialise(spans.select("key", F.size("key").alias("n"), "items", F.md5(F.to_json("items")).alias("list"), mark.alias("mark")), "spans")
    lists = spans.groupBy("list").agg(F.first("items").alias("of"))
    marks = spans.select("mark").distinct()
    if marks.count() <= broadcast_rows:
        marks = F.broadcast(marks)
    lengths = [r[0] for r in spans.where(F.col("n") < window).select("n").distinct().collect()]  # fewer than window values

    src = with_rid(docs.select(col_of(docs, id_col).alias("i"), col_of(docs, text_col).alias("t")))
    words = words_of(F.col("t"))
    tried = let(words, lambda w: F.array_distinct(F.concat(window_marks(w, window, gram), *[_grams(w, k) for k in lengths])))
    hit = src.select(RID, F.explode(tried).alias("mark")).join(marks, "mark", "left_semi")
    hit = materialise(hit.groupBy(RID).agg(F.collect_set("mark").alias("marks")), "hits")

    at = let(words, lambda w: F.concat(_hit_windows(w, window, gram), *[_hit_grams(w, k) for k in lengths]))
    places = src.join(hit, RID).select(RID, F.explode(at).alias("s")).select(RID, "s.at", "s.key")
    match = places.join(spans.select("key", "n", "list"), "key")
    per_doc = materialise(
        match.groupBy(RID).agg(
            F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("stop")))).alias("runs"),
            F.collect_set("list").alias("lists"),
            (F.max("n") >= window).alias("passage"),
        ),
        "matches",
    )
    named = per_doc.select(RID, F.explode("lists").alias("list")).join(lists, "list").select(RID, F.explode("of").alias("item"))
    named = named.groupBy(RID).agg(F.sort_array(F.collect_set("item")).alias("items"))
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("upto"))
    merged = F.aggregate(
        "runs",
        start,
        lambda acc, r: F.struct(
            (acc["hit"] + F.greatest(F.lit(0), r["stop"] - F.greatest(acc["upto"], r["at"]))).alias("hit"),
            F.greatest(acc["upto"], r["stop"]).alias("upto"),
        ),
    )
    covered = per_doc.select(RID, merged["hit"].alias("hit"), "passage").join(named, RID, "left")
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    n_words = F.col("n").cast("long")
    return src.select(RID, "i", F.size(words).alias("n")).join(covered, RID, "left").select(
        RID,
        F.col("i").alias(id_col),
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * share >= n_words)).alias("contaminated"),
        F.coalesce("passage", F.lit(False)).alias("passage"),
    )


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs with all their columns, without those that are contaminated or hold a passage of a benchmark
    item of the full window's length, however small a share of their words it is. A hit by an item of
    fewer words, which ordinary text can hold by chance, only counts by its share."""
    docs = stored(docs)
    bad = contamination(docs, benchmark, **options).where("contaminated or passage").select(RID)
    return with_rid(docs).join(bad, RID, "left_anti").drop(RID)
