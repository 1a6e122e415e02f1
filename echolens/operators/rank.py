"""Ranking, de-duplication, counts and scores of matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY = ("critical", "high", "medium", "low")


def severity_rank(c: str = "severity") -> Column:
    out = F.lit(len(SEVERITY))
    for k, s in reversed(list(enumerate(SEVERITY))):
        out = F.when(F.col(c) == s, k).otherwise(out)
    return out


def best_per_pair(matches: DataFrame) -> DataFrame:
    """The most similar match of each unordered pair; self-pairs go."""
    w = Window.partitionBy(F.least("id1", "id2"), F.greatest("id1", "id2")).orderBy(F.desc("similarity"), "match_type")
    return matches.where("id1 <> id2").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def best_per_type(matches: DataFrame) -> DataFrame:
    """One match per unordered pair and type, by severity, confidence, similarity."""
    w = Window.partitionBy(F.least("id1", "id2"), F.greatest("id1", "id2"), "match_type").orderBy(severity_rank(), F.desc("confidence"), F.desc("similarity"))
    return matches.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def appearances(matches: DataFrame) -> DataFrame:
    return matches.select(F.explode(F.array("id1", "id2")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))


def shares(matches: DataFrame, col: str) -> DataFrame:
    n = matches.groupBy(col).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(a / b, 4)).otherwise(F.lit(0.0))


def precision_recall(predicted: DataFrame, truth: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """(tp, fp, fn, prec, recall, f1) of pairs; predictions to ignore count for nothing."""
    if ignored is not None:
        predicted = predicted.join(ignored, ["id1", "id2"], "left_anti")
    both = predicted.select("id1", "id2", F.lit(1).alias("p")).join(truth.select("id1", "id2", F.lit(1).alias("t")), ["id1", "id2"], "full")
    n = both.agg(F.count_if((F.col("p") == 1) & (F.col("t") == 1)).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    return scores(n)


def scores(counts: DataFrame) -> DataFrame:
    """tp, fp, fn with precision, recall and F1; nothing over nothing is 0."""
    tp, p, r = F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    return counts.select("tp", "fp", "fn", ratio(tp, p).alias("prec"), ratio(tp, r).alias("recall"), ratio(2 * tp, p + r).alias("f1"))


def region_scores(true: DataFrame, found: DataFrame, group: str, least: float = 0.5) -> DataFrame:
    """(tp, fp, fn, mean_iou, median_error) of found boxes (group, id, bx, by, bw, bh) against one true
    box a group (group, ax, ay, aw, ah)."""
    from ..functions.tiles import iou

    j = true.join(found, group, "left").withColumn("iou", iou(tuple(F.col(f"a{c}") for c in "xywh"), tuple(F.col(f"b{c}") for c in "xywh")))
    middle = lambda s: (F.col(f"{s}x") + F.col(f"{s}w") / 2, F.col(f"{s}y") + F.col(f"{s}h") / 2)
    (ax, ay), (bx, by) = middle("a"), middle("b")
    j = j.withColumn("err", F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)))
    best = j.groupBy(group).agg(F.count("id").alias("n"), F.max(F.when(F.col("iou") >= least, F.struct("iou", (-F.col("id")).alias("k"), "err"))).alias("b"))
    hit = F.col("b").isNotNull()
    return best.agg(F.count_if(hit).alias("tp"), (F.sum("n") - F.count_if(hit)).alias("fp"), F.count_if(~hit).alias("fn"), F.round(F.avg("b.iou"), 4).alias("mean_iou"), F.round(F.median("b.err"), 4).alias("median_error"))


def nms(boxes: DataFrame, group: str, limit: float = 0.4) -> DataFrame:
    """Greedy non-maximum suppression of box pairs within a group (a figure's findings), best score first."""
    import pandas as pd

    def over(a, b) -> float:
        w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
        h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        if w <= 0 or h <= 0:
            return 0.0
        return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)

    cols = boxes.columns

    def keep(rows: list) -> list:
        pairs, out = [], []
        for r in sorted(rows, key=lambda r: (-r.score, -r.inliers, r.id)):
            a, b = (r.ax, r.ay, r.aw, r.ah), (r.bx, r.by, r.bw, r.bh)
            if not any((over(a, x) > limit and over(b, y) > limit) or (over(a, y) > limit and over(b, x) > limit) for x, y in pairs):
                pairs.append((a, b))
                out.append(r)
        return out

    def run(batches):
        """Groups follow each other in a partition; the last of a batch may go on in the next."""
        group_at, rest = None, []
        for pdf in batches:
            done = []
            for r in pdf.itertuples(index=False):
                g = getattr(r, group)
                if g != group_at:
                    done += keep(rest)
                    group_at, rest = g, []
                rest.append(r)
            yield pd.DataFrame(done, columns=cols)
        yield pd.DataFrame(keep(rest), columns=cols)

    return boxes.repartition(group).sortWithinPartitions(group).mapInPandas(run, boxes.schema)
