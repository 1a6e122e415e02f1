"""python -m echolens {cross,intra,all} ROOT --out FOLDER: duplicates among the PNG files under ROOT, as
matches.csv, cross.json, intra.json, report.html and report.json (directory, counts, seconds)."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession

from .plans import regions
from .sources import images, sinks
from .sources.scratch import kept


def png_files(spark: SparkSession, root: str, excluded: tuple[str, ...] = images.EXCLUDED) -> DataFrame:
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    return content.join(images.scan_files(spark, root, excluded).select("path"), "path", "left_semi")


def run(spark: SparkSession, mode: str, root: str, out: str) -> dict:
    """Writes the reports to ``out`` (tables as Spark's folders, so any size) and returns counts."""
    start = time.time()
    files = png_files(spark, root, images.EXCLUDED if mode != "intra" else ())
    counts = {"directory": root, "n_images": files.count()}
    if mode in ("cross", "all"):
        cross = kept(regions.cross_with_features(files))
        sinks.write_csv(cross, f"{out}/matches.csv")
        sinks.write_json(cross, f"{out}/cross.json")
        sinks.write_text(spark, sinks.html_report(cross, f"Matches under {root}"), f"{out}/report.html")
        counts["n_cross"] = cross.count()
    if mode in ("intra", "all"):
        intra = kept(regions.intra(files))
        sinks.write_json(intra, f"{out}/intra.json")
        counts["n_intra"] = intra.count()
    counts["elapsed"] = round(time.time() - start, 2)
    sinks.write_text(spark, json.dumps(counts), f"{out}/report.json")
    return counts


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="echolens", description=__doc__)
    parser.add_argument("mode", choices=("cross", "intra", "all"))
    parser.add_argument("root")
    parser.add_argument("--out", required=True)
    given = parser.parse_args(args)
    print(json.dumps(run(SparkSession.builder.getOrCreate(), given.mode, given.root, given.out)))


if __name__ == "__main__":
    main()
