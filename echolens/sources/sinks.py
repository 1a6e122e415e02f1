"""Reports: JSON, CSV and a self-contained HTML page of the first matches."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rank import severity_rank


def write_json(matches: DataFrame, path: str) -> None:
    matches.write.mode("overwrite").json(path)


def write_csv(matches: DataFrame, path: str) -> None:
    """With similarity and confidence as percentages."""
    pct = lambda c: F.format_string("%.2f%%", F.col(c) * 100)
    matches.withColumn("similarity", pct("similarity")).withColumn("confidence", pct("confidence")).write.mode("overwrite").option("header", True).csv(path)


def html_report(matches: DataFrame, title: str, top: int = 200) -> str:
    """The first ``top`` matches by severity and confidence, as one page with a search box."""
    rows = matches.orderBy(severity_rank(), F.desc("confidence"), "id1", "id2").limit(top).collect()
    cols = matches.columns
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(r[c]))}</td>" for c in cols) + "</tr>" for r in rows)
    find = "for(const r of document.querySelectorAll('tbody tr'))r.hidden=!r.innerText.toLowerCase().includes(this.value.toLowerCase())"
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><input placeholder="search" oninput="{find}"><table border="1"><thead><tr>{"".join(f"<th>{html.escape(c)}</th>" for c in cols)}</tr></thead><tbody>{body}</tbody></table>'


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One file, through the file system that the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    out.write(text.encode())
    out.close()
