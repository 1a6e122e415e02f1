"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, lm_score, media, ngram_join, packing, pii, secrets, suffix_dedup, toxicity, url_filter
from .common import RID

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame) -> DataFrame:
    return packing.pack(docs, WORD_BPE).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op1_pack_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_url_temporal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures: all pages, fetched at a time by rule. List: entries by rule for the hosts that occur."""
    pages = table(spark, sf_dir, "pages")
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")).cast("timestamp")
    captures = pages.select("page_id", "url", day(number(F.col("page_id").cast("string")) % 730).alias("fetched"))
    hosts = captures.select(url_filter.host_of(F.col("url")).alias("host")).where("host <> ''").distinct().withColumn("u", number(F.col("host")))

    def entry(name, verdict, key, action, when, test):
        return hosts.where(test).select(F.lit(name).alias("list"), F.lit(verdict).alias("verdict"), key.alias("key"), F.lit(action).alias("action"), day(when).alias("at"))

    u, host = F.col("u"), F.col("host")
    entries = entry("malware", "block", host, "add", u % 300, u % 3 == 0)
    for part in (
        entry("malware", "block", host, "add", u % 300 + 20, u % 6 == 0),
        entry("malware", "block", host, "remove", u % 300 + 60 + u % 90, u % 6 == 0),
        entry("malware", "block", host, "add", u % 300 + 400, u % 30 == 0),
        entry("adult", "block", F.element_at(F.split(host, r"\."), -1), "add", F.lit(700), u % 50 == 0),
        entry("partners", "allow", F.concat(host, F.lit("/en")), "add", u % 200, u % 7 == 1),
        entry("partners", "allow", F.concat(host, F.lit("/en")), "remove", u % 200 + 300, u % 14 == 1),
        entry("phishing", "block", F.concat(host, F.lit("/fr")), "add", u % 500, u % 2 == 1),
    ):
        entries = entries.union(part)
    out = url_filter.judge(captures, entries, "page_id", "url", "fetched")
    return out.select("page_id", "host", "n_active", "decided_by", "list", F.date_format("since", "yyyy-MM-dd").alias("since"), "blocked")


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_pii_semicrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.detect(table(spark, sf_dir, "documents"), pii.SemiCRF())
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"))


def op7_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")).drop(RID)


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Lexicon:
    return toxicity.fit(toxicity.training_rows(docs, labels))


def op8_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = secrets.scan(docs, secrets.fit(docs))
    shown = F.array_join(F.transform("findings", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select("doc_id", "n_candidates", F.size("findings").cast("long").alias("n_findings"), shown.alias("spans"))


def op10_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return media.read_back(media.stored_texts(docs), docs.schema["doc_id"].dataType).drop(RID)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_pack_hilbert, op2_ngram_jaccard_join, op3_suffix_dedup, op4_url_temporal_join, op5_winnowing, op6_pii_semicrf, op7_attention_lm, op8_toxic_lexicon, op9_secret_forest, op10_signature_sniffing, pipeline)}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NUMBER = "CAST('0x' || substr(md5({}), 1, 6) AS INT)"
_DAY = "(DATE '2024-01-01' + CAST({} AS INT))"


def _op4_sql() -> str:
    rules = [
        ("malware", "block", "host", "add", "u % 300", "u % 3 = 0"),
        ("malware", "block", "host", "add", "u % 300 + 20", "u % 6 = 0"),
        ("malware", "block", "host", "remove", "u % 300 + 60 + u % 90", "u % 6 = 0"),
        ("malware", "block", "host", "add", "u % 300 + 400", "u % 30 = 0"),
        ("adult", "block", "split_part(host, '.', -1)", "add", "700", "u % 50 = 0"),
        ("partners", "allow", "host || '/en'", "add", "u % 200", "u % 7 = 1"),
        ("partners", "allow", "host || '/en'", "remove", "u % 200 + 300", "u % 14 = 1"),
        ("phishing", "block", "host || '/fr'", "add", "u % 500", "u % 2 = 1"),
    ]
    union = " UNION ALL ".join(f"SELECT '{a}' AS list, '{b}' AS verdict, {k} AS key, '{act}' AS action, {_DAY.format(d)} AS ts FROM hosts WHERE {t}" for a, b, k, act, d, t in rules)
    return f"""
WITH caps AS (
  SELECT page_id, url, {_DAY.format(_NUMBER.format("CAST(page_id AS VARCHAR)") + " % 730")} AS fetched,
    regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^]/?#]*\\]|[^/?#:@]*)', 1)), '\\.+$', '') AS host,
    list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages),
hosts AS (SELECT DISTINCT host, {_NUMBER.format("host")} AS u FROM caps WHERE host <> ''),
raw AS ({union}),
ev AS (SELECT list, verdict, key, ts, max(action) AS action FROM raw GROUP BY ALL),
-- an entry is active at a time if the last entry before it is an add; since: the first add after the last remove
entered AS (
  SELECT c.page_id, e.list, e.verdict, e.key, k.rank, max_by(e.action, e.ts) AS action,
    max(e.ts) FILTER (e.action = 'remove') AS gone, list(e.ts) FILTER (e.action = 'add') AS adds
  FROM caps c
  JOIN (SELECT page_id, unnest(range(CASE WHEN regexp_full_match(host, '[0-9]+(\\.[0-9]+){{3}}|\\[.*') THEN len(string_split(host, '.')) ELSE 1 END, len(string_split(host, '.')) + 1)) AS rank, host AS h FROM caps WHERE host <> '') k0 USING (page_id)
  JOIN LATERAL (SELECT array_to_string(string_split(k0.h, '.')[-k0.rank:], '.') AS key, k0.rank AS rank) k ON true
  JOIN ev e ON e.key = k.key AND e.ts <= c.fetched
  GROUP BY ALL
  UNION ALL
  SELECT c.page_id, e.list, e.verdict, e.key, k0.rank + 100, max_by(e.action, e.ts), max(e.ts) FILTER (e.action = 'remove'), list(e.ts) FILTER (e.action = 'add')
  FROM caps c
  JOIN (SELECT page_id, unnest(range(1, least(len(parts), 4) + 1)) AS rank FROM caps WHERE host <> '') k0 USING (page_id)
  JOIN ev e ON e.key = c.host || '/' || array_to_string(c.parts[1:k0.rank], '/') AND e.ts <= c.fetched
  GROUP BY c.page_id, e.list, e.verdict, e.key, k0.rank),
active AS (
  SELECT page_id, list, verdict, key, rank, list_min(list_filter(adds, lambda x: gone IS NULL OR x > gone)) AS since FROM entered WHERE action = 'add'),
best AS (
  SELECT page_id, count(*) AS n, arg_max({{'k': key, 'l': list, 's': since, 'b': verdict = 'block'}}, (rank, since, verdict = 'block', key, list)) AS b FROM active GROUP BY page_id)
SELECT c.page_id, c.host, coalesce(best.n, 0)::BIGINT AS n_active, best.b.k AS decided_by, best.b.l AS list, strftime(best.b.s, '%Y-%m-%d') AS since, coalesce(best.b.b, false) AS blocked
FROM caps c LEFT JOIN best USING (page_id)
"""


ORACLES = {
    "op2_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
""",
    "op3_suffix_dedup": """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS MATERIALIZED (SELECT doc_id, lo, substr(h, 2 * lo + 1, 898) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, 400)) AS lo FROM d)),
w AS MATERIALIZED (SELECT doc_id, lo + i AS i, md5(substr(h, 2 * i - 1, 100)) AS k FROM (SELECT doc_id, lo, h, unnest(range(1, len(h) // 2 - 48)) AS i FROM c)),
m AS (SELECT k, min(doc_id) AS first_id FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, i FROM w JOIN m USING (k) WHERE first_id < doc_id),
new AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS opens FROM hit),
run AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM new),
span AS (SELECT doc_id, min(i) - 1 AS s, max(i) + 49 AS e FROM run GROUP BY doc_id, g),
piece AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS b FROM span
  UNION ALL SELECT doc_id, max(e), 1000000000 FROM span GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM piece JOIN d USING (doc_id) GROUP BY doc_id),
total AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN total USING (doc_id)
""",
    "op4_url_temporal_join": _op4_sql(),
    "op5_winnowing": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
