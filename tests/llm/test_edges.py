"""Empty tables, nulls, odd ids, clashing columns and adverse inputs, for every operator and stage."""

import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolens.llm import common, decontamination, lm_score, media, ngram_join, packing, pii, queries, secrets, suffix_dedup, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, t string, i string, key string, node long, h long"
BENCH = "item_id long, text string"


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Null and empty texts, repeated ids and rows, a null id, and columns named as the operators' own."""
    texts = [None, "", "  ", "one", "one", "Some words idiot idiot and more of them " * 9, "é" * 200]
    rows = [(k % 5 or None, t, "en", None, None, "x", "y", "z", "k", 3, 4) for k, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("odd") / "t")
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def bench(spark, rows=((1, "one two three"), (2, None))):
    return spark.createDataFrame(list(rows), BENCH)


def outputs(spark, docs):
    bpe = queries.public_tokenizers.path("byte_bpe_50k.tiktoken")
    yield packing.pack(docs, queries.WORD_BPE)
    yield ngram_join.jaccard_components(docs)
    yield suffix_dedup.repeated_spans(docs)
    yield decontamination.contamination(docs, bench(spark))
    yield pii.detect(docs, pii.SemiCRF(regions=24, epochs=1))
    yield lm_score.score_corpus(docs, bpe)
    yield toxicity.score(docs, toxicity.Lexicon({" idiot": 3.0}, set(), np.array([-2.0, 1.0, 1.0, 1.0])))
    yield secrets.scan(docs, secrets.fit(docs))
    yield media.read_back(media.stored_texts(docs))


def test_empty_tables(spark, empty):
    assert [df.count() for df in outputs(spark, empty)] == [0] * 9
    pages = spark.createDataFrame([], "page_id long, url string, fetched string")
    entries = spark.createDataFrame([], "list string, verdict string, key string, action string, at string")
    one = spark.createDataFrame([(1, "http://a.com", "2024-01-01")], pages.schema)
    assert url_filter.judge(pages, entries, "page_id", "url", "fetched").count() == 0
    assert [r.blocked for r in url_filter.judge(one, entries, "page_id", "url", "fetched").collect()] == [False]
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(empty, labels))
    for kept in (ngram_join.keep_one(empty), decontamination.keep_uncontaminated(empty, bench(spark)), toxicity.keep_clean(empty, model), secrets.redact(empty, secrets.fit(empty))):
        assert kept.columns == empty.columns and kept.count() == 0


def test_awkward_rows(spark, awkward):
    n = awkward.count()
    sizes = [df.count() for df in outputs(spark, awkward)]
    assert sizes == [n] * 9
    model = toxicity.Lexicon({" idiot": 9.0}, set(), np.array([-2.0, 1.0, 1.0, 1.0]))
    kept = toxicity.keep_clean(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == n - 1 and not kept.where("text like '%idiot%'").count()
    assert ngram_join.keep_one(awkward).columns == awkward.columns
    clean = decontamination.keep_uncontaminated(awkward, bench(spark, [(1, "one")]))
    assert clean.columns == awkward.columns and clean.where("text = 'one'").count() == 0 and clean.count() == n - 2


def test_ids_of_other_types(spark, tmp_path):
    spark.createDataFrame([("a", "one two"), (None, None)], "doc_id string, text string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    kind = docs.schema["doc_id"].dataType
    for df in (media.read_back(media.stored_texts(docs), kind), secrets.scan(docs, secrets.Scanner(["word"])), packing.pack(docs, queries.WORD_BPE), decontamination.contamination(docs, bench(spark))):
        assert sorted(str(r.doc_id) for r in df.collect()) == ["None", "a"]


def test_computed_inputs_are_stored(spark, awkward):
    assert common.stored(awkward.where("doc_id > 1").select("doc_id", "text")) .columns == ["doc_id", "text"]
    shuffled = awkward.orderBy(F.rand())
    assert common.stored(awkward) is awkward and common.stored(shuffled) is not shuffled


def test_training_rows_are_bounded_and_held_out(spark, tmp_path):
    rows = [(k, f"text {k}") for k in range(900)]
    labels = [(k, k % 2) for k in range(900)] + [(1, None), (2, 1), (3, 7), (None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs, lab = spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.t: r.y for r in toxicity.training_rows(docs, lab).collect()}
    held = {k for k in range(900) if zlib.crc32(str(k).encode()) % 3 == 1}
    assert got == {f"text {k}": 1 if k == 2 else k % 2 for k in range(900) if k not in held}
    few = toxicity.training_rows(docs, lab, labelled_rows=100).collect()
    assert 60 < len(few) <= 200 and {r.t for r in few} <= got.keys()
    assert toxicity.bounded(spark.createDataFrame([("same", 1)] * 500, "t string, y int"), 40).count() == 40


def test_lexicon_matches_as_a_plain_search():
    r = np.random.default_rng(7)
    letters = list("abc")
    for _ in range(300):
        words = ["".join(r.choice(letters, int(r.integers(1, 5)))) for _ in range(12)]
        weights = {(" " + "".join(r.choice(letters, int(r.integers(1, 4)))) + " " * int(r.integers(0, 2))): float(r.integers(1, 9)) for _ in range(6)}
        spared = {f" {words[int(r.integers(12))]} ", f" {words[0]} {words[1]} "}
        text, want = " " + " ".join(words) + " ", {}
        for k, v in weights.items():
            at = text.find(k)
            while at >= 0:
                if k not in spared:
                    want[at] = max(want.get(at, 0.0), v)
                at = text.find(k, at + 1)
        for k in spared:
            at = text.find(k)
            while at >= 0:
                for p in [p for p in want if at <= p < at + len(k) - 1]:
                    del want[p]
                at = text.find(k, at + 1)
        assert toxicity.hits(words, toxicity.automaton(weights, spared), spared) == want


def test_private_key_blocks_are_masked_whole():
    scanner = secrets.Scanner(["some", "words", "here", "other", "ordinary"])
    r = np.random.default_rng(1)
    for form, lines in (("RSA ", 24), ("", 3), ("OPENSSH ", 60)):
        body = "\n".join("".join(r.choice(list("ABCDEFabcdefghij0123456789+/"), 64)) for _ in range(lines))
        block = f"-----BEGIN {form}PRIVATE KEY-----\n{body}\n-----END {form}PRIVATE KEY-----"
        text = f"some words {block} password=hunter2xyz8 here"
        got = [text[a:b] for a, b, _ in secrets.candidates(text)]
        assert got == [block, "hunter2xyz8"]
        assert [text[a:b] for a, b, _ in scanner.scan([text])[0][1]][0] == block
    assert secrets.blocks("-----END PRIVATE KEY-----" * 3 + "-----BEGIN PRIVATE KEY-----" * 3) == []
    start = time.process_time()
    secrets.blocks("-----BEGIN PRIVATE KEY-----" * 20000 + "-----END PRIVATE KEY-----" * 20000)
    assert time.process_time() - start < 2


def test_sniffing_is_linear():
    for part in (b"%PDF-", b"\x1f\x8b\x08\0\0\0\0\0\0\x03", b"PK\x03\x04", b"PK\x03\x04PK\x05\x06" + bytes(18), b"\xff\xd8\xff\xc0\0\x02\xff\xda\0\x02", b"GIF89a", b"RIFF\0\0\0\0WAVE", b"fLaC", b"\x89PNG\r\n\x1a\n", b"BM"):
        start = time.process_time()
        media.sniff(part * (400_000 // len(part)))
        assert time.process_time() - start < 1, part
    import gzip
    import io
    import zipfile

    z = gzip.compress(b"x" * 99999)
    assert media.sniff(b"a" + z + b"b") == [(1, 1 + len(z), {"type": "gzip"})] and not media.sniff(z[:-9])
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as f:
        f.writestr("a.txt", "hello")
    a = buffer.getvalue()
    assert [x[:2] for x in media.sniff(b"xx" + a + b"yy" + a)] == [(2, 2 + len(a)), (4 + len(a), 4 + 2 * len(a))]
    assert [x[2]["type"] for x in media.sniff(b"%PDF-1.4 .. startxref 9 %%EOF %PDF- %%EOF")] == ["pdf"]


def test_addresses_have_no_parent_domains(spark):
    rows = [(1, "http://10.0.0.1/a"), (2, "http://[::1]:80/a"), (3, "http://x.a.com/")]
    out = {r.k: [x.key for x in r.keys] for r in spark.createDataFrame(rows, "k int, url string").select("k", url_filter.keys_of(F.col("url")).alias("keys")).collect()}
    assert out == {1: ["10.0.0.1", "10.0.0.1/a"], 2: ["[::1]", "[::1]/a"], 3: ["com", "a.com", "x.a.com"]}


def test_a_cluster_of_thousands(spark):
    """Near copies of one text with one to nine edits, against the pairs of an inverted index."""
    r = np.random.default_rng(12)
    rows = []
    for k in range(2500):
        w = [f"w{i}" for i in range(150)]
        for j in r.integers(0, 150, int(r.integers(1, 10))):
            w[j] = f"x{k}_{j}"
        rows.append((k, " ".join(w)))
    voc: dict = {}
    sets = [sorted({voc.setdefault(tuple(t.split()[i : i + 5]), len(voc)) for i in range(146)}) for _, t in rows]
    shared = np.zeros((len(rows), 146), np.float32)
    base = {tuple(f"w{i + j}" for j in range(5)): i for i in range(146)}
    of = {v: base[k] for k, v in voc.items() if k in base}
    for k, s in enumerate(sets):
        shared[k, [of[x] for x in s if x in of]] = 1
    both = shared @ shared.T
    size = np.array([len(s) for s in sets])
    linked = (100 * both >= 80 * (size[:, None] + size - both)) | np.eye(len(rows), dtype=bool)
    low = np.arange(len(rows))
    while True:
        now = np.where(linked, low[None], len(rows)).min(1)
        if (now == low).all():
            break
        low = now
    got = {x.doc_id: x.component_id for x in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(rows))] == low.tolist() and 2 < len(set(low)) < 2000
