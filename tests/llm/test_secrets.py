"""Secret candidates: the pre-filter and the extent of what is found."""

import itertools
import re
import time

import numpy as np

from echolens.llm import secrets


def test_prefilter_lets_every_candidate_pass():
    for sep, gap, quote in itertools.product((":", "=", ":=", "=>"), ("", " ", "\t  "), ("", '"', "'")):
        for value in ("Xk29vQp7rT", ">k29vQ", "abcdef"):
            t = f"my $h = {{ 'password'{gap}{sep}{gap}{quote}{value}{quote} }}"
            assert secrets.CANDIDATE.search(t) and secrets.MAYBE.search(t), t
            assert [t[a:b] for a, b, _ in secrets.candidates(t)] == [value], t
    t = "0123456789abcdeK"  # equals a k where case is ignored
    assert secrets.CANDIDATE.search(t) and secrets.MAYBE.search(t)


def found(t):
    return [t[a:b] for a, b, _ in secrets.candidates(t)]


def test_candidates_are_whole():
    r = np.random.default_rng(4)
    key = lambda n: "".join(r.choice(list("ABCDEFabcdef0123456789-_"), n))
    jwt = f"eyJ{key(180)}.{key(300)}.{key(340)}x"
    assert found(f"see {jwt} there") == [jwt] and found(f"--{jwt}== there") == [jwt + "=="]
    assert found(f"private_key = '{jwt}'") == [jwt] and found(f"token: {jwt}.") == [jwt]
    late = "a" * 400 + "1" + "b" * 400  # its digit comes late
    assert found(f"x {late} y") == [late]
    assert found(f"{jwt}-password=hunter22x y") == [jwt + "-password=", "hunter22x"]
    assert found(f"{jwt}-password==hunter22x y") == [jwt + "-password=", "=hunter22x"]
    assert found("a.b/c-" * 50) == [] and found("short1") == []


def test_no_part_of_a_long_key_is_left(spark, tmp_path):
    r = np.random.default_rng(5)
    key = lambda n: "".join(r.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), n))
    jwts = [f"eyJ{key(a)}.{key(b)}.{key(c)}" for a, b, c in ((30, 40, 30), (100, 400, 340), (500, 1500, 86))]
    keys = [key(n) for n in (32, 1592, 40000)]
    rows = [(k, f"some words {t} here") for k, t in enumerate(jwts)] + [(10 + k, f'private_key = "{t}" here') for k, t in enumerate(keys)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    got = {x.doc_id: x.text for x in secrets.redact(docs, secrets.Scanner(["some", "words", "here", "other", "ordinary"])).collect()}
    assert set(got.values()) == {"some words [SECRET] here", 'private_key = "[SECRET]" here'}, got


def test_search_is_linear():
    for part in ("a.", "a", "-", "password ", "password=", "token_", "1=", "x1_password="):
        start = time.process_time()
        found(part * (400_000 // len(part)))
        assert time.process_time() - start < 5, part


def test_short_candidates_are_as_before():
    old = re.compile(
        rf"(?P<name>(?:{secrets.NAMES})[a-z_]{{0,12}})[\"']?[ \t]*(?::=|=>|[:=])[ \t]*(?P<q>[\"']?)(?P<value>[^\s\"',;]{{6,256}})|(?<![A-Za-z0-9])(?P<run>(?=[A-Za-z_\-/+.]{{0,200}}[0-9])[A-Za-z0-9][A-Za-z0-9_\-/+.]{{14,255}}[A-Za-z0-9]={{0,2}})",
        re.IGNORECASE,
    )
    r = np.random.default_rng(6)
    parts = ["a", "b1", "Q", "7", "-", "_", "/", "+", ".", "=", "==", " ", " ", "'", ":", "=>", ",", "é", "abcdefgh", "x9x9x9x9", "password", "token"]
    for _ in range(20000):
        t = "".join(r.choice(parts, 16))
        want = [m.span("run" if m["value"] is None else "value") for m in old.finditer(t)]
        assert {x for x in want} <= {m.span("run" if m["value"] is None else "value") for m in secrets.CANDIDATE.finditer(t)}, t


def test_dictionary_has_the_words_of_every_text(spark, tmp_path):
    letters = "abcdefghij"
    own = ["".join(letters[int(c)] for c in f"{k:06d}") for k in range(3000)]
    rows = [(k, f"Some {w.upper()} word-{w}") for k, w in enumerate(own)] + [(3000, None), (3001, ""), (3002, "x " * 600_000 + "rarely")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    assert {r.w: r.n for r in secrets.word_counts(docs, limit=500).collect()} == {**dict.fromkeys(own, 2), "some": 3000, "word": 3000, "x": 600_000, "rarely": 1}
    assert secrets.fit(docs).words.words == {*own, "some", "word", "rarely"}
    assert secrets.fit(docs, dictionary_words=4).words.words == {"some", "word", own[0]}


def test_pipeline_stage_learns_from_all_that_is_kept(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    letters = "abcdefghij"
    own = ["".join(letters[int(c)] for c in f"{k:06d}") for k in range(2600)]
    rows = [(k, f"some {w} here", "en") for k, w in enumerate(own)] + [(2600, 'password = "Xk29vQp7rT4zLm8w" here', "en"), (2601, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    used, redact = [], secrets.redact
    monkeypatch.setattr(secrets, "redact", lambda d, scanner: used.append(scanner) or redact(d, scanner))
    out = {r.doc_id: r.text for r in corpus_pipeline.stage_secrets(spark, docs, "").collect()}
    assert used[0].words.words == {*own, "some", "here", "password"}
    assert out == {**{k: t for k, t, _ in rows}, 2600: 'password = "[SECRET]" here'}
