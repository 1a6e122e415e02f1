"""The language model learns from every training text."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from echolens.llm import common, lm_score

BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu", "ha", "ki", "lo") for b in ("rn", "st", "ll", "nd", "mp")]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def table(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_no_training_text_is_left_out(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(i, " ".join(r.choice(WORDS, 20))) for i in range(1250)]
    train = [i for i, _ in rows if not held(i)]
    # the order of words in texts outside a sample of 600 by row number changes; counts of words and ids do not
    some = {x.id for x in spark.range(len(train)).where(common.in_sample("id", 600, len(train))).collect()}
    other = {i for k, i in enumerate(train) if k not in some}
    assert len(other) > 200
    turned = [(i, " ".join(t.split()[::-1]) if i in other else t) for i, t in rows]
    one, two = ({x.doc_id: x for x in lm_score.score_corpus(table(spark, d, tmp_path / n), BPE).collect()} for n, d in (("one", rows), ("two", turned)))
    same = [i for i, _ in rows if held(i)]
    assert all(one[i].base_score == pytest.approx(two[i].base_score) for i in same)
    assert sum(abs(one[i].score - two[i].score) > 1e-6 for i in same) == len(same)


def test_counts_and_windows_are_those_of_all_texts(spark, tmp_path):
    r = np.random.default_rng(2)
    texts = ["", "one", *(" ".join(r.choice(WORDS, int(n))) for n in r.integers(1, 400, 90))]
    given = lm_score.text_ids([lm_score.split_words(t) for t in texts], BPE)
    end = lm_score._state["end"]
    rows = lm_score.encoded(table(spark, list(enumerate(texts)), tmp_path / "t").withColumnRenamed("text", "t"), BPE, end)
    got = sorted(rows.collect(), key=lambda x: x.r)
    assert [t.tolist() for x in got for t in lm_score.decoded(x.ids, end)] == [t.tolist() for t in given]
    total = sum(x.windows for x in got)
    assert total == len(lm_score.windows(given)[0]) and sum(x.texts for x in got) == len(texts)
    counts = lm_score.count_ids(rows, end)
    assert (counts == np.bincount(np.concatenate(given), minlength=end + 1)).all()
    cls = lm_score.flat_classes(counts)
    assert (lm_score.count_sides(rows, cls, end) == lm_score.side_counts(given, cls, lm_score.CLASSES)).all()
    nets = [lm_score.Attention(cls) for _ in range(2)]
    for net in nets:
        before = net.p["own"].copy()
        assert sum(lm_score.train_round(net, rows.where(f"pmod(r, 2) = {k}"), 3, end, (0.0, 1.0)) for k in (0, 1)) == total
        changed = np.flatnonzero((net.p["own"] != before).any(1))
        assert set(changed) == set(np.unique(np.concatenate([t[:-1] for t in given]))) | {len(cls)}
    assert all((nets[0].p[k] == nets[1].p[k]).all() for k in nets[0].p)
    assert lm_score.train_corpus(lm_score.Attention(cls), rows, end, total) == 4 * total  # a small corpus is gone over four times


def test_distinct_words_are_encoded_once_and_as_single_words():
    texts = ["", " ", "\tA a\x0bB\x0c", "\x1cq\x1d é\x85É\xa0z ", "the cat, The cat\r\n", "", "İ ſ K", "the " * 50]
    words, codes, lens = lm_score.distinct_words(texts)
    split = [lm_score.split_words(t) for t in texts]
    assert len(set(words)) == len(words) and lens.tolist() == [len(w) for w in split]
    assert [words[c] for c in codes] == [w for s in split for w in s]
    enc, end = lm_score._encoding(BPE), lm_score._state["end"]
    want = [[i for w in s for i in enc._encode_single_piece(b" " + w)] + [end] for s in split]
    for limit in (400_000, 0):
        assert [x.tolist() for x in lm_score.coded_ids(words, codes, lens, BPE, limit)] == want
    assert [x.tolist() for x in lm_score.text_ids(split, BPE)] == want


def test_a_step_looks_up_each_id_once():
    class Seen(np.ndarray):
        def __getitem__(self, at):
            if self is own:
                looked_up.append(np.size(at))
            return np.asarray(super().__getitem__(at))

    r, looked_up = np.random.default_rng(3), []
    net = lm_score.Attention(np.arange(500) % lm_score.CLASSES)
    x, weight = r.integers(0, 40, (64, lm_score.WINDOW)), np.ones((64, lm_score.WINDOW))
    own = net.p["own"] = net.p["own"].view(Seen)
    _, _, ids, _ = net.sparse_gradient(x, net.cls[r.integers(0, 500, x.shape)], weight)
    assert ids.tolist() == np.unique(x).tolist() and sum(looked_up) == len(ids)


def test_a_step_is_adam_and_ids_that_a_batch_lacks_rest():
    r = np.random.default_rng(4)
    net = lm_score.Attention(np.arange(500) % lm_score.CLASSES)
    x, weight = r.integers(0, 40, (60, lm_score.WINDOW)), np.ones((60, lm_score.WINDOW))
    y = net.cls[r.integers(0, 500, x.shape)]
    before = {k: v.copy() for k, v in net.p.items()}
    _, g = net.gradient(x, y, weight)
    net.train(x, y, weight, epochs=1)  # one step, of rate 0.05 * 0.01
    for k, v in before.items():
        on = np.abs(g[k]) > 1e-5  # the sign of a gradient of nearly nothing is open
        assert net.p[k][on] == pytest.approx((v - 0.0005 * np.sign(g[k]))[on], abs=2e-6)
    assert on.any() and (net.p["own"][40:] == before["own"][40:]).all()
    state, p, m, s = np.zeros((3, 7), np.float32), 0.0, 0.0, 0.0
    for step in (1, 2, 3):
        grad = r.standard_normal(7)
        lm_score.adam(state, grad.astype(np.float32), 0.01, step)
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        p = p - 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    assert state[0] == pytest.approx(p, abs=1e-6)
