"""Repeated spans: equal in hashes is not equal in bytes."""

import numpy as np
import pandas as pd
import pytest

from echolens.llm import suffix_dedup

#: The hashes of these phrases are equal in their top 48 bits, 0x6eeefa328815.
A, B = "An ordinary passage of text that nobody repeanjeit", "An ordinary passage of text that nobody repearyyoj"


def removed(spark, path, rows, **options):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    return {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.repeated_spans(spark.read.parquet(path), **options).collect()}


def test_nearly_equal_hashes(spark, tmp_path):
    got = removed(spark, str(tmp_path / "t"), [(i, A if i < 8 else B) for i in range(16)])
    assert got == {i: A if i == 0 else B if i == 8 else "" for i in range(16)}


#: Unequal strings whose 64-bit hashes once agreed in their top 48 bits.
PAIRS = (
    ("tmmojusmzhttnjhivxcdysifarcbylxwaalyvouxqksajbjtjq", "fcgqhawxjewugbbqbxvdgjsuvcmfmyszherjdngpzxdgufmhjm"),
    ("mcfppwochfkymhlmxripeqeragxsbweozvultiflyhgcaiyhbo", "ewqnllrklmhdxypybkadtpebiwiikchzkxyybtowrjsawwbpcv"),
)


def test_unequal_strings_stay(spark, tmp_path):
    rows = [(4 * k + j, t) for k, pair in enumerate(PAIRS) for j, t in enumerate(pair)]
    assert removed(spark, str(tmp_path / "t"), rows) == dict(rows)


def test_equal_hashes_are_told_apart_in_a_block(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_phrase_key", lambda first, last, run: np.zeros(len(run), np.uint64))
    r = np.random.default_rng(3)
    texts = ["".join(r.choice(list("abc"), 120)) for _ in range(3)]
    rows = pd.DataFrame({"__rid": range(4), "id": [5, 3, 9, 7], "text": [*texts, texts[0]]})
    b = suffix_dedup.Block(rows, 50)
    pieces = [b._piece(k) for k in range(len(b.at))]
    assert len(set(pieces)) == len(b.first) and all(pieces[k] == pieces[b.first[b.phrase[k]]] for k in range(len(pieces)))
    least = {}
    for k, p in enumerate(pieces):
        least[p] = min(least.get(p, 99), int(b.ids[b.doc[k]]))
    assert [least[pieces[k]] for k in b.first] == b.low.tolist()


def test_suffix_order_against_sorted_strings():
    r = np.random.default_rng(4)
    for span, letters in ((50, "ab"), (50, "\0a"), (26, "abcd")):
        parts = [bytes(r.choice(list(letters.encode()), int(r.integers(span, span + 27))).tolist()) for _ in range(60)]
        parts += [p[:span] for p in parts[:20]] + parts[:9]
        ids, run = r.integers(0, 40, len(parts)), np.array([len(p) - span + 1 for p in parts])
        want = {}
        for p, i in zip(parts, ids, strict=True):
            for k in range(len(p) - span + 1):
                want[p[k : k + span]] = min(want.get(p[k : k + span], 99), int(i))
        got = suffix_dedup.smallest_documents(np.zeros(len(parts), np.uint64), np.frombuffer(b"".join(parts), np.uint8), run, ids, span)
        assert got.tolist() == [want[p[k : k + span]] for p in parts for k in range(len(p) - span + 1)]


@pytest.mark.parametrize("hot", [2048, 2])
def test_many_shared_passages(spark, tmp_path, hot):
    r = np.random.default_rng(8)
    pool = ["".join(r.choice(list("abcdef "), int(n))) for n in r.integers(20, 160, 12)]
    rows = [(int(i), "".join("".join(r.choice(list("ghijk "), int(r.integers(0, 30)))) + pool[int(k)] for k in r.integers(0, 12, 5))) for i in r.permutation(150)]
    first, want = {}, {}
    for i, t in sorted(rows):
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
        on = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            on[p : p + 50] |= first[t[p : p + 50]] < i
        want[i] = "".join(c for c, gone in zip(t, on, strict=True) if not gone)
    assert removed(spark, str(tmp_path / "t"), rows, hot=hot) == want


def test_ids_are_kept_whole():
    for ids in ([], [0], [5, 1 << 20, 3], [-1, (1 << 63) - 1, -(1 << 63), 7]):
        x = np.array(ids, np.int64)
        assert suffix_dedup._unpack(suffix_dedup._pack(x)).tolist() == ids


def test_triggers_are_dealt_evenly():
    r = np.random.default_rng(9)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    rows = pd.DataFrame({"__rid": range(20), "id": range(20), "text": ["".join(r.choice(letters, 10_000)) for _ in range(20)]})
    b = suffix_dedup.Block(rows, 50)
    share = np.diff(suffix_dedup.cuts(np.sort(b.trigger[b.first]), 64)) / len(b.first)
    assert share.max() < 2 / 64 and share.min() > 0.5 / 64, share
