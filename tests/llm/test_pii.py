"""Entities of many tokens."""

import pytest

from echolens.llm import pii

LONG = {"ip": ["10[.]0[.]0[.]1", "192[.]168[.]14[.]203"], "email": ["john.smith [at] mail [dot] example [dot] com", "anter.mola [at] mail3 [dot] example.com"]}


def test_every_generated_entity_is_a_segment():
    for seed in (9, 77, 123):
        for text, gold in pii.labelled_regions(seed, 200):
            assert len(pii.SemiCRF._prepare(text, gold)[3]) == len(gold), text
    text = "word " * 2 + "1 2" * 30
    with pytest.raises(ValueError):
        pii.SemiCRF._prepare(text, [("card", 10, len(text))])


def test_long_entities_are_found_whole():
    model = pii.SemiCRF()
    for kind, forms in LONG.items():
        for e in forms:
            t = f"some words about {e} and more"
            assert (kind, 17, 17 + len(e)) in pii.find(t, model)[1], (e, pii.find(t, model)[1])
