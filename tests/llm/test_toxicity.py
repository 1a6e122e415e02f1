"""The lexicon covers every entry."""

import numpy as np

from echolens.llm import toxicity


def test_common_words_leave_room_for_a_rare_toxic_one(spark):
    r = np.random.default_rng(2)
    common = " ".join({"".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 8)) for _ in range(6000)})
    rows = [(f"{common} zqidiotic" if i < 10 else common, int(i < 30)) for i in range(90)]
    model = toxicity.fit(spark.createDataFrame(rows, "t string, y int"))
    assert model.found(toxicity.fold("some zqidiotic words")) and not model.found(toxicity.fold(common))
