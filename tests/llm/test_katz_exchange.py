"""op7_katz_lm: what its exchange takes, and frequent histories that several tasks share."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import DOC, plain_katz, words

from wiremill.llm import katz_lm


@pytest.mark.parametrize(("often", "turn", "chunk"), [(2, 700_000, 2_500_000), (10_000, 100, 300)])
def test_scores_need_no_tables_and_do_not_depend_on_how_grams_are_dealt(spark, monkeypatch, often, turn, chunk):
    for name, value in (("_OFTEN", often), ("_TURN", turn), ("_CHUNK", chunk)):
        monkeypatch.setattr(katz_lm, name, value, raising=False)
    rng = random.Random(71)
    texts = [words(rng, rng.randrange(0, 40), 9) for _ in range(80)] + [None, "", "w1 w2 w3 never seen", *["w1 w2 w3"] * 9]
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOC).repartition(3)
    there = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(there.rglob("*.parquet"))
    got = {r["doc_id"]: r for r in katz_lm.score(rows, katz_lm.fit(rows.where("doc_id % 4 <> 0")), keep={"doc_id": "doc_id"}).collect()}
    assert set(there.rglob("*.parquet")) == before
    once = {r["doc_id"]: r for r in katz_lm.fit_and_score(rows, F.expr("doc_id % 4 <> 0"), keep={"doc_id": "doc_id"}).collect()}
    split = [[*(t or "").lower().split(), "</s>"] for t in texts]
    p, counts = plain_katz([t for i, t in enumerate(split) if i % 4], 3)
    assert set(got) == set(once) == set(range(len(texts)))
    for i, t in enumerate(split):
        padded = ["<s>", *t]
        want = sum(np.log10(p(tuple(padded[max(0, k - 2) : k]), padded[k])) for k in range(1, len(padded)))
        for r in (got[i], once[i]):
            assert abs(r["score"] - want) < 1e-6 * max(1, abs(want))
            assert (r["n_tokens"], r["n_known"]) == (len(t), sum(counts[1][w,] > 0 for w in t))
    assert katz_lm.fit(rows.where("doc_id % 4 <> 0")).grams[3].count() == sum(len(g) == 3 for g in counts[3])


def test_packed_arrays_come_back():
    for a in ([], [0, 0], [1, 255, 256], [2**64 - 1, 5]):
        assert katz_lm.unpacked(katz_lm.packed(np.array(a, np.uint64), np.arange(3)))[0].tolist() == a
    assert katz_lm.unpacked(katz_lm.packed(np.array([-1.5, 0.25])))[0].view(np.float64).tolist() == [-1.5, 0.25]
