"""Cases in which a cheaper search would leave a part of the job undone."""

import random

import numpy as np

from wiremill.llm import decontamination, line_templates, simhash_dedup

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, vocabulary):
    return [f"w{rng.randrange(vocabulary):x}" for _ in range(n)]


def test_decontamination_finds_all_paraphrases(spark):
    rng = random.Random(21)
    items = {i: words(rng, rng.choice((15, 24, 40)), 10**6) for i in range(40)}
    items[40] = words(rng, 30, 20)
    rows = []
    for item in items.values():
        for share in (0.2, 0.25, 0.3):
            edited = [w if rng.random() >= share else f"x{rng.randrange(10**6)}" for w in item]
            for _ in range(rng.choice((1, 1, 5))):
                rows.append((len(rows), " ".join(words(rng, 30, 20) + edited + words(rng, 30, 10**6)), "en", "s", 0))
    rows.append((len(rows), " ".join(w for i in range(0, 40, 2) for w in (*items[5][i : i + 2], "between")), "en", "s", 0))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id bigint, text string")
    found = decontamination.contamination(spark.createDataFrame(rows, DOC).repartition(4), bench, keep={"doc_id": "doc_id"})
    got = {(r["doc_id"], h["item_id"]): h["score"] for r in found.collect() for h in r["hits"]}
    ids = {}
    number = lambda text: np.array([ids.setdefault(w, len(ids)) for w in text])
    scores = {(d, i): decontamination.align(number(t), number(row.split()))[0] / (2 * len(t)) for d, row, *_ in rows for i, t in items.items()}
    expected = {k: s for k, s in scores.items() if s >= 0.5}
    assert len(expected) > 80
    assert got == expected


def test_near_copies_are_checked_by_their_whole_shingle_sets(spark):
    rng = random.Random(5)
    rows, least = [], {}
    for group in range(60):  # pairs around the limit: some words at the end are others
        n, other = 60, rng.randrange(6, 9)
        text = words(rng, n, 10**6)
        rows += [(2 * group, " ".join(text)), (2 * group + 1, " ".join(text[: n - other] + words(rng, other, 10**6)))]
        least[group] = 5 * (n - 4 - other) >= 4 * (n - 4 + other)
    assert 10 < sum(least.values()) < 50
    fps = [simhash_dedup.fingerprint(t, 5) for _, t in rows]
    far = {g for g in least if (fps[2 * g] ^ fps[2 * g + 1]).bit_count() > 4}
    assert len(far) > 40
    kept = {r["doc_id"] for r in simhash_dedup.drop_near_copies(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)).collect()}
    assert {2 * g for g in far} <= kept
    assert {g for g in far if 2 * g + 1 in kept} == {g for g in far if not least[g]}


def test_blocks_of_lines_are_dropped_and_copies_are_not(spark):
    """Unlike documents that share blocks of any length lose them; groups of exact and of near copies lose nothing."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    rows, blocks = [], {}
    for size, docs, own in ((1, 12, 1), (2, 12, 2), (6, 12, 2), (8, 40, 2), (10, 100, 1), (20, 30, 3), (20, 12, 1)):
        block = [line(rng.choice((3, 5, 12))) for _ in range(size)]
        for _ in range(docs):
            blocks[len(rows)] = (block, [line(10) for _ in range(own)])
            rows.append((len(rows), "\n".join([*blocks[len(rows)][1], *block]), "en", "s", 0))
    base = len(rows)
    copied = [line(12) for _ in range(8)]
    rows += [(base + i, "\n".join(copied), "en", "s", 0) for i in range(60)]
    near = [line(rng.choice((9, 12, 15))).split() for _ in range(10)]
    for _ in range(300):
        edited = [list(t) for t in near]
        for _ in range(rng.randrange(3)):
            t = rng.choice(edited)
            t[rng.randrange(len(t))] = word()
        rows.append((len(rows), "\n".join(map(" ".join, edited)), "en", "s", 0))
    got = {r["doc_id"]: r for r in line_templates.drop_template_lines(spark.createDataFrame(rows, DOC).repartition(4)).collect()}
    assert {i: got[i]["text"].split("\n") for i in blocks} == {i: own for i, (_, own) in blocks.items()}
    assert sum(got[i]["n_dropped"] for i in range(base, len(rows))) == 0
