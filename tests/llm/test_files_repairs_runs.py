"""Token files, conversation repair and periodic runs against plain forms of their definitions."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wiremill.llm import conversation_repair, periodic_runs, token_files

DOC = "doc_id bigint, text string, start int, n_tokens int, runs string"
TURN = "conv_id bigint, turn bigint, role string, text string, there string, cost int"
WORD = re.compile("[^\x20\x09-\x0d]+")
FILE = str(public_tokenizers.path("word_bpe_49k.json"))
ODD_TEXTS = [None, "", " \n\t", "a <|endoftext|>b<|startoftext|>", "it's we'll 's 't Ǻ İßǅ ΣΣ", "e ́x\u0085y z\x1cw 　 ﻿", "x" * 3000, "\U0001f600中文 12 345", "A\x00b"]


# Token files


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_blocks_keep_all_ids(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49408, n), rng.integers(0, 2**32, n), np.full(n, 7), np.where(rng.random(n) < 0.03, 2**32 - 1, rng.integers(0, 30, n))):
        ids = ids.astype(np.uint32)
        body, index = token_files.pack(ids)
        assert (token_files.unpack(body, index[:-1], n) == ids).all() if n else len(index) == 1
        lengths = np.array([n // 2, n - n // 2])
        data = token_files.frame(3, 4, [None, -5], lengths, ids) + b"\n"
        got = token_files.Frame(data)
        assert (got.part, got.number, got.keys, got.lengths.tolist()) == (3, 4, [None, -5], lengths.tolist())
        for a, b in ((0, n), (n // 3, n // 2), (n - 1, n + 9), (130, 131)):
            assert (got.ids(a, b) == ids[a:b]).all() if 0 <= a < n else True


def test_exceptions_make_blocks_smaller():
    ids = np.arange(1280, dtype=np.uint32) % 16
    ids[::64] = 49000
    assert len(token_files.pack(ids)[0]) < 10 * (6 + 64 + 10 + 1)


def test_words_encode_like_whole_texts():
    whole = Tokenizer.from_file(FILE)
    with open(FILE, encoding="utf-8") as f:
        encoder = token_files.WordEncoder(f.read())
    rng = random.Random(9)
    assert encoder._alike
    pieces = ["Été", "Größe", "d'été", "x'll", "'VE", "«ñ»", "×÷", "½", "ª", "a", "The", "'s", "́", "é", "İ", "<|endoftext|>", "<|endof", "42", "#!", "Σ", "中", "\x1f", " ", "‍", "don't"]
    texts = [t or "" for t in ODD_TEXTS] + ["".join(rng.choice(pieces) + rng.choice(("", "", " ", "\n", "\x0b")) for _ in range(rng.randrange(60))) for _ in range(600)]
    for lo in range(0, len(texts), 50):
        ids, sizes = encoder.encode([t.encode() for t in texts[lo : lo + 50]], 2)
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for text, part in zip(texts[lo : lo + 50], parts, strict=True):
            assert part.tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2], text


def test_files_hold_documents_in_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i - 3, t, 1, 2, "r") for i, t in enumerate(ODD_TEXTS + [" ".join(f"word{rng.randrange(50)}" for _ in range(rng.randrange(40))) for _ in range(200)])]
    rows += [(None, "null key", 0, 0, ""), (None, None, 0, 0, ""), rows[9], rows[9], (6, "another text of 6", 1, 1, "")]
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    token_files.write_tokens(docs, FILE, str(tmp_path / "t"), frame_ids=300)
    whole = Tokenizer.from_file(FILE)
    of = {(k, t): [*whole.encode(t or "", add_special_tokens=False).ids, 2] for k, t, *_ in rows}
    got = sorted(token_files.read_documents(spark, str(tmp_path / "t")).collect(), key=lambda r: (r["part"], r["number"], r["first"]))
    assert len({(r["part"], r["number"]) for r in got}) > 5
    keys = [r["doc_id"] for r in got]
    assert keys == sorted((r[0] for r in rows), key=lambda k: (k is not None, k))
    assert sorted((str(k), tuple(of[k, t])) for k, t, *_ in rows) == sorted((str(r["doc_id"]), tuple(r["ids"])) for r in got)
    found = token_files.with_starts(token_files.document_digests(spark, str(tmp_path / "t")).cache()).collect()
    found.sort(key=lambda r: r["start"])
    at = 0
    for r, ids in zip(found, (r["ids"] for r in got), strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


# Conversation repair


def plain_repair(rows):
    """Cheapest edits by a table over rows and states; the least audit of equals."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    seen, turns, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        bare = "".join(WORD.findall(text))
        found = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if found:
            counts[found] += 1
        turns.append((role, text, found))

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                to = "a" if state == "u" else "u"
                new = (cost + 2, audit + "I", [*out, ("assistant:" if to == "a" else "user:")])
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best

    best = inserted({"": (0, "", [])})
    for role, text, found in turns:
        following = {}

        def take(state, new):
            if state not in following or new[:2] < following[state][:2]:
                following[state] = new

        for state, (cost, audit, out) in best.items():
            take(state, (cost + 3, audit + "D", out))
            if found not in ("blank", "duplicate"):
                late = int(found == "truncated")
                for to, name in (("u", "user"), ("a", "assistant")):
                    if (state, to) in after:
                        take(to, (cost + 2 + late, audit + "R", [*out, f"{name}:{text}"]))
                if (state, role[:1]) in after:
                    take(after[state, role[:1]], (cost + late, audit + "K", [*out, f"{role}:{text}"]))
        best = inserted(following)
    cost, audit, out = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
    numbers = {t for t, *_ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    return {"gaps": gaps, **counts, "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


def plain_damage(rows):
    """The rows of each conversation after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = role if role is not None else " ", text if text is not None else " "
        rule = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text
        kept += [] if rule == 0 else [(turn, "user" if rule == 4 else role, text)] * (2 if rule == 3 else 1)
    return {c: sorted(k, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, k in out.items()}


def made_up_turns(rng, conversations):
    rows = []
    for conv in range(conversations):
        roles = [rng.choice(("user", "assistant", "system", "tool", "", None, "User", "unknown")) if rng.random() < 0.4 else ("user", "assistant")[k % 2] for k in range(rng.choice((0, 1, 2, 5, 9, 30)))]
        for turn, role in enumerate(roles):
            text = rng.choice((None, "", " \t", "Same.", "Same.", f"Words {turn}.", f"Ends early {turn}", f"Is it {turn}?\n", "é ¿."))
            rows.append((conv if conv else None, rng.choice((turn, turn, turn, turn + 2, None)), role, text))
    return [*rows, *rows[10:20]]


@pytest.mark.parametrize("piece_rows", [2000, 4])
def test_repairs_equal_a_plain_table(spark, piece_rows):
    rows = made_up_turns(random.Random(piece_rows), 250)
    turns = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURN).repartition(3)
    got = {r["conv_id"]: r.asDict() for r in conversation_repair.repaired(conversation_repair.damaged(turns), conversation_repair.F.col("there"), piece_rows).collect()}
    expected = {c: {"conv_id": c, **plain_repair(k)} for c, k in plain_damage(rows).items()}
    assert got == expected


def test_a_long_conversation_is_repaired_in_pieces(spark):
    rng = random.Random(8)
    rows = [(7, t, rng.choice(("user", "assistant", "system")), rng.choice((f"No {t}.", f"No {t}", "Again."))) for t in range(3000)] + [(7, 1, "user", "Again.")] * 300 + [(8, 0, "user", "Hello.")]
    turns = spark.createDataFrame([(*r, None, None) for r in rows], TURN).repartition(7)
    got = {r["conv_id"]: r.asDict() for r in conversation_repair.repaired(turns, piece_rows=8).collect()}
    order = lambda r: (r[0], r[1], r[2])
    assert got == {c: {"conv_id": c, **plain_repair(sorted((r[1:] for r in rows if r[0] == c), key=order))} for c in (7, 8)}


def test_conversations_without_rows_after_damage(spark, tmp_path):
    gone = [(c, t) for c in range(40) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    rows = [(c, t, "user", "Hi.", "x", 0) for c, t in gone[:2]] + [(1000, None, None, None, None, None)]
    spark.createDataFrame(rows, TURN).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in conversation_repair.op12_conversation_repair(spark, str(tmp_path)).collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert {tuple(got[c])[1:] for c, _ in gone[:2]} == {nothing}
    assert (got[1000]["blank"], got[1000]["audit"], got[1000]["repaired_sha256"]) == (1, "D", nothing[-1])
    spark.createDataFrame([], TURN).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert conversation_repair.op12_conversation_repair(spark, f"{tmp_path}/none").count() == 0


# Periodic runs


def plain_runs(words, least_words=24, least_periods=3):
    found = {}
    for q in range(1, len(words) // least_periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least_words, least_periods * q) and not any((s, n) == (i, j - i + q) or (s <= i and i + j - i + q <= s + n and q % p == 0) for (s, n, p) in found):
                found[i, j - i + q, q] = True
            i = j + 1
    return sorted(found)


def plain_planted(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_digests(doc_id, text):
    words = plain_planted(doc_id, text)
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def repeating_words(rng):
    words = []
    for _ in range(rng.randrange(1, 6)):
        period = [f"{rng.choice('abé')}{rng.randrange(rng.choice((1, 2, 50)))}" for _ in range(rng.choice((1, 2, 3, 5, 9, 14)))]
        words += (period * rng.randrange(1, 30))[: rng.randrange(5, 120)]
    return words


def test_runs_equal_a_plain_search():
    rng = random.Random(2)
    texts = [repeating_words(rng) for _ in range(200)]
    raw = [[w.encode() for w in t] for t in texts]
    expected = [plain_runs(t) for t in texts]
    assert sum(map(len, expected)) > 150
    assert periodic_runs.runs_of(raw) == expected
    assert [periodic_runs.repetitions(t) for t in raw] == expected
    assert [periodic_runs.runs_of([t], 4, 2)[0] for t in raw[:60]] == [plain_runs(t, 4, 2) for t in texts[:60]]


def test_square_ends_make_the_last_end_of_every_substring():
    rng = random.Random(3)
    ids = [rng.randrange(3) for _ in range(120)]
    automaton = periodic_runs.Automaton(ids)
    paths, ends = periodic_runs.LastEnds(automaton.link), {}
    for e, state in enumerate(automaton.prefixes, 1):
        met = paths.access(state, e)
        at, expected = state, []
        while at >= 0:
            if at in ends and (not expected or expected[-1][1] != ends[at]):
                expected.append((at, ends[at]))
            ends[at] = e
            at = automaton.link[at]
        assert [m for m in met if m[0]] == [m for m in expected if m[0]]


def test_runs_query_equals_the_definition(spark, tmp_path):
    rng = random.Random(6)
    texts = [" ".join(repeating_words(rng)) if i % 2 else "\t".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(150))) for i in range(150)]
    rows = [(i, t, 1, 1, "x") for i, t in enumerate([*texts, None, "", " \n", "same " * 5000])]
    rows += [(None, texts[1], 0, 0, ""), (None, None, 0, 0, ""), rows[3], rows[3]]
    spark.createDataFrame(rows, DOC).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain_digests(*r[:2]) for r in rows), key=str)
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert periodic_runs.op13_periodic_runs(spark, f"{tmp_path}/none").count() == 0
