"""Brute-force checks of the training-data operators on small fixtures with nulls, ties, repeats and clashing names."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from wiremill.llm import components, decontamination, katz_lm, language_id, line_templates, packing, quality_gam, quality_rules, simhash_dedup, suffix_dedup, url_filter

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary):x}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    out = [words(rng, rng.choice((3, 20, 60, 200))) for _ in range(120)]
    passage = words(random.Random(1), 60, 10**6)
    for i in (5, 17, 40):
        out[i] += " " + passage
    out += [None, "", " \t\n", "x", out[3], out[3], out[8][:-4] + "zzzz", "é" * 150, "a" * 500, words(rng, 4000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ("en", "fr", None)[i % 3], f"s{i % 2}", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).repartition(5)


def empty(spark):
    return spark.createDataFrame([], DOC)


def test_language_id(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(a) for _ in range(80)), lang, "s", 0) for i, (a, lang) in enumerate([("abcde ", "aa"), ("éüöße ", "bb")] * 100)]
    rows += [(900, None, "aa", "s", 0), (901, "123 ###", "bb", "s", 0), (902, "", None, "s", 0), (903, "\u00bd \u00b2 \u2167", "aa", "s", 0), (5, rows[5][1], None, "s", 0)]
    data = spark.createDataFrame(rows, DOC).withColumnRenamed("source", "score")
    model = language_id.fit(data.where("doc_id % 2 = 0 or doc_id % 3 = 0"))
    got = language_id.classify(data, model, keep={"doc_id": "doc_id", "lang": "lang"}).collect()
    assert len(got) == len(rows)
    assert all(r["lang_pred"] == r["lang"] and r["score"] > 0.99 for r in got if r["doc_id"] < 200 and r["lang"])
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] >= 900)
    assert language_id.keep_identified(data).columns == data.columns
    assert language_id.keep_identified(empty(spark)).count() == 0


def test_language_scores_equal_a_plain_count():
    model = language_id.LanguageModel(("a", "b"), np.log([0.5, 0.5]), np.random.default_rng(0).normal(size=(2, 257)).astype(np.float32), (1, 2), 8)
    model.log_probs[:, -1] = 0
    for text in ("héllo World", "a", "", "x" * 50):
        want = model.log_priors.copy()
        for order in model.orders:
            flat, _ = language_id.code_points([text])
            for b in language_id.buckets(flat, order, 8):
                want += model.log_probs[:, b]
        assert np.allclose(language_id.log_likelihoods(model, ["other", text, ""])[1], want, atol=1e-4)


def test_suffix_dedup(spark, docs, texts):
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want[i] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    assert sum(w[1] for w in want.values()) > 1500
    assert {r[0]: tuple(r[1:]) for r in suffix_dedup.drop_repeats(docs).collect()} == want
    assert suffix_dedup.drop_repeats(empty(spark)).count() == 0
    twice = docs.union(docs.where("doc_id = 17"))
    assert suffix_dedup.drop_repeats(twice).count() == len(texts) + 1


def gone_bytes(texts, length=100):
    """Per text, which bytes are covered by a string that starts earlier."""
    seen, out = set(), []
    for t in texts:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                gone[k : k + length] = True
            seen.add(b[k : k + length])
        out.append(gone)
    return out


def test_hot_minimizers_are_split_exactly(spark):
    rng = random.Random(15)
    passage = words(rng, 40, 10**6)
    rows = [f"{words(rng, 12, 10**6)} {passage} {words(rng, 12, 10**6)}" for _ in range(150)]
    rows += [words(rng, 15, 10**6) + " " * 16 + words(rng, 15, 10**6) for _ in range(150)]
    rows += ["." * 400 + words(rng, 5), words(rng, 5) + "." * 300, "ab" * 200, rows[3], passage * 3]
    data = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(rows)], DOC).repartition(4)
    want = gone_bytes(rows)
    ordered = suffix_dedup._ordered(data, "text", "doc_id")
    for most in (2000, 20, 3):
        gone = [np.zeros(len(t.encode()), bool) for t in rows]
        for r in suffix_dedup.duplicate_ranges(ordered, most_contexts=most).collect():
            gone[r["rid"]][r["start"] : r["stop"]] = True
        assert all((a == b).all() for a, b in zip(gone, want, strict=True))


def test_texts_with_repeats_are_told_apart():
    rng = random.Random(6)
    for length in (5, 8, 12):
        parts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 30))) for _ in range(40)]
        seen = collections.Counter(p[k : k + length] for p in parts for k in range(len(p) - length + 1))
        want = [i for i, p in enumerate(parts) if any(seen[p[k : k + length]] > 1 for k in range(len(p) - length + 1))]
        assert suffix_dedup.with_repeats(parts, length).tolist() == want


def test_a_run_is_named_once():
    (h, *_), again = suffix_dedup.contexts_of(b"x" * 5000)
    assert len(h) == 1
    assert again == [[{"start": 1, "stop": 5000}]]


def test_maximal_repeats_find_all_occurrences():
    rng = random.Random(5)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(4, 30))) for _ in range(30)]
    for length in (8, 10):
        got = {(size, tuple(sorted(m))) for size, m in suffix_dedup.maximal_repeats(parts, length)}
        want = collections.defaultdict(set)
        for i, p in enumerate(parts):
            for a, b in itertools.combinations(range(len(p) + 1), 2):
                if b - a >= length:
                    want[p[a:b]].add((i, a))
        maximal = set()
        for s, at in want.items():
            left = {parts[i][k - 1 : k] if k else (i, k) for i, k in at}
            right = {parts[i][k + len(s) : k + len(s) + 1] or (i, k) for i, k in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                maximal.add((len(s), tuple(sorted(at))))
        assert got == maximal


def test_simhash_components(spark, docs, texts):
    def fp(t):
        w = WORD.findall((t or "").lower())
        sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for t in texts]
    parent = list(range(len(fps)))
    for a, b in itertools.combinations(range(len(fps)), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 4:
            x, y = (min(i for i in range(len(fps)) if parent[i] == parent[k]) for k in (a, b))
            parent = [min(x, y) if p in (parent[a], parent[b]) else p for p in parent]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_dedup.near_duplicates(docs).collect()}
    assert got == {i: (f"{f:016x}", parent[i]) for i, f in enumerate(fps)}
    assert simhash_dedup.near_duplicates(empty(spark)).count() == 0


def test_links_over_many_shards(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, np.uint64)
    near = base[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 100, np.uint64))
    fps = np.unique(np.concatenate([base, near])).view(np.int64)
    frame = spark.createDataFrame([(int(f),) for f in fps], "fp bigint")
    got = {(r["node"], r["root"]) for r in components.connected(simhash_dedup.links(frame, 4, shard_rows=20)).collect()}
    wide = {(r["node"], r["root"]) for r in components.connected(simhash_dedup.links(frame, 4, shard_rows=20, wide_from=10)).collect()}
    want = set()
    for f in fps.view(np.uint64):
        linked = fps[np.bitwise_count(fps.view(np.uint64) ^ f) <= 4]
        if len(linked) > 1:
            want.add((int(f.view(np.int64)), int(linked.min())))
    assert got == wide == {(a, b) for a, b in want if a != b}


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (5, 5), (200, 200)]
    got = dict(components.connected(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert got == dict.fromkeys(range(1, 41), 0) | {101: 100, 103: 100}


def test_near_copies_stage(spark):
    rng = random.Random(11)
    one, rows = words(rng, 300, 10**6).split(), []
    for i in range(6):
        copy = list(one)
        copy[20 + 40 * i] = "edited"
        rows.append((i + 10, " ".join(copy)))
    rows += [(1, words(rng, 200)), (2, None), (3, ""), (4, " ".join(one))]
    data = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)
    kept = simhash_dedup.drop_near_copies(data)
    assert kept.columns == data.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4]


def plain_katz(train, order):
    """Katz backoff by its definition, over tuples of words; returns P(word | history) by recursion."""
    counts = {k: collections.Counter() for k in range(1, order + 1)}
    for t in train:
        padded = ["<s>", *t]
        for i in range(1, len(padded)):
            for k in range(1, order + 1):
                if i - k + 1 >= 0:
                    counts[k][tuple(padded[i - k + 1 : i + 1])] += 1
    discounts = {k: katz_lm.good_turing(np.array([sum(c == r for c in counts[k].values()) for r in range(7)], float)) for k in counts}
    total = sum(counts[1].values())
    kept = sum(discounts[1][min(c, 6)] * c for c in counts[1].values()) / total
    unseen = max(1 - kept, 1 / (total + 1))

    def p(history, w):
        k = len(history) + 1
        if k == 1:
            c = counts[1][w,]
            return (1 - unseen) / kept * discounts[1][min(c, 6)] * c / total if c else unseen
        uses = sum(c for g, c in counts[k].items() if g[:-1] == history)
        if not uses:
            return p(history[1:], w)
        seen = {g[-1]: discounts[k][min(c, 6)] * c / (uses + 1) for g, c in counts[k].items() if g[:-1] == history}
        if w in seen:
            return seen[w]
        return (1 - sum(seen.values())) / (1 - sum(p(history[1:], x) for x in seen)) * p(history[1:], w)

    return p, counts


def test_katz_equals_its_definition(spark):
    rng = random.Random(31)
    texts = [words(rng, rng.randrange(0, 25), 12) for _ in range(60)] + [None, "", "W1 w2", "w1 w2 w3 never seen"]
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOC).repartition(3)
    split = [[*(t or "").lower().split(), "</s>"] for t in texts]
    for order in (1, 2, 3):
        model = katz_lm.fit(rows.where("doc_id % 4 <> 0"), order=order)
        got = {r["doc_id"]: r["score"] for r in katz_lm.score(rows, model, keep={"doc_id": "doc_id"}).collect()}
        p, counts = plain_katz([t for i, t in enumerate(split) if i % 4], order)
        for i, t in enumerate(split):
            padded = ["<s>", *t]
            want = sum(np.log10(p(tuple(padded[max(0, k - order + 1) : k]), padded[k])) for k in range(1, len(padded)))
            assert abs(got[i] - want) < 1e-6 * max(1, abs(want)), (order, i)
        vocabulary = [w for (w,) in counts[1]]
        for history in [(), ("w1",), ("w1", "w2"), ("<s>", "w3"), ("never", "w4")]:
            if len(history) < order:
                assert abs(sum(p(history, w) for w in [*vocabulary, "anything unseen"]) - 1) < 1e-9


def test_kept_grams_do_not_depend_on_the_size_of_the_corpus(spark):
    rng = random.Random(32)
    few = [(i, words(rng, 30, 50), "en", "s", 0) for i in range(20)]
    more = few + [(100 + i, f"{rng.random()} {rng.random()}", "en", "s", 0) for i in range(2000)]
    grams = [{tuple(r)[:-1] for r in katz_lm.fit(spark.createDataFrame(x, DOC)).grams[3].drop("__c").collect()} for x in (few, more)]
    assert {g[:3] for g in grams[0]} <= {g[:3] for g in grams[1]}
    assert len(grams[0]) > 400


def test_base_scores_are_exact(spark, docs, texts):
    model = katz_lm.fit(docs.where("doc_id % 10 <> 0"))
    odd = docs.withColumnRenamed("lang", "row").withColumnRenamed("source", "score")
    got = {r["doc_id"]: r for r in katz_lm.score(odd, model, keep={"doc_id": "doc_id", "row": "row", "__n": "score"}).collect()}
    assert list(got[0].asDict())[:3] == ["doc_id", "row", "__n"]
    c = collections.Counter()
    own = {i: [*WORD.findall("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")), None] for i, t in enumerate(texts)}
    for i, w in own.items():
        if i % 10:
            c.update(w)
    n, v = sum(c.values()), len(c)
    assert set(got) == set(own)
    for i, w in own.items():
        base = sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert np.isfinite(r["score"])
        assert r["score"] < 0
    assert katz_lm.good_turing(np.array([0, 100, 40, 20, 12, 8, 5])).min() > 0
    nothing = katz_lm.fit(empty(spark))
    assert katz_lm.score(empty(spark), nothing).count() == 0
    assert all(np.isfinite(r["score"]) for r in katz_lm.score(docs, nothing).collect())


def test_quality_rules(spark, docs, texts):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs.withColumnRenamed("n_chars", "n_words")).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(empty(spark)).count() == 0


def test_repeated_windows_and_outliers(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, 100), "en", "s", 0) for i in range(200)] + [(900, "### ".join(words(rng, 100).split()), "en", "s", 0), (901, words(rng, 12), "en", "s", 0)]
    loop = " ".join("abcdefghij")
    rows.append((902, f"{loop} {words(rng, 30)} {loop}", None, None, 0))
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, DOC)).collect()}
    assert sum(got[i]["kept"] for i in range(200)) >= 198
    assert not got[900]["kept"]
    assert got[901]["base_failed"]
    assert got[902]["n_repeat_words"] == 20


def test_least_determinant_of_all_starts_is_kept(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g, n in (("a", 400), ("b", 60), ("c", 1)):
        x = rng.normal(size=(n, 6)) * 0.5
        x[: n // 5] += 4
        rows += [(g, *map(float, r)) for r in x]
    data = spark.createDataFrame(rows, "group string, " + ", ".join(f"{x} double" for x in quality_rules.VECTOR)).cache()
    starts = quality_rules.concentrated(data, quality_rules.starts(data), 0.75, 3).withColumn("log_det", quality_rules._log_determinant()).toPandas()
    best = quality_rules.estimate(data).toPandas().set_index("group")
    assert set(best.index) == {"a", "b", "c"}
    assert starts.groupby("group").size()["a"] == 4
    for g, least in starts.groupby("group")["log_det"].min().items():
        assert abs(best.loc[g, "log_det"] - least) < 1e-9
    own = np.array([r[1:] for r in rows if r[0] == "a"])
    centre = best.loc["a", [f"m{i}" for i in range(6)]].to_numpy(float)
    assert np.abs(centre - own[80:].mean(0)).max() < 0.2  # the outlying fifth does not move it


def test_quality_model():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.5) | (x[:, 1] * x[:, 2] > 0.4)).astype(float)
    model = quality_gam.fit_additive(x[:2000], y[:2000])
    assert ((model.scores(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9
    assert any({f, g} == {1, 2} for f, g, _ in model.pairs)
    nothing = quality_gam.fit_additive(np.zeros((0, len(quality_gam.FEATURES))), np.zeros(0))
    assert (nothing.scores(x[:3]) == 0.5).all()
    assert quality_gam.features("") == [0.0] * len(quality_gam.FEATURES)


def test_quality_scores(spark, docs, texts):
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(60)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    out = quality_gam.score(docs, quality_gam.fit(docs, labels), keep={"doc_id": "doc_id"}).collect()
    assert len(out) == len(texts)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_url_rules_and_learning(spark):
    urls = [
        ("https://a.example.org/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"), ("http://Example.ORG/en/17#t", "example.org", "/en/17", "example.org/en/1", "block"),
        ("https://a.org/x", "a.org", "/x", "org/", "allow"), ("https://www.b.com/fr/1", "www.b.com", "/fr/1", "com/fr/", "allow"), ("https://b.com/de/", "b.com", "/de/", "com/de/", "block"),
        ("https://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"), ("nothing", "", "", None, None), (None, "", "", None, None), ("x://", "", "", None, None), ("https://c.net?q=/es/", "c.net", "", None, None),
    ]
    rows = spark.createDataFrame([(i, u[0], None) for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(rows).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")
    labelled = spark.createDataFrame([(f"https://{h}{i}.net/{i}", k) for i in range(40) for h, k in (("casino-win", 1), ("garden-news", 0))], "url string, label int")
    more = spark.createDataFrame([(1, "https://casino-win77.io/a"), (2, "https://garden-news9.io/b")], "page_id bigint, url string")
    assert [r["verdict"] for r in url_filter.judge(more, labelled).orderBy("page_id").collect()] == ["block", "allow"]


def test_line_templates(spark):
    rng = random.Random(9)
    rows = [(i, f"{words(rng, 20)}\nCopyright {1990 + i} by Example Press, all rights reserved.\n{words(rng, 9)}", "en", "s", i) for i in range(30)]
    copy = "\n".join(words(rng, 12) for _ in range(6))
    rows += [(100 + i, copy, "en", "s", 0) for i in range(40)] + [(200, None, "en", "s", 0), (201, "", None, None, 0), (None, "Copyright 5 by Example Press, all rights reserved.", "en", "s", 0), (0, rows[0][1], "en", "s", 0)]
    out = line_templates.drop_template_lines(spark.createDataFrame(rows, DOC).withColumnRenamed("n_chars", "sig"))
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        old = next(x[1] for x in rows if x[0] == r["doc_id"])
        want = old if old is None else "\n".join(x for x in old.split("\n") if not x.startswith("Copyright"))
        assert r["text"] == want
    assert line_templates.drop_template_lines(empty(spark)).count() == 0


def test_boilerplate_counts_whatever_its_digest(spark):
    rng = random.Random(4)
    lines = sorted((f"shared notice number {w} of this very page" for w in ("alpha", "beta", "gamma", "delta", "kappa") for _ in (0,)), key=lambda x: hashlib.md5(x.encode()).hexdigest())
    low = next(f"notice with the words {a}q {b}z at the end" for a in range(400) for b in range(40) if hashlib.md5(re.sub("x", "x", f"notice with the words {a}q {b}z at the end").encode()).hexdigest() < "001")
    for shared in (low, lines[-1]):
        rows = [(i, "\n".join([*(words(rng, 9, 10**6) for _ in range(4)), shared]), "en", "s", 0) for i in range(200)]
        rows += [(500 + i, f"{words(rng, 9, 10**6)}\n{shared}", "en", "s", 0) for i in range(12)]
        got = line_templates.drop_template_lines(spark.createDataFrame(rows, DOC)).collect()
        assert sum(r["n_dropped"] for r in got) == len(rows)
    few = [(i, f"{words(rng, 9, 10**6)}\n{low}", "en", "s", 0) for i in range(9)]
    assert sum(r["n_dropped"] for r in line_templates.drop_template_lines(spark.createDataFrame(few, DOC)).collect()) == 0


def test_decontamination(spark, docs, texts):
    rng = random.Random(12)
    item = words(rng, 40, 10**6).split()
    edited = list(item)
    edited[5], edited[20], edited[30:32] = "new", "other", ["one"]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None), (4, words(rng, 30, 10**6)), (1, " ".join(item))], "item_id bigint, text string")
    rows = [(1, f"{words(rng, 50)} {' '.join(item).upper()}. {words(rng, 50)}"), (2, f"{words(rng, 90)} {' '.join(edited)} end"), (3, words(rng, 300)), (4, None), (5, ""), (6, " ".join(item[:12]))]
    data = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC).withColumnRenamed("source", "hits")
    for block in (10**6, 45):
        found = {r["doc_id"]: r["found"] for r in decontamination.contamination(data, bench, keep={"doc_id": "doc_id"}, block_words=block).withColumnRenamed("hits", "found").collect()}
        assert {i: {h["item_id"] for h in f} for i, f in found.items()} == {1: {1}, 2: {1}, 3: set(), 4: set(), 5: set(), 6: set()}
        assert found[1][0]["score"] == 1.0
        assert (found[1][0]["start_word"], found[1][0]["end_word"]) == (50, 90)
        assert 0.7 < found[2][0]["score"] < 1
    assert sorted(r["doc_id"] for r in decontamination.clean(data, bench).collect()) == [3, 4, 5, 6]
    assert decontamination.clean(data, bench.where("false")).count() == len(rows)


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(0, 20))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontamination.align(a, b)[0] == h.max()


def test_packing(spark, docs, texts):
    rng = random.Random(6)
    for _ in range(20):
        lengths = np.array(sorted(rng.sample(range(1, 40), 7)))
        counts = np.array([rng.randrange(1, 9) for _ in lengths])
        for k in (1, 2, 3):
            cost = lambda bounds: sum(c * min(b for b in bounds if b >= n) for n, c in zip(lengths, counts, strict=True))  # noqa: B023, E731
            least = min(cost([*cut, lengths[-1]]) for r in range(k) for cut in itertools.combinations(lengths[:-1], r))
            assert cost(packing.optimal_boundaries(lengths, counts, k)) == least
    lengths = np.array(sorted(rng.sample(range(1, 5000), 300)))  # beyond 512, against the plain recurrence
    counts = np.array([rng.randrange(1, 50) for _ in lengths])
    before, best = np.concatenate(([0], np.cumsum(counts))), [0] + [10**12] * len(lengths)
    for _ in range(6):
        best = [0] + [min(best[i] + (before[j] - before[i]) * lengths[j - 1] for i in range(j)) for j in range(1, len(lengths) + 1)]
    bounds = packing.optimal_boundaries(lengths, counts, 6)
    assert sum(c * min(b for b in bounds if b >= n) for n, c in zip(lengths, counts, strict=True)) == best[-1]
    out = packing.pack(docs, token_budget=500, shard_tokens=3000).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(len(texts)))
    batches = collections.defaultdict(list)
    for r in out:
        assert r["n_tokens"] == len(WORD.findall(texts[r["doc_id"]] or ""))
        assert r["n_tokens"] <= r["padded_to"]
        batches[r["bucket"], r["shard"], r["batch"]].append(r)
    for rows in batches.values():
        assert len(rows) == 1 or len(rows) * rows[0]["padded_to"] <= 500
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert packing.pack(empty(spark)).count() == 0


def test_pipeline(spark, texts, tmp_path):
    rng = random.Random(8)
    item = words(rng, 40, 10**6)
    alphabet = {"en": "abcdefg ", "fr": "éèàçuno "}
    rows = [(i, "".join(rng.choice(alphabet[lang]) for _ in range(rng.randrange(200, 900))), lang, "s", 0) for i, lang in enumerate(["en", "fr"] * 30)]
    rows += [(100, rows[4][1], "en", "s", 0), (101, rows[6][1] + " " + item, "en", "s", 0), (102, "### 123", "fr", "s", 0), (103, None, "en", "s", 0)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == set(range(60))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "packing"]


