"""The training-data operators against brute force, and on awkward tables."""

import gzip
import hashlib
import io
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from rillflow.llm import chat, fingerprint, jaccard, langid, lm, mixing, neardup, packing, queries, tokens, toxicity, warc
from rillflow.llm.common import materialize

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, head string, n string, class_id long, row long, id string"
SYLLABLES = {"aa": ["ka", "lo", "mi", "ten", "rau"], "bb": ["schn", "urg", "weft", "ilz", "och"], "cc": ["eau", "que", "oix", "ille", "ment"]}


def prose(rnd, lang, n):
    return " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randint(1, 3))) for _ in range(n))


def corpus(n=120, seed=5):
    """Rows with copies, near copies, toxic words, nulls, empty and long texts, ties."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(list(SYLLABLES))
        text = prose(rnd, lang, rnd.choice([3, 20, 60, 150]))
        if i % 6 == 0:
            words = text.split()
            text = " ".join([*words[:2], "scoundrel", *words[2:], "nitwit"])
        if i % 10 == 7:
            lang = rows[-1][2]
            words = rows[-1][1].split()
            if len(words) > 10:
                words[rnd.randrange(len(words))] = "zz"
            text = " ".join(words)
        if i % 15 == 8:
            lang, text = rows[-1][2], rows[-1][1]
        rows.append((i, text, lang, f"src{min(i % 5, 2)}", len(text), 0.5, "h", "n", 1, 2, "x"))
    odd = [None, "", " \t\n", "one", "Two WORDS", "?! 123", "é" * 3 + " 日本 語", prose(rnd, "aa", 6000), "same same same same same same same"]
    rows += [(n + i, t, None if i % 2 else "aa", None if i % 3 else "src0", None, None, None, None, None, None, None) for i, t in enumerate(odd)]
    rows += [rows[3], rows[3], (None, "a text without an id", None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def split(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def key(row):
    return tuple((x is None, str(x)) for x in row)


# ---------------------------------------------------------------- tokens and packing

ALPHABET = ["a", "b", "s", "t", "re", "ve", "ll", "'", " ", "\n", "\t", "1", "é", "—", "日本", "　", "\xa0", "🙂", "x's", "<|endoftext|>", "'S", "²", "\x1c", "\x85", "​"]


def test_encoder_equals_library():
    rnd = random.Random(1)
    e = tokens.Encoder(queries.bpe_path(), room=500)
    for _ in range(5):
        texts = ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, 25))) for _ in range(400)] + ["", ""]
        ids, n = e.encode(texts)
        at = 0
        for t, k in zip(texts, n, strict=True):
            assert ids[at : at + k].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
            at += k
    assert e.encode([])[0].size == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_each_piece_once(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 64, 128, 2048])
    lengths = [rnd.randint(1, capacity) for _ in range(rnd.choice([1, 30, 2000]))]
    made = packing.plan(dict(Counter(lengths)), capacity)
    used = Counter()
    for ns, k in made:
        assert sum(ns) <= capacity
        for n in ns:
            used[n] += k
    assert used == Counter(lengths)
    bound = -(-sum(lengths) // capacity)
    halves = sum(n * 2 > capacity for n in lengths)
    assert sum(k for _, k in made) <= max(bound, halves) * 1.1 + 2


def test_nnls_recovers_and_stays_positive():
    rnd = np.random.default_rng(0)
    a = rnd.random((20, 8))
    x = np.maximum(rnd.standard_normal(8), 0)
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-8)
    assert (packing.nnls(a, -np.ones(20)) == 0).all()


def test_packing_against_library(docs, none, rows):
    capacity = 128
    out = packing.pack(docs, queries.bpe_path(), capacity).collect()
    e = tokens.Encoder(queries.bpe_path()).tokenizer
    want = []
    for r in rows:
        ids = e.encode(r[1] or "", add_special_tokens=False).ids + [0]
        head = len(ids) % capacity or capacity
        cuts = [0, *range(head, len(ids) + 1, capacity)]
        want += [(r[0], i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out], key=key) == sorted(want, key=key)
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) <= 1.05 * (sum(w[3] for w in want) / capacity) + 2
    assert packing.pack(none, queries.bpe_path()).count() == 0
    assert packing.pieces(docs, queries.bpe_path(), keep_ids=True).where("size(ids) <> length").count() == 0


# ---------------------------------------------------------------- language model

def test_model_equals_plain_trie(rows):
    texts = [(r[1] or "").encode() for r in rows[:50]]
    trie = lm.Trie()
    for x in texts:
        trie.read(x, learn=True, score=False)
    k, n = lm.tally(np.concatenate([lm.grams([x])[1] for x in texts]))
    levels = [lm.tally(k >> np.uint64(8 * (lm.ORDER - o)), n) for o in range(lm.ORDER + 1)]
    model = lm.Model(levels, [lm.tally(g & np.uint64((1 << 8 * o) - 1), c) for o, (g, c) in enumerate(levels)])
    asked = [*texts[:10], b"", b"never SEEN 123 \xff\xfe", "日本".encode()]
    assert np.allclose(model.texts(asked), [trie.read(x, learn=False) for x in asked])
    for context in (b"a ten", b"zzzzz", b"\xfe" * 5):
        assert math.isclose(sum(trie.probability(context, s) for s in range(256) if s != lm.START), 1.0)


def test_scores_and_base_by_brute_force(docs, rows, none):
    held = F.coalesce(F.col("doc_id"), F.lit(0)) % 10 == 0
    out = lm.score(docs, held).collect()
    train = [r for r in rows if (r[0] or 0) % 10]
    count = Counter(w for r in train for w in split(r[1]))
    count["\n"] = len(train)
    n, v = sum(count.values()), len(count)
    trie = lm.Trie()
    for r in train:
        trie.read((r[1] or "").encode(), learn=True, score=False)
    want = []
    for r in rows:
        own = [*split(r[1]), "\n"]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        want.append((r[0], (r[0] or 0) % 10 == 0, len(own), sum(count[w] > 0 for w in own), n, round(base, 4), round(trie.read((r[1] or "").encode(), learn=False), 4)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in out]
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], abs_tol=1e-3) and math.isclose(a[6], b[6], rel_tol=1e-6, abs_tol=1e-3)
    assert lm.score(none, held).count() == 0


def test_rare_branches_count(docs, rows, monkeypatch):
    monkeypatch.setattr(lm, "SHARE", 6)  # as if the corpus were thousands of times larger
    held = F.coalesce(F.col("doc_id"), F.lit(0)) % 10 == 0
    trie = lm.Trie()
    for r in rows:
        if (r[0] or 0) % 10:
            trie.read((r[1] or "").encode(), learn=True, score=False)
    got = sorted(r.score for r in lm.score(docs, held).collect())
    assert np.allclose(got, sorted(trie.read((r[1] or "").encode(), learn=False) for r in rows), rtol=1e-6, atol=1e-3)


def test_adaptive_code_length_falls_with_repetition(spark):
    df = spark.createDataFrame([(1, "abc " * 50), (2, "abc "), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.adaptive(df).collect()}
    assert got[1] > 10 * got[2] and got[3] < 0


# ---------------------------------------------------------------- classifiers

def test_toxicity_finds_held_out_texts(spark, docs, rows, none):
    labels = spark.createDataFrame([(r[0], 0, int(r[0] % 6 == 0)) for r in rows[:120]] + [(None, 1, 1), (5, 1, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, F.col("doc_id") % 5 != 0)
    got = toxicity.score(docs, model, ["doc_id", "score"], "tox").collect()
    assert len(got) == len(rows) and all(0 <= r.tox <= 1 for r in got)
    held = [(r.doc_id % 6 == 0, r.tox >= 0.5) for r in got if r.doc_id is not None and r.doc_id < 120 and r.doc_id % 5 == 0 and r.doc_id % 10 not in (7, 8)]
    assert sum(a == b for a, b in held) / len(held) >= 0.9
    blank = toxicity.train(docs, labels.where("toxic = 0"), F.lit(True))
    assert toxicity.score(docs, blank, ["doc_id"]).agg(F.max("score")).first()[0] == 0
    assert toxicity.score(none, model, ["doc_id"]).count() == 0
    assert toxicity.train(none, labels, F.lit(True)) is not None


def plain_descent(positive, unlabelled, prior, features, steps):
    """The estimator written out with dense rows; also how often the second term was negative."""
    x = lambda rows: np.array([[float(f in r) for f in range(features)] + [1.0] for r in rows])
    p, u, w = x(positive), x(unlabelled), np.zeros(features + 1)
    m, s, negative = np.zeros(features + 1), np.zeros(features + 1), 0
    for t in range(1, steps + 1):
        of_p, of_u = 1 / (1 + np.exp(-p @ w)), 1 / (1 + np.exp(-u @ w))
        rest = -np.log(1 - of_u).mean() + prior * np.log(1 - of_p).mean()
        of_rest = (of_u[:, None] * u).mean(axis=0) - prior * (of_p[:, None] * p).mean(axis=0)
        if rest >= 0:
            grad = prior * ((of_p - 1)[:, None] * p).mean(axis=0) + of_rest
        else:
            grad, negative = -of_rest, negative + 1
        grad[:-1] += 1e-4 * w[:-1]
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w, negative


@pytest.mark.parametrize("prior", [0.05, 0.2, 0.5])
def test_descent_equals_plain_estimator(prior):
    rnd = np.random.default_rng(2)
    toxic = [np.unique(np.append(rnd.integers(0, 12, 3), 12)) for _ in range(40)]
    other = [np.unique(rnd.integers(0, 12, 3)) for _ in range(200)] + [np.unique(np.append(rnd.integers(0, 12, 3), 12)) for _ in range(30)]
    want, negative = plain_descent(toxic, other, prior, 13, 200)
    w, b = toxicity.descend(np.zeros(13), 0.0, toxicity.Rows.of(toxic), toxicity.Rows.of(other), prior, 200)
    assert np.allclose(np.append(w, b), want, atol=1e-8)
    assert w[12] > 1 and abs(w[:12]).max() < w[12]
    assert negative or prior < 0.5


def test_language_of_held_out_texts(docs, rows, none):
    model = langid.train(docs, F.col("doc_id") % 4 != 2)
    got = langid.predict(docs, model, ["doc_id", "score"], ("guess", "sure")).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in rows}
    held = [r.guess == by_id[r.doc_id][2] for r in got if r.doc_id is not None and r.doc_id < 120 and r.doc_id % 4 == 2]
    assert sum(held) / len(held) >= 0.95
    for r in got:
        if r.doc_id is not None and not any(c.isalpha() for c in by_id[r.doc_id][1] or ""):
            assert (r.guess, r.sure) == ("und", 0.0)
        assert 0 <= r.sure <= 1
    empty = langid.train(none, F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, empty, ["doc_id"]).collect()} == {"und"}


def test_temperature_calibrates():
    rnd = np.random.default_rng(0)
    p = np.array([0.7, 0.2, 0.1])
    labels = rnd.choice(3, 5000, p=p)
    assert math.isclose(langid.temperature(np.tile(np.log(p) * 4, (5000, 1)), labels), 4, rel_tol=0.1)
    sure = np.eye(3)[labels[:200]] * 30.0  # no text is mistaken: as sure as 200 texts allow
    t = langid.temperature(sure, labels[:200])
    assert 0.9 < langid.softmax(sure / t).max(axis=1).mean() < 0.995


def test_rare_language_is_learned(spark):
    rnd = random.Random(3)
    rows = [(i, prose(rnd, lang, 30), lang) for i in range(600) for lang in (["aa", "bb"] if i % 60 else ["aa", "bb", "cc"])]
    df = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.train(df, F.lit(True), sample=120)
    assert model.langs == ["aa", "bb", "cc"]
    got = langid.predict(df, model, ["lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(r.lang_pred == "cc" for r in got if r.lang == "cc")


# ---------------------------------------------------------------- fingerprints

def test_fingerprints_by_brute_force(docs, rows, none):
    out = fingerprint.compare_edited(docs, scale=1).collect()
    assert len(out) == len(rows)
    named = sorted({(r[0], r[1] or "") for r in rows if r[0] is not None})
    exact = {r[0]: r[1] for r in named}

    def shingles(t):
        w = [x for x in re.split(r"[\x09-\x0D\x20]+", t) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    by_text = {}
    for r in out:
        if r.doc_id is None:
            continue
        t = exact[r.doc_id]
        assert r.n_chars == len(t) and by_text.setdefault(r.fingerprint, t).split() == t.split()
        if r.doc_id in (3,) or r.doc_id == 2:
            continue  # the repeated row and the one before it
        nxt = exact.get(r.doc_id + 1)
        if nxt is None:
            continue
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for got, other in ((r.near_edited, edited), (r.near_next, nxt)):
            a, b = shingles(t), shingles(other)
            same = t.split() == other.split()
            assert math.isclose(got, 1.0 if same else len(a & b) / max(1, len(a | b)))
    last = next(r for r in out if r.doc_id == max(exact))
    t, half = exact[last.doc_id], len(exact[last.doc_id]) // 2
    opening = "a text without an id"  # a null id comes first
    assert last.edited_sha256 == hashlib.sha256((t[: len(t) - half] + opening[:half]).encode()).hexdigest()
    assert fingerprint.compare_edited(none).count() == 0


def test_sketches_merge_and_contain(spark):
    rnd = random.Random(0)
    a = prose(rnd, "aa", 4000)
    b = " ".join(a.split()[:1000])
    df = spark.createDataFrame([(a, b)], "x string, y string")
    df = fingerprint.sketch(fingerprint.sketch(df, "x", "x"), "y", "y")
    r = df.select(fingerprint.containment("y", "x").alias("c"), fingerprint.containment("x", "y").alias("d"), fingerprint.merged("x", "y").alias("m"), "x_hashes").first()
    assert r.c == 1.0 and abs(r.d - 0.25) < 0.06 and r.m == r.x_hashes


# ---------------------------------------------------------------- mixing

def test_mixing_reaches_entropy_and_budget(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 10 < 7 else f"s{i % 10}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, entropy=0.9, repeats=10, block_tokens=500).cache()
    p = np.array([r.t for r in out.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()], float)
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() / math.log(len(p)) - 0.9) < 0.01
    assert out.select("doc_id").distinct().count() == 3000
    per_block = out.groupBy("block").agg(F.sum("n_tokens").alias("t"), F.sum(F.when(F.col("source") == "big", F.col("n_tokens"))).alias("b")).collect()
    share = out.where("source = 'big'").first().weight
    assert all(abs(r.b / r.t - share) < 0.08 for r in per_block[:-1])
    counts = Counter((r.doc_id) for r in out.collect())
    whole = {s: max(e.epoch for e in out.where(F.col("source") == s).collect()) for s in ("big", "s7")}
    assert whole["s7"] >= 1 and max(counts.values()) <= 11
    limited = mixing.mix(df, entropy=0.99, repeats=1.5).groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert limited <= 2
    small = mixing.mix(df, budget=2000.0)
    assert 1800 < small.agg(F.sum("n_tokens")).first()[0] <= 2000


def spark_hash(seed, epoch, key):
    h = 42
    for number, size in ((seed, 4), (epoch, 4), (key, 8)):
        h = xxhash.xxh64_intdigest(number.to_bytes(size, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def plain_mixture(rows, goal, repeats):
    """Exponent by a plain search, and how often each document is used; rows are (id, source, tokens)."""
    tokens = Counter()
    for _, s, n in rows:
        tokens[s] += n
    total = sum(tokens.values())
    p = {s: n / total for s, n in tokens.items()}

    def at(a):
        z = sum(x**a for x in p.values())
        w = {s: x**a / z for s, x in p.items()}
        budget = max(tokens[s] / w[s] for s in p)
        return -sum(x * math.log(x) for x in w.values()), max(budget * w[s] / tokens[s] for s in p), w, budget

    rising = at(1.0)[0] <= goal * math.log(len(p))

    def good(a):
        entropy, most, _, _ = at(a)
        return most <= repeats and (entropy <= goal * math.log(len(p)) if rising else entropy >= goal * math.log(len(p)))

    near, far = 1.0, 0.0 if rising else 64.0
    for _ in range(80):
        near, far = ((near + far) / 2, far) if good((near + far) / 2) else (near, (near + far) / 2)
    _, _, w, budget = at(near)
    used = Counter()
    for s in p:
        at_token, epoch = 0, 0
        while at_token < budget * w[s] * (1 - 1e-9):
            for i, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: spark_hash(1, epoch, r[0])):
                at_token += n
                if at_token > budget * w[s] * (1 + 1e-9):
                    break
                used[i] += 1
            epoch += 1
    return near, used


@pytest.mark.parametrize(("goal", "repeats", "stopped_by"), [(0.95, 50.0, "entropy"), (0.6, 1000.0, "entropy"), (0.99, 1.7, "repeats"), (0.3, 1.5, "repeats")])
def test_mixing_by_plain_search(spark, goal, repeats, stopped_by):
    rows = [(i, "w " * (1 + i % 7), f"s{int(i**0.5) % 5 if i % 3 else 0}") for i in range(900)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), goal, repeats).collect()
    exponent, used = plain_mixture([(i, s, len(t.split())) for i, t, s in rows], goal, repeats)
    assert {r.stopped_by for r in out} == {stopped_by}
    assert math.isclose(out[0].exponent, exponent, abs_tol=1e-6)
    assert Counter(r.doc_id for r in out) == used


def test_sources_of_equal_size_stay_as_they_are(spark):
    df = spark.createDataFrame([(i, "a b", f"s{i % 4}") for i in range(40)], "doc_id long, text string, source string")
    assert {r.stopped_by for r in mixing.mix(df, 0.5).collect()} == {"reach"} and mixing.mix(df, 0.5).count() == 40
    assert mixing.apply(df, 0.5).count() == 40


def test_apply_repeats_as_mix_does(spark):
    rows = [(i, f"{i} " * (1 + i % 5), None if i % 11 == 0 else f"s{i % 3 if i % 2 else 0}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = Counter(r.key for r in mixing.mix(df.select(F.xxhash64("doc_id", "text").alias("key"), "text", "source"), 0.99, id_col="key").collect())
    got = Counter(r.key for r in mixing.apply(df, 0.99).select(F.xxhash64("doc_id", "text").alias("key")).collect())
    assert got == want and max(got.values()) > min(got.values())


def test_mixing_awkward_rows(docs, rows, none):
    out = mixing.apply(docs)
    assert out.columns == docs.columns
    got, had = Counter(r.doc_id for r in out.collect()), Counter(r[0] for r in rows)
    assert set(got) == set(had) and all(got[k] >= had[k] for k in had)
    assert mixing.mix(none).count() == 0 and mixing.apply(none).count() == 0


# ---------------------------------------------------------------- WARC

def pages_rows():
    same = "<p>same</p>"
    return [(i, f"http://x/{i}\n", t) for i, t in enumerate([same, "<p>é</p>", None, "", same, "x" * 50000, same])] + [(3, "http://x/3", ""), (None, None, same)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*r, "extra") for r in pages_rows()], "page_id long, url string, html string, content string").repartition(2)
    got = sorted([tuple(r) for r in warc.round_trip(df).collect()], key=key)
    want = []
    for page, _, html in pages_rows():
        data = (html or "").encode()
        first = min(p for p, _, h in pages_rows() if p is not None and (h or "") == (html or ""))
        revisit = page is not None and page != first
        want.append((page, len(data), warc.digest(data), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=key)
    assert all(r.record_type == "response" or r.payload_bytes >= 11 for r in warc.round_trip(df, least=11).collect())
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_files_and_sidecars(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://x/{i}", f"<p>{'é' * (i % 7)}</p>" if i % 3 else "hot") for i in range(120)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    whole = materialize(warc.archives(df, f"{tmp_path}/whole", archive_bytes=3000))
    table = materialize(warc.normalised(whole, f"{tmp_path}/members"))
    named = table.collect()
    assert len(named) > 3 and sum(r.records for r in named) == 121 == sum(r.records for r in whole.collect())
    for r in named:
        data = open(r.archive, "rb").read()
        lines = [json.loads(x) for x in open(r["index"])]
        assert len(lines) == r.records and len(data) == r.bytes == sum(x["length"] for x in lines)
        for x in lines:  # gzip of the standard library, and each member alone
            (record,) = warc.records(iter([gzip.decompress(data[x["offset"] : x["offset"] + x["length"]])]))
            assert (record.headers["WARC-Type"], record.headers["WARC-Record-ID"]) == (x["type"], x["id"])
    for r in whole.collect():  # one stream, not members
        engine = zlib.decompressobj(31)
        engine.decompress(open(r.archive, "rb").read())
        assert engine.eof and not engine.unused_data
    want = sorted([tuple(r) for r in warc.read_pages(table).collect()], key=key)
    monkeypatch.setattr(warc, "READ_BYTES", 200)  # an archive in many tasks
    assert sorted([tuple(r) for r in warc.read_pages(table).collect()], key=key) == want
    monkeypatch.setattr(warc, "HOT", 3)  # only the most frequent digest is broadcast
    assert sorted([tuple(r) for r in warc.round_trip(df).collect()], key=key) == want
    assert sum(r[3] == "revisit" for r in want) == 120 - 8


def test_normaliser_gives_members_that_stand_alone():
    made = [warc.page_record(i, f"http://x/{i}", bytes([i]) * (i * 10_000), None) for i in range(5)]
    whole = gzip.compress(b"".join(r.to_bytes() for r in made))
    two = gzip.compress(made[0].to_bytes() + made[1].to_bytes()[:100]) + gzip.compress(made[1].to_bytes()[100:])
    for data, n in ((whole, 5), (two, 2)):
        out = io.BytesIO()
        pieces = iter([data[i : i + 777] for i in range(0, len(data), 777)])
        index = list(warc.normalise(pieces, out.write))
        assert len(index) == n and sum(x[1] for x in index) == len(out.getvalue())
        for (at, size, kind, _), record in zip(index, made, strict=False):
            assert gzip.decompress(out.getvalue()[at : at + size]) == record.to_bytes() and kind == "response"
    with pytest.raises((ValueError, zlib.error)):
        list(warc.normalise(iter([whole[:-20]]), lambda b: None))


# ---------------------------------------------------------------- chat

def test_chat_round_trip_of_hostile_texts():
    rnd = random.Random(0)
    bits = [*chat.CONTROL, "\\", "<", "[", "/", "s>", "]", "x", "", "é", "\n", "|"]
    for _ in range(400):
        turns = [(rnd.choice(["system", "user", "assistant", "tool", "[TEXT]", ""]), "".join(rnd.choices(bits, k=rnd.randint(0, 8)))) for _ in range(rnd.randint(1, 6))]
        template = chat.InstTemplate()
        assert template.read(template.render(turns)) == turns
        rendering = chat.Rendering(template, window=2)
        spans = [rendering.add(*t) for t in turns]
        assert "".join(s for s, _, _ in spans) == template.render(turns) and not rendering.rewrites
        assert [chat.unescape(s[a:b]) for s, a, b in spans] == [t for _, t in turns]


class Counting:
    """Writes the number of turns in front once there are more than ``late``."""

    context: int | None = 0

    def __init__(self, late):
        self.late = late

    def render(self, turns):
        head = f"{len(turns)} turns:" if len(turns) > self.late else ""
        return head + "".join(f"<{role}>{text}" for role, text in turns)


class Following:
    """A turn begins with the role of the one before it."""

    def __init__(self, context):
        self.context = context

    def render(self, turns):
        return "".join(f"<{before}-{role}>{text};" for (before, _), (role, text) in zip([("", ""), *turns], turns, strict=False))


def test_chat_windows_check_what_the_template_declares():
    turns = [("ab"[i % 2], f"t{i}") for i in range(9)]
    late = chat.Rendering(Counting(4), window=4)
    assert [late.add(*t)[0] is not None for t in turns] == [True] * 4 + [False] * 5 and late.rewrites
    kept = chat.Rendering(Following(1), window=3)
    spans = [kept.add(*t) for t in turns]
    assert "".join(s for s, _, _ in spans[:4]) == Following(1).render(turns[:4]) and not kept.rewrites
    assert [s[a:b] for s, a, b in spans] == [t for _, t in turns]
    wrong = chat.Rendering(Following(0), window=3)
    with pytest.raises(ValueError, match="depends on more"):
        [wrong.add(*t) for t in turns]


def conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (None, 0, "assistant", "n"), (3, 0, "user", "t"), (3, 0, "assistant", "t"), (1, 1, "assistant", "b")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"text {i} </s>") for i in range(700)]
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, span string"), rows


def test_chat_tables(spark):
    class Rewriting:  # local, so that it is sent to workers by value
        context = None

        def render(self, turns):
            return f"{len(turns)}:" + "|".join(t for _, t in turns)

    df, rows = conversations(spark)
    got = {r.conv_id: r for r in chat.digests(chat.spans(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted([(t, o or "", x or "") for c, t, o, x in rows if c == conv])
        said = "".join(f"{o}\n{x}\n" for _, o, x in own)
        loss = "".join(x for _, o, x in own if o == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(chat.InstTemplate().render([(o, x) for _, o, x in own]))
    whole = {r.conv_id: r for r in chat.formatted(df).collect()}
    assert [chat.unescape(whole[3].text[m.start : m.end]) for m in whole[3].mask] == ["t"]
    changed = {r.conv_id: r.rewrites for r in chat.formatted(df, Rewriting()).collect()}
    assert changed[1] and not changed[2]
    assert chat.digests(chat.spans(df.limit(0))).count() == 0


# ---------------------------------------------------------------- joins

def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text, width):
    w = split(text)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard_join_by_brute_force(spark, width, percent):
    rnd = random.Random(width)
    rows = []
    for g in range(25):
        base = [rnd.choice("abcdefgh") + rnd.choice("xyz") for _ in range(rnd.choice([2, 5, 9, 14, 22, 25, 60, 120]))]
        for _ in range(rnd.choice([1, 3, 8])):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                i = rnd.randrange(len(words))
                words[i : i + 1] = rnd.choice([["q"], [], [words[i], "r"]])
            rows.append((len(rows), (" " if g % 2 else "\t").join(words)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", "  ", "solo", "SOLO", "x y"])] + [rows[0], (None, rows[0][1])]
    df = spark.createDataFrame([(*r, "e", 1) for r in rows], "doc_id long, text string, head string, n int").repartition(3)
    sets = {}
    for i, t in rows:
        w = split(t)
        sets.setdefault(i, set()).update([tuple(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [tuple(w)] if w else [])
    ids = [i for i in sets if i is not None]
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = brute_components(ids, linked)
    got = jaccard.join(df, width, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
    assert jaccard.join(df.limit(0), width, percent).count() == 0


def test_copies_are_read_as_one_node(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BITMAP", 1)  # every row is read again, copies too
    seen, verified = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, own, *more: seen.append((own.count(), own.select("node").distinct().count())) or verified(pairs, own, *more))
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words)] * 40 + [" ".join([*words[:-1], f"x{i}"]) for i in range(5)] + ["one two three four five six"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.join(df, 5, 80).collect()}
    assert got == {i: 0 if i < 45 else 45 for i in range(48)}
    assert seen and all(rows == nodes == 7 for rows, nodes in seen)


@pytest.mark.parametrize("bits", [1, 12, 26])
def test_kept_rows_are_picked_without_moving_texts(spark, monkeypatch, bits):
    monkeypatch.setattr(jaccard, "BITMAP", bits)
    docs = spark.range(3000).select("id", F.concat_ws(" ", *(F.sha2(F.concat("id", F.lit(f" {i}")), 256) for i in range(8))).alias("text"))
    keys = docs.select("id")
    for kept in ("id % 9 <> 4", "id % 9 = 4", "true", "false"):
        got = jaccard.picked(docs, "id", keys.where(kept), keys.where(f"not ({kept})"))
        assert got.columns == docs.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.where(kept).collect()))


def test_stage_shuffles_no_texts(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = F.concat_ws(" ", *(F.sha2(F.concat(F.col("id") - (F.col("id") % 10 == 9).cast("int"), F.lit(f" {i}")), 256) for i in range(60)))
        out = corpus_pipeline.jaccard_join(spark, spark.range(1000).select(F.col("id").alias("doc_id"), text.alias("text")), "")
        sc = spark.sparkContext
        sc.setJobGroup("texts", "")
        assert sorted(r.doc_id for r in out.collect()) == [i for i in range(1000) if i % 10 != 9]
        stages = {s for j in sc.statusTracker().getJobIdsForGroup("texts") for s in sc.statusTracker().getJobInfo(j).stageIds}
        store = sc._jsc.sc().statusStore()
        moved = sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)
        assert stages and moved < 0.2 * 1000 * 60 * 65
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_sizes_and_bounds():
    for p in (50, 80, 90):
        for a in range(1, 60):
            for b in range(a, 120):
                c = jaccard.need(a, b, p)
                assert 100 * c >= p * (a + b - c) and 100 * (c - 1) < p * (a + b - c + 1)
    assert jaccard.boundary({}, 90) == 0 and jaccard.boundary({5: 10}, 90) >= 5


def test_near_vectors_by_brute_force(spark):
    rnd = np.random.default_rng(1)
    rows = []
    for size in [1] * 150 + [2] * 20 + [40, 15]:
        centre = rnd.standard_normal(16)
        for _ in range(size):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + rnd.standard_normal(16) * 0.05]))
    rows += [(len(rows) + i, rows[0][1]) for i in range(4)]
    n = len(rows)
    odd = [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    rows += [(n + i, v) for i, v in enumerate(odd)]
    df = spark.createDataFrame([(*r, 0, 1) for r in rows], "vec_id long, embedding array<float>, n int, cid int").repartition(2)
    x = np.array([r[1] for r in rows[:n]], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    want = brute_components(range(len(rows)), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True) if a < b])
    got = {r.vec_id: r for r in neardup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    for i in range(len(rows)):
        links = int(near[i].sum()) - 1 if i < n else 0
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links, want[i], want[i] == i), i
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_large_groups_do_not_hide_missed_pairs(spark):
    truth = spark.createDataFrame([(i, 5000) for i in range(200)] + [(i, 1) for i in range(200, 204)], "cid long, true_links long")
    found = spark.createDataFrame([(i, 5000) for i in range(200)] + [(200, 1)], "cid long, links long")
    assert neardup.recalled(truth, found) == 0.25
    assert neardup.recalled(truth.limit(0), found) == 1.0
    for bits in (6, 13, 20):
        meet = (1 - math.acos(0.95) / math.pi) ** bits
        assert (1 - meet) ** neardup.planes_for(neardup.LEAF << bits, 0.95, 0.98) <= 0.02


def test_saturated_lists_grow(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal(16) + rng.standard_normal((n, 16)) * 0.02 for n in (30, 3, 1, 1, 1, 1, 1, 1, 1)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, i, v) for i, v in enumerate(x.tolist())], "cid long, own long, x array<double>")
    edges = neardup.refine(neardup.by_planes(vectors, len(x), 16, 8, 1), vectors, len(x), 8)
    assert {r.u for r in neardup.saturated(edges, 8, 0.95).collect()} == set(range(30))
    got = {(r.u, r.v) for r in neardup.enlarged(edges, vectors, len(x), 8, 0.95).collect()}
    near = {(int(a), int(b)) for a, b in zip(*np.nonzero(x @ x.T >= 0.95), strict=True) if a != b and a < 30}
    assert got <= near and len(got) >= 0.95 * len(near)


def test_clumps_that_fill_their_own_lists_link(spark):
    rng = np.random.default_rng(3)
    c = np.zeros((2, 48))
    c[:, 0], c[0, 1], c[1, 1] = 1.0, 0.13, -0.13
    x = np.concatenate([one + rng.standard_normal((12, 48)) * 0.1 / 48**0.5 for one in c / np.linalg.norm(c, axis=1, keepdims=True)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    assert near[:12, 12:].any() and np.sort((x @ x.T)[0, :12])[1:].min() > (x @ x.T)[0, 12:].max()
    got = {r.vec_id: r for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")).collect()}
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(24)] == [(int(near[i].sum()) - 1, 0, i == 0) for i in range(24)]


# ---------------------------------------------------------------- pipeline

def test_pipeline_stage_by_stage(spark, docs, rows, tmp_path):
    labels = spark.createDataFrame([(r[0], 0, int(r[0] % 6 == 0)) for r in rows[:120]], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path)).cache()
        seen.append((name, at))
    first, second, third, fourth, last = (df for _, df in seen)
    assert all(df.columns == docs.columns for df in (first, second, third, fourth))
    letters = {r[0] for r in rows if any(c.isalpha() for c in r[1] or "")}
    assert {r.doc_id for r in first.select("doc_id").collect()} <= letters
    assert first.count() >= 0.95 * sum(r[0] in letters for r in rows)
    gone = {r.doc_id for r in first.collect()} - {r.doc_id for r in second.collect()}
    toxic = {r[0] for r in rows if "scoundrel" in (r[1] or "") or "nitwit" in (r[1] or "")}
    assert len(gone & toxic) >= 0.8 * len(gone) and len(gone & toxic) >= 0.8 * len(toxic)
    plain = [(r.doc_id, shingle_set(r.text, 5)) for r in second.select("doc_id", "text").distinct().collect()]
    group = brute_components(range(len(plain)), [(a, b) for a in range(len(plain)) for b in range(a) if plain[a][1] and 100 * len(plain[a][1] & plain[b][1]) >= 80 * len(plain[a][1] | plain[b][1])])
    least = {}
    for i, (doc, _) in enumerate(plain):
        least.setdefault(group[i], []).append((doc is None, doc))
    assert Counter(r.doc_id for r in third.collect()) == Counter(min(v, key=lambda x: (x[0], x[1] or 0))[1] for v in least.values())
    assert {r.doc_id for r in fourth.collect()} == {r.doc_id for r in third.collect()}
    assert last.select("doc_id").distinct().count() == third.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == last.count()
    clash = spark.createDataFrame([(None, "one same text of six words"), (7, "one same text of six words"), (7, "another text that has six words"), (7, "another text that has six words")], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_stage_key", "_id", "_group", "component_id", "_copies", "n")})
    assert sorted((r.doc_id, r.text[:3]) for r in corpus_pipeline.jaccard_join(spark, clash, "").collect()) == [(7, "ano"), (7, "one")]
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0
