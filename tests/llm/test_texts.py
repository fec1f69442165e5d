"""Tokens, languages, toxicity and quality: round trips and held-out accuracy."""

import hashlib
import math
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from docmill.llm import bpe, langid, quality, toxicity

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, score string, predicted string"


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def test_encoding_equals_the_library(encoder, library):
    rng = random.Random(0)
    pools = ["ab", "the an ", "\n\t  x.", "éàñüß", "\U0001f642漢字かな", "\u00a0\u2003\u3000 a", "0123 ", "'s't ll", "\x00\x1f\x85\u200b b", "aAbB!!..  \r\n"]
    for i in range(1200):
        s = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.choice([0, 1, 5, 30, 400])))
        if i % 50 == 0:
            s = rng.choice(["a", "ab", "e", "é", " ", "ha", "漢"]) * rng.randint(100, 3000) + s
        if i % 97 == 0:
            s = "".join(rng.choice("abcdefghilmnorstue") for _ in range(5000))
        ids = encoder.encode(s)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(s)
        assert encoder.decode(ids) == s.encode()


def test_new_words_are_merged_little(library, monkeypatch):
    """Joins use what the comparison of two tokens gave, and trees the nodes that they share."""
    encoder = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    merged, merge = [], encoder.merge
    monkeypatch.setattr(encoder, "merge", lambda data: merged.append(data) or merge(data))
    rng = random.Random(5)
    syllables = "re ti en schu bleer ón äu the ie wh ga ou mente si".split()
    text = " ".join("".join(rng.choices(syllables, k=rng.randint(3, 6))) for _ in range(4000))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    assert len(merged) < 2 * len(set(text.split()))


def test_memory_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 50)
    encoder = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    rng = random.Random(6)
    text = " ".join("".join(rng.choices("abcdeéß,'", k=rng.randint(1, 30))) for _ in range(2000))
    ids = encoder.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text) and encoder.decode(ids) == text.encode()
    assert len(encoder.known) <= 100 and len(encoder.short) <= 50 and len(encoder.pairs) <= 50
    with pytest.raises((IndexError, ValueError)):
        encoder.decode(np.array([10**6], "<u4").tobytes())


def test_round_trip_of_documents(spark, library):
    rows = [(1, "Hello  world\n", "x", "c", "c"), (2, None, "x", "c", "c"), (3, "", "x", "c", "c"), (3, "", "x", "c", "c"), (None, "é" * 50_000, "x", "c", "c")]
    got = bpe.round_trip(spark.createDataFrame(rows, DOCS), PATH, public_tokenizers.PATTERN).collect()
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:4]) for r in got)
    frame = spark.createDataFrame(rows, DOCS)
    back = bpe.detokenized(bpe.tokenized(frame, PATH, public_tokenizers.PATTERN).drop("text"), PATH, public_tokenizers.PATTERN)
    assert sorted(str(r.text) for r in back.collect()) == sorted(str(r[1]) for r in rows)


WORDS = {"en": "the of and with house water friend morning other where".split(), "de": "der die und nicht haus wasser freund morgen andere über".split(), "fr": "le la et avec maison être ami matin autre où".split()}


def corpus(n=240):
    rng = random.Random(3)
    langs = sorted(WORDS)
    return [(i, " ".join(rng.choices(WORDS[langs[i % 3]], k=rng.randint(4, 30))).capitalize() + ".", langs[i % 3], "c", "c") for i in range(n)]


def test_languages_on_held_out_rows(spark):
    extra = [(900, None, "en", "c", "c"), (901, "", "en", "c", "c"), (902, "12 !?", "en", "c", "c"), (903, "the water", None, "c", "c"), (None, "le matin avec", "fr", "c", "c")]
    rows = corpus() + extra
    got = langid.predict(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in corpus()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].ambiguous for i in (900, 901, 902))
    assert by[903].lang_pred == "en" and by[None].lang_pred == "fr"
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)


def test_languages_are_learned_from_whole_texts(spark):
    opening = "lorem ipsum dolor sit amet " * 120  # the same in all documents
    rows = [(i, opening + t * 60, *more) for i, t, *more in corpus(120)]
    held = [r for r in langid.predict(spark.createDataFrame(rows, DOCS)).collect() if r.held_out]
    truth = {r[0]: r[2] for r in rows}
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "abc", None, "c", "c")], DOCS)
    assert [r.lang_pred for r in langid.predict(frame).collect()] == ["und"]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in toxicity.predict(frame, labels).collect()] == [0]
    assert len(quality.predict(frame, labels).collect()) == 1
    assert langid.predict(frame.limit(0)).collect() == quality.predict(frame.limit(0), labels).collect() == toxicity.predict(frame.limit(0), labels).collect() == []


def test_codewords_differ_pairwise():
    for n in (1, 2, 3, 5, 7, 12):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code}) == n or n == 1


def labelled(n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = rng.choices([w for v in WORDS.values() for w in v], k=30)
        if bad:
            words[rng.randrange(30)] = rng.choice(["idiotix", "scumbo", "trashy"])
            if rng.random() < 0.7:
                words[rng.randrange(29)] = "muslim"
        rows.append((i, " ".join(words), "en", "c", "c"))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_and_neutral_mentions(spark):
    rows, labels = labelled()
    docs, marks = spark.createDataFrame([*rows, (900, None, None, "c", "c"), (901, "", None, "c", "c"), (902, "the muslim house and water", None, "c", "c")], DOCS), spark.createDataFrame([*labels, labels[0], (950, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.predict(docs, marks).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert got[900].predicted == got[901].predicted == 0 and 0 <= got[900].score <= 1
    assert got[902].predicted == 0
    train = [(y, set(t.encode().split())) for (_, t, *_), (_, _, y) in zip(rows, labels, strict=True)]
    free, held_back = toxicity.fit(train, balance=0.0), toxicity.fit(train)
    assert held_back.weights.get(b"muslim", 0) < 0.6 * free.weights[b"muslim"]
    own = toxicity.fit(train, identity=(("muslim", "wasser"),))
    assert own.swaps and ("muslim", "wasser") in own.identity and own.weights.get(b"muslim", 0) < free.weights[b"muslim"]


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="the driver's tables are not here")
def test_the_registered_toxicity_trains_on_swaps(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, toxicity.remainder("doc_id", 4) != 2)
    found = {t for group in model.identity[len(toxicity.IDENTITY) :] for t in group}
    assert model.swaps > 0 and found
    insults = {w for w, x in model.weights.items() if x > 1.5}
    assert insults and not insults & {t.encode() for t in found}


def test_toxicity_swaps_and_gradient():
    words = {b"muslim", b"christians", b"x"}
    pairs = toxicity.swapped(words, (("muslim", "muslims", "christian"), ("y", "z")))
    assert pairs == [(b"muslim", b"muslims"), (b"muslim", b"christian")]
    base = toxicity.features_of(words)
    for (t, o), change in zip(pairs, toxicity.differences(words, pairs), strict=True):
        other = toxicity.features_of(words - {t} | {o})
        assert change == {f: 1.0 for f in base - other} | {f: -1.0 for f in other - base}
    rng = np.random.default_rng(0)
    n, k, m = 30, 8, 12
    row, col = np.nonzero(rng.random((n, k)) < 0.4)
    swap = (rng.integers(0, m, 40), rng.integers(0, k, 40), rng.choice([-1.0, 1.0], 40))
    problem = toxicity.Problem((rng.random(n) < 0.4).astype(float), row, col, swap, m, k, decay=0.1)
    w = rng.standard_normal(k + 1)
    _, g = problem.at(w)
    for i in range(k + 1):
        step = np.eye(k + 1)[i] * 1e-6
        assert abs((problem.at(w + step)[0] - problem.at(w - step)[0]) / 2e-6 - g[i]) < 1e-6
    # the penalty by hand: the changes' mean square
    change = [sum(v * w[f] for s, f, v in zip(*swap, strict=True) if s == j) for j in range(m)]
    free = toxicity.Problem(problem.y, row, col, swap, m, k, balance=0.0, decay=0.1)
    assert abs(problem.at(w)[0] - free.at(w)[0] - toxicity.BALANCE * sum(c * c for c in change) / m) < 1e-9


def test_toxicity_scores_by_hand():
    model = toxicity.Model({b"bad": 2.0, b"^worse": 1.5, b"^worsens": -0.5}, -1.0)
    score = model.scorer()
    for text, z in (("so Bad, bad!", 1.0), ("worse", -1.0), ("worsens", 0.5), ("worsenses worsening", 0.0), (None, -1.0), ("", -1.0), ("bad worsest " * 50_000, 2.5)):
        assert abs(score(None if text is None else text.encode())[0] - 1 / (1 + math.exp(-z))) < 1e-12


def test_found_terms_keep_like_company():
    rng = random.Random(1)
    rows = []
    for i in range(600):
        lang = ["a", "b"][i % 2]
        words = {f"{lang}{j}" for j in rng.sample(range(30), 12)} | ({"scum"} if i % 5 == 0 else set())
        if i % 30 in (0, 1, 2, 5):
            words.add(f"{lang}group{i // 30 % 4}")
        rows.append((int(i % 5 == 0), {w.encode() for w in words}))
    lists = toxicity.found_terms(toxicity.Rows(rows))
    assert lists and all(len(group) > 1 and len({t[0] for t in group}) == 1 for group in lists) and not any("scum" in g for g in lists)


def test_languages_by_hand():
    rows = [(lang, *langid.gram_counts(t.encode())) for _, t, lang, *_ in corpus(90)]
    model = langid.fit(rows)
    for _, text, *_ in corpus(12):
        data = (" " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " ").encode()
        places = []
        for n in (1, 2, 3, 4):
            for i in range(len(data) - n + 1):
                code = int.from_bytes(data[i : i + n], "big")
                places.append(((code * 2654435761 + (n << 28)) % (1 << 32)) >> (32 - langid.BUCKET_BITS))
        margins = [sum(float(model.weights[p, b]) for p in places) / len(places) * langid.SCALE + model.bias[b] for b in range(model.code.shape[1])]
        losses = [sum(math.log1p(math.exp(-c * m)) for c, m in zip(word, margins, strict=True)) for word in model.code]
        got = model.scorer()(text.encode())
        assert got[0] == model.languages[losses.index(min(losses))]
        assert abs(got[1] - 1 / sum(math.exp(min(losses) - x) for x in losses)) < 1e-6


def test_very_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 900)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"{letters[i % 26]}{letters[i // 26 % 17]}q " * 9, f"l{i % 442}", "c", "c") for i in range(442 * 4)]
    model = langid.train(spark.createDataFrame(rows, DOCS), F.lit(True))
    assert len(model.languages) == 442


def test_repeated_rows_are_learned_once(spark):
    rows = corpus(120) + [(None, "le matin avec maison", "en", "c", "c")] * 2000
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, DOCS)).collect()}
    truth = {r[0]: r[2] for r in corpus(120)}
    held = [r for i, r in got.items() if i is not None and r.held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_quality_votes_by_brute_force():
    rng = random.Random(9)
    words = [w for v in WORDS.values() for w in v]
    texts = [" ".join(rng.choices(words, k=rng.randint(3, 60))) if i % 3 else " ".join(w.upper() for w in rng.choices(words, k=20)) for i in range(200)]
    texts += texts[:20]  # ties
    model = quality.fit((int(i % 3 != 0), quality.terms_of(t.encode())) for i, t in enumerate(texts))
    for text in [*texts[:30], "", "zzz", "Aa1!" * 50_000]:
        vector = model.vector(quality.terms_of(text.encode())).astype(float)
        cosines = [round(float(np.float32(1) * (vector.astype(np.float32) @ v)) * quality.STEPS) for v in model.vectors]
        near = sorted(range(len(cosines)), key=lambda j: (-cosines[j], j))[: quality.NEIGHBOURS]
        weights = [max(0.0, min(1.0, cosines[j] / quality.STEPS)) ** quality.SHARPNESS for j in near]
        want = sum(w * model.labels[j] for w, j in zip(weights, near, strict=True)) / sum(weights) if sum(weights) > 1e-9 else model.prior
        assert abs(model.votes(vector[None].astype(np.float32))[0] - want) < 0.02
    assert quality.shape(b"aaaa" + b"A" * 100 + b"0" * 70 + b"a!") == b"aaAA00a!"


def test_long_and_repeated_rows_of_the_classifiers(spark):
    rows, labels = labelled()
    long = "the water " * 200_000
    frame = spark.createDataFrame([*rows, (900, long, None, "c", "c"), (900, long, None, "c", "c"), (rows[0][0], rows[0][1], "en", "c", "c")], DOCS)
    marks = spark.createDataFrame([*labels, *labels[:50]], "doc_id long, quality int, toxic int")
    for got in (toxicity.predict(frame, marks).collect(), quality.predict(frame, marks).collect(), langid.predict(frame).collect()):
        assert len(got) == len(rows) + 3 and len({(r.doc_id, r.score) for r in got}) == len(rows) + 1


def test_quality_of_repeating_and_shouting_texts(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        words = rng.choices([w for v in WORDS.values() for w in v], k=40)
        if i % 5 == 0:
            words = [rng.choice(words)] * 20 + words[:10] if i % 2 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "en", "c", "c"))
        labels.append((i, int(i % 5 != 0), 0))
    docs = spark.createDataFrame([*rows, (900, None, None, "c", "c"), (901, "", None, "c", "c")], DOCS)
    got = quality.predict(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == (r.doc_id % 5 != 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 402
