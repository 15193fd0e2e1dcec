"""Operators 2, 3 and 10: round trips, held-out accuracy, and scores by brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeleaf.llm import bpe, langid, ngrams, toxicity
from lakeleaf.llm.queries import vocabulary
from tests.llm.test_dedup import frame


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(vocabulary(), encoding="utf-8").read())


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


ODD = ["", " ", "\n\n  x", "don't we'll", "<|endoftext|>", "a<|endoftext|>b <|endof", "日本語 テキスト", "é\u0301", "\x00\x1c\x85\xa0", "aaaaaaaaaaaaaaaa" * 20, "1234567890", "\u0c5c\u088f x", "𝔘𝔫𝔦 👩‍👩‍👧", "  lead", "trail  "]


def test_codec_equals_the_library(codec, reference):
    rng = random.Random(2)
    pool = [chr(c) for c in (*range(32, 127), 9, 10, 13, 0x1C, 0x85, 0xA0, 0xE9, 0x558, 0x2028, 0x3000, 0xFEFF, 0x1F600, 0x323B0)]
    texts = ODD + ["".join(rng.choice(pool + ["'s", " the", "ization", "  "]) for _ in range(rng.randrange(60))) for _ in range(800)]
    for text in texts:
        ids = reference.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids, repr(text)
        assert codec.decode(ids) == reference.decode(ids, skip_special_tokens=False) == text
    for n, ids, back in codec.digests(texts[:50]):
        assert len(ids) == len(back) == 64


def test_small_cache_changes_nothing(codec, monkeypatch):
    texts = [f"word{i} other{i % 7} the end" for i in range(300)]
    want = list(codec.digests(texts))
    monkeypatch.setattr(bpe, "CACHE", 50)
    monkeypatch.setattr(bpe, "PAIRS", 20)
    monkeypatch.setattr(bpe, "BLOCK", 200)
    assert list(bpe.Codec(open(vocabulary(), encoding="utf-8").read()).digests(texts)) == want


def test_bpe_rows(spark, reference):
    rows = [(i, t) for i, t in enumerate([*ODD, None, "x " * 30_000])] + [(None, "a"), (1, " ")]
    got = bpe.bpe_digests(frame(spark, rows), vocabulary()).collect()
    want = []
    for i, t in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert bpe.bpe_digests(frame(spark, []), vocabulary()).count() == 0
    assert [r["n_tokens"] for r in bpe.bpe_tokens(frame(spark, [(1, "a b"), (2, None)]), vocabulary()).orderBy("doc_id").collect()] == [2, 0]


def test_workers_forget_the_words_of_a_task(spark):
    def held(batches):
        for batch in batches:
            yield batch.assign(id=sum(len(c.known) - len(c.marks) + len(c.other) for c in bpe._codecs.values()))

    docs = frame(spark, [(i, f"word{i} \ud7ff w{i}") for i in range(40)])
    for _ in range(2):
        assert bpe.bpe_digests(docs, vocabulary()).filter("n_tokens > 0").count() == 40
    assert spark.range(40).repartition(4).mapInPandas(held, "id long").agg({"id": "max"}).first()[0] == 0


SOUNDS = {"en": "the and ing tion of that with er", "de": "der und ung keit sch ein lich ü", "fr": "le eau tion que é ment ai oux", "es": "el ción que ó mente ado ñ los"}


def invented(lang, rng, n):
    parts = SOUNDS[lang].split()
    return " ".join("".join(rng.choice(parts, int(rng.integers(1, 4)))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def tongues(spark):
    rng = np.random.default_rng(4)
    rows = [(i, invented(lang, rng, int(rng.integers(3, 60))), lang) for i, lang in enumerate(list(SOUNDS) * 150)]
    return frame(spark, [*rows, (9000, None, "en"), (9001, "123 !?", "en"), (9002, "the and the ing", None), (None, "der und ung keit", "de")])


def test_language_held_out(tongues):
    got = langid.language_id(tongues, langid.train(tongues)).join(tongues.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 9000]
    assert len(held) > 100 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by_id[9000] == by_id[9001] == "und" and by_id[9002] == "en"


def test_language_edges(spark, tongues):
    model = langid.train(tongues)
    assert langid.language_id(tongues, model).filter("doc_id is null").first()["lang_pred"] == "de"
    assert langid.language_id(frame(spark, []), model).count() == 0
    none = langid.train(frame(spark, [(1, "text", None)]))
    assert none.predict("text") == ("und", 0.0)
    one = langid.train(frame(spark, [(i, "text here", "xx") for i in range(8)]))
    assert one.predict("text") == ("xx", 1.0) and one.predict("12") == ("und", 0.0)
    assert langid.family_of("de") == "germanic" and langid.family_of("zz") == "=zz"


@pytest.fixture(scope="module")
def insults(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = invented(list(SOUNDS)[i % 4], rng, int(rng.integers(10, 80))).split(" ")
        for _ in range(3 if bad else 0):
            text.insert(int(rng.integers(0, len(text))), rng.choice(["idiot", "moron", "scum"]) + rng.choice(["", "s", "ic"]))
        rows.append((i, " ".join(text)))
        labels.append((i, None if i % 50 == 1 else int(bad)))
    return frame(spark, [*rows, (9000, None), (9001, ""), (None, "idiot moron scum")]), spark.createDataFrame([*labels, (None, 1), (8888, 1)], "doc_id long, toxic int")


def test_toxicity_held_out(insults):
    docs, labels = insults
    got = toxicity.toxicity_folds(docs, labels)
    rows = got.join(labels, "doc_id").filter("held_out and toxic is not null").collect()
    assert len(rows) > 60 and sum(r["predicted"] == r["toxic"] for r in rows) >= 0.97 * len(rows)
    every = got.collect()
    assert len(every) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in every)
    assert all(r["predicted"] == 0 for r in every if r["doc_id"] in (9000, 9001)) and [r["predicted"] for r in every if r["doc_id"] is None] == [1]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in every if r["doc_id"] is not None)


def test_toxicity_edges(spark, insults):
    docs, labels = insults
    model = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert model.score("idiot") < 0.01
    assert toxicity.train(docs, labels.filter("toxic = 1"), F.lit(True)).score("x") > 0.99
    assert toxicity.toxicity(frame(spark, []), model).count() == 0
    kept = toxicity.toxicity(frame(spark, [(1, "a"), (1, "a")]), model, keep=("doc_id", "label")).collect()
    assert len(kept) == 2 and set(kept[0].asDict()) == {"doc_id", "label", "score", "predicted"}
    # One giant text doesn't use up the sample: the other rows of its class and the other class are learnt all the same.
    giant = docs.filter("text is not null").limit(0).unionByName(frame(spark, [(700_001, "idiot moron scum " * 2000)])).unionByName(docs)
    both = toxicity.train(giant, labels.unionByName(spark.createDataFrame([(700_001, 1)], "doc_id long, toxic int")), F.lit(True), toxicity.Settings(chars_per_class=60_000))
    assert both.score("you idiot") > 0.5 > both.score("")
    clash = frame(spark, [(1, "idiot moron scum"), (2, "")]).withColumns({"score": F.lit("a"), "predicted": F.lit(True), "row": F.lit(None).cast("string")})
    left = toxicity.drop_toxic(clash, both)
    assert left.columns == clash.columns and [(r["doc_id"], r["score"], r["predicted"]) for r in left.collect()] == [(2, "a", True)]
    few = toxicity.train(docs, labels, F.lit(True), toxicity.Settings(rows_per_class=5, chars_per_class=2000))
    assert 0 <= few.score("idiot") <= 1


def brute_ngrams(text, lengths, bits):
    """Buckets of n-grams one by one: letters lower-cased, all else one space, a space at both ends."""
    signs = ""
    for ch in f" {text.lower()} ":
        signs += ch if ch.isalpha() else "" if signs.endswith(" ") else " "
    out = []
    for n in lengths:
        for i in range(len(signs) - n + 1):
            h = sum(ord(c) * int(m) for c, m in zip(signs[i : i + n], ngrams.PLACES)) % 2**32
            out.append((h ^ (h >> 15)) * int(ngrams.LENGTHS[n]) % 2**32 >> (32 - bits))
    return out


STRANGE = ["", "idiot", "You IDIOT, moron!", "a1b2 c3", "\u0130stanbul stra\u00dfe", "x" * 5000, "\u4e2d\u6587 na\u00efve -- caf\u00e9"]


def test_toxicity_scores_match_brute_force():
    texts = ["you idiot moron", "what a moron", "idiot scum here", "a fine day", "we met a friend", "fine friend today"] * 3
    s = toxicity.Settings(least_ratio=0.2, steps=50)
    labels = [1, 1, 1, 0, 0, 0] * 3
    model = toxicity.fit(texts, labels, s)
    # Ratios: shares of the texts of each label that have the n-gram, with the smoothing.
    having = [Counter(b for t, y in zip(texts, labels) if y == k for b in set(brute_ngrams(t, s.lengths, s.bits))) for k in (0, 1)]
    for b in set(having[0]) | set(having[1]):
        ratio = math.log((having[1][b] + 1) / 10) - math.log((having[0][b] + 1) / 10)
        known = having[0][b] + having[1][b] >= s.least_texts and abs(ratio) >= s.least_ratio
        assert known or model.weights[b] == 0
    for text in [*texts, *STRANGE]:
        z = model.bias + sum(float(model.weights[b]) for b in set(brute_ngrams(text, s.lengths, s.bits)))
        assert abs(model.score(text) - 1 / (1 + math.exp(-z))) < 1e-6


def test_language_predictions_match_brute_force():
    s = langid.Settings(epochs=4)
    rng = np.random.default_rng(2)
    names = list(SOUNDS)
    model = langid.fit({name: [invented(name, rng, 40) for _ in range(12)] for name in names}, s)
    assert len(model.machines) >= len(names) - 1
    for text in [*[invented(name, rng, 12) for name in names for _ in range(4)], *STRANGE]:
        grams = Counter(brute_ngrams(text, s.lengths, s.bits))
        n = sum(grams.values())
        if not any(ch.isalpha() for ch in text):
            assert model.predict(text) == ("und", 0.0)
            continue
        chance = {}
        for k, (a, b) in enumerate(model.machines):
            z = 2 * (sum(c * float(model.table[g, k]) for g, c in grams.items()) * langid.SCALE / n + float(model.table[-1, k]))
            chance[a, b], chance[b, a] = 1 / (1 + math.exp(-z)), 1 / (1 + math.exp(z))

        def winner(among):
            duels = {x: [chance[x, y] for y in among if y != x] for x in among}
            best = max(sorted(among), key=lambda x: (sum(p >= 0.5 for p in duels[x]), sum(duels[x])))
            return best, min([1.0, *duels[best]])

        family, sure = winner({langid.family_of(x) for x in names})
        lang, surer = winner({x for x in names if langid.family_of(x) == family})
        got = model.predict(text)
        assert got[0] == lang and abs(got[1] - sure * surer) < 1e-5
