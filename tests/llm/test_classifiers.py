"""The language and compression models: exact inference, accuracy, edge cases."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clubledger.llm import compression, language_crf

SYLLABLES = {"en": "the er on an re th ing", "de": "en er ch ung ß ü ie", "fr": "eau é ou que ment è oi"}


def text_of(rnd, lang, n):
    own = SYLLABLES[lang].split()
    return " ".join("".join(rnd.choice(own) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def documents(n=240, seed=1):
    rnd = random.Random(seed)
    langs = ["en", "en", "de", "fr"]
    return [(i, text_of(rnd, langs[i % 4], rnd.choice([5, 60, 400])), langs[i % 4]) for i in range(n)]


def test_forward_backward_is_exact():
    rng = np.random.default_rng(2)
    lengths = np.array([1, 4, 0, 3])
    scores, move, first = rng.normal(size=(8, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got = language_crf.sum_marginals(scores, lengths, move, first)
    at = 0
    for n, own in zip(lengths, got, strict=True):
        want, total = np.zeros(3), 0.0
        for path in itertools.product(range(3), repeat=int(n)):
            if n:
                s = first[path[0]] + sum(scores[at + t, y] for t, y in enumerate(path))
                s += sum(move[a, b] for a, b in zip(path, path[1:]))
                total += np.exp(s)
                for y in path:
                    want[y] += np.exp(s)
        assert own == pytest.approx(want / total if n else want)
        at += n


def test_languages_of_held_out_documents(spark):
    rows = documents()
    odd = [(900, None, "en"), (901, "", "de"), (902, "123 --- 4", "fr"), (903, "the then", None), (None, "the", "en")]
    docs = spark.createDataFrame([*rows, *odd, rows[0], rows[0]], "doc_id bigint, text string, lang string")
    docs = docs.withColumn("score", F.lit("clash"))
    learned = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    model = language_crf.train(learned, per_language=40)
    found = language_crf.predict_language(docs, model).collect()
    assert len(found) == docs.count()
    named = {r.doc_id: (r.lang_pred, r.score) for r in found}
    assert [named[i] for i in (900, 901, 902)] == [("und", 0.0)] * 3
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(named[i][0] == lang for i, _, lang in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)
    short = language_crf.predict_language(docs, model, keep_text=False)
    assert "text" not in short.columns and short.count() == len(found)


def test_code_switched_words():
    rnd = random.Random(3)
    passages = [(lang, text_of(rnd, lang, 24).encode().split()) for lang in SYLLABLES for _ in range(60)]
    model = language_crf.fit(passages)
    mixed = text_of(rnd, "en", 30) + " " + text_of(rnd, "fr", 30)
    words = language_crf.split_words(mixed)
    each = [model.marginals(model.word_scores(words), np.array([60]))[0]]
    assert each[0].sum() == pytest.approx(60)
    assert each[0][model.languages.index("de")] < 5
    again = language_crf.fit(passages)
    assert language_crf.label_texts(model, [mixed]) == language_crf.label_texts(again, [mixed])


def test_every_language_is_learned(spark):
    rnd = random.Random(9)
    own = {f"l{k:02}": ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(6)] for k in range(70)}
    text = lambda lang: " ".join("".join(rnd.choices(own[lang], k=2)) for _ in range(30))
    rows = [(i, text(lang), lang) for i, lang in enumerate(list(own) * 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_crf.train(docs)
    assert model.languages == sorted(own)
    asked = [lang for lang in own for _ in range(2)]
    names, _ = language_crf.label_texts(model, [text(lang) for lang in asked])
    assert sum(a == b for a, b in zip(names, asked, strict=True)) >= 0.97 * len(asked)


def test_pipeline_keeps_texts_of_several_languages(spark):
    rnd = random.Random(10)
    rows = [(i, t, lang, "s", len(t)) for i, t, lang in documents()]
    mixed = " ".join(text_of(rnd, lang, 40) for lang in ("en", "de", "fr"))
    rows += [(900, mixed, None, "s", len(mixed)), (901, "1 2 ---", None, "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert 900 in kept and 901 not in kept


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    assert language_crf.train(none) is None
    row = language_crf.predict_language(none, None).first()
    assert (row.lang_pred, row.score) == ("und", 0.0)
    assert language_crf.train(none.limit(0)) is None
    labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id bigint, toxic int")
    model = compression.train(none, labels, "toxic", compression.Settings())
    assert compression.score_texts(none, model, 0.7).first().predicted == 1
    model = compression.train(none, labels.limit(0), "toxic", compression.Settings())
    assert compression.score_texts(none, model, 0.7).first().score == pytest.approx(0.5)
    assert compression.score_texts(none.limit(0), model, 0.7).count() == 0


def toxic_documents(n=500, seed=4):
    rnd, words = random.Random(seed), ["pathetic", "worthless", "moronic"]
    out = []
    for i in range(n):
        text = text_of(rnd, "en", rnd.choice([60, 200, 500])).split()
        if i % 3 == 0:
            for _ in range(max(2, len(text) // 40)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
        out.append((i, " ".join(text), int(i % 3 == 0)))
    return out


@pytest.mark.parametrize("contrast", [True, False])
def test_held_out_accuracy(spark, contrast):
    rows = toxic_documents()
    if not contrast:  # a label that colours the whole text
        rows = [(i, t.replace(" ", "%%% ") if y else t, y) for i, t, y in rows]
    odd = [(9000, None), (9001, ""), (9002, " \n "), (None, rows[0][1])]
    docs = spark.createDataFrame([*[r[:2] for r in rows], *odd], "doc_id bigint, text string")
    docs = docs.withColumn("predicted", F.lit("clash")).withColumn("label", F.lit(7))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(1, None), (2, 5)], "doc_id bigint, mark int")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    settings = compression.Settings(24 if contrast else 16, contrast, contrast)
    model = compression.train(docs, labels.where(~fold), "mark", settings, per_label=120)
    found = compression.score_texts(docs, model, 0.7).collect()
    assert len(found) == len(rows) + len(odd)
    scores = {r.doc_id: (r.score, r.predicted) for r in found}
    assert scores[9000] == scores[9001] == scores[9002]
    assert all(0 <= s <= 1 and p == int(s >= 0.7) for s, p in scores.values())
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    right = sum(scores[i][1] == y for i, _, y in held)
    assert right >= (0.93 if contrast else 0.99) * len(held)


def test_every_window_counts():
    # A mark at the very end of a long text is seen.
    rows = toxic_documents(240)
    settings = compression.Settings(24, True, True)
    model = compression.fit([t for _, t, _ in rows], [y for _, _, y in rows], settings, 0.33)
    clean = text_of(random.Random(8), "en", 3000)
    saved, _, sizes = model.differences(settings.bytes_of(clean + " pathetic worthless moronic" * 3))
    assert len(saved) == -(-3009 // 24) and sizes.sum() > len(clean) - 200
    assert saved[-1] > max(0, np.median(saved))


def test_many_rare_terms():
    # Three hundred terms, each in little more than one toxic document of a hundred.
    rnd = random.Random(6)
    terms = ["".join(rnd.choice("bcdfgjkpquvwxyz") for _ in range(8)) for _ in range(300)]

    def rows(n):
        out = []
        for i in range(n):
            words = text_of(rnd, "en", rnd.choice([60, 200])).split()
            for at in rnd.sample(range(60), 4 if i % 3 == 0 else 0):
                words[at] = rnd.choice(terms)
            out.append((" ".join(words), int(i % 3 == 0)))
        return out

    learned, held = rows(4500), rows(600)
    settings = compression.Settings(24, True, True)
    model = compression.fit([t for t, _ in learned], [y for _, y in learned], settings, 1 / 3)
    right = sum(int(model.score(t) >= 0.7) == y for t, y in held)
    assert right >= 0.95 * len(held)


def test_plain_dictionaries_are_the_first_pair():
    rows = toxic_documents(240)
    settings = compression.Settings(24, True, True)
    texts, labels = [t for _, t, _ in rows], [y for _, _, y in rows]
    both = compression.fit(texts, labels, settings, 0.33)
    alone = compression.fit(texts, labels, compression.Settings(24, True), 0.33)
    assert len(both.pairs) == 2 and both.pairs[:1] == alone.pairs
    assert len(both.weights) == 2 * len(alone.weights)
