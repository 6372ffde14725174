"""Language of every word by a linear-chain conditional random field.

A word's features are its byte n-grams between word marks (those that touch a mark
are its affixes) and the language whose lexicon holds it; transitions between the
languages of neighbouring words are learned with them. Forward-backward gives each
word its language probabilities; a document's language is the one with the highest
mean over all its words, and that mean is the score.

Fitting is done once, on a bounded sample of labelled documents whose passages are
spliced into code-switched sequences. Labelling is one pass over the documents,
without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clubledger.llm.common import rows_in_pieces, tidy

UNDETERMINED = "und"
#: Rows of the weight table that n-grams are hashed to.
FEATURES = 1 << 16
SIZES = (1, 2, 3, 4)
#: Bounds of the training sample: documents per language, and passages of so many
#: words from each document. All languages are learned; where there are many, each
#: has its part of MOST_DOCUMENTS, and LEAST_PER_LANGUAGE all the same.
PER_LANGUAGE, PASSAGES, PASSAGE_WORDS = 600, 3, 24
MOST_DOCUMENTS, LEAST_PER_LANGUAGE = 9600, 30
CELLS = 1 << 22  # numbers of a table that is made at once, so that it fits many languages
SEQUENCE_WORDS = 48
_LEFT, _RIGHT = 0x02, 0x03  # the word marks; neither byte occurs inside a letter


def ngram_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, and where each word's begin."""
    marked = [b"\x02" + w + b"\x03" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    found, owners = [], []
    for n in SIZES:
        if len(data) < n:
            continue
        count = len(data) - n + 1
        code = np.full(count, n, np.uint64)
        for k in range(n):
            code = code * np.uint64(1_000_003) + data[k : k + count]
        code ^= code >> np.uint64(29)
        code *= np.uint64(0x9E3779B97F4A7C15)
        inside = owner[:count] == owner[n - 1 :]
        found.append((code >> np.uint64(40))[inside] % np.uint64(FEATURES))
        owners.append(owner[:count][inside])
    features, owners = np.concatenate(found).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    starts = np.searchsorted(owners[order], np.arange(len(words)))
    return features[order], starts


@dataclass
class Crf:
    languages: list[str]
    ngrams: np.ndarray  # (FEATURES, languages)
    in_lexicon: np.ndarray  # (languages + 1, languages); the last row is for words in none
    lexicon: dict[bytes, int]
    transitions: np.ndarray  # (languages, languages), from row to column
    first: np.ndarray  # (languages,)

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """One row per word: how much its features speak for each language."""
        n = len(self.languages)
        if not words:
            return np.zeros((0, n))
        out = []
        step = max(1, 200_000 // max(4, n))
        for i in range(0, len(words), step):
            part = words[i : i + step]
            features, starts = ngram_features(part)
            known = np.fromiter((self.lexicon.get(w, n) for w in part), np.int64, len(part))
            sums = np.add.reduceat(self.ngrams[features], starts, axis=0)
            out.append(sums + self.in_lexicon[known])
        return np.concatenate(out)

    def marginals(
        self, scores: np.ndarray, lengths: np.ndarray, best: np.ndarray | None = None
    ) -> np.ndarray:
        """Sum over its words of each sequence's language probabilities.

        ``scores``: the rows of all words, sequence after sequence. All sequences
        go forward and backward together, the longest ones to their end alone. To
        ``best`` the highest probability of each word is added.
        """
        return sum_marginals(scores, lengths, self.transitions, self.first, best)


def _steps(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by falling length, first places in that order, and how many sequences
    still run at each step."""
    order = np.argsort(-lengths, kind="stable")
    places = (np.cumsum(lengths) - lengths)[order]
    longest = int(lengths.max(initial=0))
    running = len(lengths) - np.searchsorted(
        np.sort(lengths), np.arange(longest), side="right"
    )
    return order, places, running


def forward(
    scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, first: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled emissions, scaled forward probabilities and their scales, per word."""
    _, places, running = _steps(lengths)
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    move, start = np.exp(transitions), np.exp(first)
    alpha, scale = np.empty_like(emit), np.ones(len(emit))
    last = None
    for t, n in enumerate(running):
        at = places[:n] + t
        now = emit[at] * (start if t == 0 else last[:n] @ move)
        total = now.sum(axis=1)
        now /= total[:, None]
        alpha[at], scale[at] = now, total
        last = now
    return emit, alpha, scale


def sum_marginals(
    scores: np.ndarray,
    lengths: np.ndarray,
    transitions: np.ndarray,
    first: np.ndarray,
    best: np.ndarray | None = None,
) -> np.ndarray:
    sums = np.zeros((len(lengths), transitions.shape[0]))
    if not len(scores):
        return sums
    order, places, running = _steps(lengths)
    emit, alpha, _ = forward(scores, lengths, transitions, first)
    ends = places + lengths[order] - 1
    back = np.exp(transitions).T
    beta = np.ones((len(lengths), transitions.shape[0]))
    for t, n in enumerate(running):
        at = ends[:n] - t
        if t:
            beta = (emit[at + 1] * beta[:n]) @ back
            beta /= beta.sum(axis=1, keepdims=True)
        both = alpha[at] * beta[:n]
        both /= both.sum(axis=1, keepdims=True)
        sums[order[:n]] += both
        if best is not None:
            best[order[:n]] += both.max(axis=1)
    return sums


def fit(passages: list[tuple[str, list[bytes]]], rounds: int = 40, seed: int = 7) -> Crf:
    """A CRF from passages (language, words), spliced into sequences that switch
    language; log-likelihood by full-batch Adam steps."""
    languages = sorted({lang for lang, _ in passages})
    index = {lang: i for i, lang in enumerate(languages)}
    n_lang = len(languages)
    rng = np.random.default_rng(seed)
    counts: dict[bytes, Counter] = {}
    for lang, words in passages:
        for w in words:
            counts.setdefault(w, Counter())[index[lang]] += 1
    lexicon = {}
    for w, by in counts.items():
        best, n = max(sorted(by.items()), key=lambda x: x[1])
        if n >= 3 and 2 * n > by.total():
            lexicon[w] = best
    # Passages of every language in turn, so that rare ones are heard as well.
    chosen = [passages[i] for i in rng.permutation(len(passages))]
    vocabulary = {w: i for i, w in enumerate(counts)}
    flat_words, flat_labels = [], []
    for lang, words in chosen:
        flat_words += [vocabulary[w] for w in words]
        flat_labels += [index[lang]] * len(words)
    length = min(SEQUENCE_WORDS, len(flat_words))
    n_seq = len(flat_words) // max(1, length)
    model = Crf(
        languages,
        np.zeros((FEATURES, n_lang)),
        np.zeros((n_lang + 1, n_lang)),
        lexicon,
        np.zeros((n_lang, n_lang)),
        np.zeros(n_lang),
    )
    if not n_seq:
        return model
    words = np.array(flat_words[: n_seq * length]).reshape(n_seq, length)
    labels = np.array(flat_labels[: n_seq * length]).reshape(n_seq, length)
    vocab = list(vocabulary)
    features, starts = ngram_features(vocab)
    sizes = np.diff(np.append(starts, len(features)))
    known = np.array([lexicon.get(w, n_lang) for w in vocab])
    ends = np.append(starts, len(features))
    # Words and sequences are taken in parts, and what they add is summed up.
    n_words = max(1, len(vocab) * CELLS // (len(features) * n_lang))
    n_part = max(1, CELLS // (length * n_lang))
    pairs = np.zeros((n_lang, n_lang))
    np.add.at(pairs, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), 1)
    params = [model.ngrams, model.in_lexicon, model.transitions, model.first]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, rounds + 1):
        rows = model.in_lexicon[known]
        for i in range(0, len(vocab), n_words):
            j = min(i + n_words, len(vocab))
            part = model.ngrams[features[ends[i] : ends[j]]]
            rows[i:j] += np.add.reduceat(part, starts[i:j] - starts[i], axis=0)
        move = np.exp(model.transitions)
        expected, begun = np.zeros_like(pairs), np.zeros(n_lang)
        by_word = np.zeros((len(vocab), n_lang))
        for i in range(0, n_seq, n_part):
            own, truth = words[i : i + n_part], labels[i : i + n_part]
            n = len(own)
            lengths = np.full(n, length)
            emit, alpha, _ = forward(rows[own.ravel()], lengths, model.transitions, model.first)
            emit = emit.reshape(n, length, n_lang)
            alpha = alpha.reshape(n, length, n_lang)
            error = np.empty_like(alpha)  # truth less probability
            beta = np.ones((n, n_lang))
            error[:, -1] = -alpha[:, -1]
            for t in range(length - 2, -1, -1):
                ahead = emit[:, t + 1] * beta
                back = ahead @ move.T
                total = (alpha[:, t] * back).sum(axis=1, keepdims=True)
                expected += move * ((alpha[:, t] / total).T @ ahead)
                error[:, t] = -alpha[:, t] * back / total
                beta = back / back.sum(axis=1, keepdims=True)
            error = error.reshape(-1, n_lang)
            error[np.arange(len(error)), truth.ravel()] += 1
            begun += error[::length].sum(axis=0)
            for k in range(n_lang):
                by_word[:, k] += np.bincount(own.ravel(), error[:, k], len(vocab))
        grads = [
            np.stack(
                [
                    np.bincount(features, np.repeat(by_word[:, k], sizes), FEATURES)
                    for k in range(n_lang)
                ],
                1,
            ),
            np.stack([np.bincount(known, by_word[:, k], n_lang + 1) for k in range(n_lang)], 1),
            pairs - expected,
            begun,
        ]
        grads[1][n_lang] = 0
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            g = g / n_seq - 1e-4 * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.ngrams = model.ngrams.astype(np.float32)
    return model


def split_words(text: str | None) -> list[bytes]:
    return text.lower().encode().split() if text else []


def training_passages(
    docs: DataFrame, doc_id: str, text: str, lang: str, per_language: int = PER_LANGUAGE
) -> list[tuple[str, list[bytes]]]:
    """Passages of at most about ``per_language`` documents of each language, fewer
    where there are many languages, taken evenly from the whole text. The driver holds
    at most ``2 * PASSAGES * PASSAGE_WORDS`` words of a document, and in all
    ``MOST_DOCUMENTS`` of them or ``LEAST_PER_LANGUAGE`` of each language."""
    labelled = docs.where(
        F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & F.col(text).isNotNull()
    )
    counted = labelled.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["lang"]: r["n"] for r in counted.orderBy("lang").collect()}
    if not sizes:
        return []
    per_language = min(per_language, max(LEAST_PER_LANGUAGE, MOST_DOCUMENTS // len(sizes)))
    parts = 10**12  # so fine that a very frequent language keeps to its bound as well
    share = F.element_at(
        F.create_map(
            *[
                F.lit(x)
                for name, n in sizes.items()
                for x in (name, min(parts, -(-per_language * parts // n)))
            ]
        ),
        F.col(lang),
    )
    picked = F.pmod(F.xxhash64(F.lit("crf"), F.col(doc_id)), F.lit(parts)) < share
    sample = labelled.where(picked).select(
        F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")
    )

    def passages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rows_in_pieces(whole):
                out = []
                columns = (batch.column(c).to_pylist() for c in ("doc_id", "lang", "text"))
                for i, name, body in zip(*columns, strict=True):
                    words = split_words(body)
                    room = max(0, len(words) - PASSAGE_WORDS)
                    for at in sorted({room * k // PASSAGES for k in range(PASSAGES)}):
                        out.append((i, name, b" ".join(words[at : at + PASSAGE_WORDS]).decode()))
                yield pa.RecordBatch.from_pylist(
                    [{"doc_id": i, "lang": n, "words": w} for i, n, w in out],
                    pa.schema([("doc_id", docs_id), ("lang", pa.string()), ("words", pa.string())]),
                )

    id_type = sample.schema["doc_id"].dataType.simpleString()
    docs_id = pa.int64() if id_type in ("bigint", "int") else pa.string()
    if docs_id == pa.string():
        sample = sample.withColumn("doc_id", F.col("doc_id").cast("string"))
    else:
        sample = sample.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    kind = "bigint" if docs_id == pa.int64() else "string"
    rows = sample.mapInArrow(passages, f"doc_id {kind}, lang string, words string")
    most = 2 * per_language * PASSAGES * len(sizes)
    found = sorted(tuple(r) for r in rows.limit(most).collect())
    return [(name, words.encode().split()) for _, name, words in found if words]


def train(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> Crf | None:
    """A model of the languages in ``lang``; ``None`` without a labelled text."""
    passages = training_passages(docs, doc_id, text, lang, per_language)
    return fit(passages) if passages else None


def label_texts(model: Crf | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    return label_surely(model, texts)[:2]


def label_surely(
    model: Crf | None, texts: list[str | None]
) -> tuple[list[str], list[float], list[float]]:
    """Language and score of each text, and its certainty: the mean over its words of
    each word's highest language probability, whichever languages these are."""
    names, scores, sure = [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    asked = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
    words = [split_words(texts[i]) for i in asked]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    flat = [w for own in words for w in own]
    if not flat:
        return names, scores, sure
    vocabulary = dict.fromkeys(flat)
    distinct = list(vocabulary)
    vocabulary = dict(zip(distinct, range(len(distinct)), strict=True))
    rows = model.word_scores(distinct)[
        np.fromiter(map(vocabulary.__getitem__, flat), np.int64, len(flat))
    ]
    highest = np.zeros(len(lengths))
    means = model.marginals(rows, lengths, highest) / np.maximum(lengths, 1)[:, None]
    highest /= np.maximum(lengths, 1)
    for i, own, certainty in zip(asked, means, highest, strict=True):
        best = int(own.argmax())
        names[i], scores[i] = model.languages[best], float(min(1.0, own[best]))
        sure[i] = float(min(1.0, certainty))
    return names, scores, sure


def predict_language(
    docs: DataFrame,
    model: Crf | None,
    text: str = "text",
    keep_text: bool = True,
    certainty: bool = False,
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` and, if asked for, ``certainty``
    (columns of those names are replaced); without ``keep_text`` the text itself is
    left out.

    Whole texts are read. A text that is null, empty or without a letter is ``und``
    with score 0, as is every text if nothing could be learned; a tie goes to the
    language that sorts first. Repeated rows stay as they are.
    """
    added = ["lang_pred", "score", *(["certainty"] if certainty else [])]
    left_out = {*added} | (set() if keep_text else {text})
    others = [c for c in docs.columns if c not in left_out]
    schema = docs.select(*others).schema.add("lang_pred", "string").add("score", "double")
    if certainty:
        schema = schema.add("certainty", "double")
    most = (8 << 20) // max(4, len(model.languages) if model else 0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rows_in_pieces(whole, most):
                names, *numbers = label_surely(shared.value, batch.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in others),
                        pa.array(names, pa.string()),
                        *(pa.array(x, pa.float64()) for x in numbers[: len(added) - 1]),
                    ],
                    [*others, *added],
                )

    return docs.select(*dict.fromkeys([*others, text])).mapInArrow(tidy(label), schema)
