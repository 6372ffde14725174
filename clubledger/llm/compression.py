"""Classification of texts by how well two zstandard dictionaries compress them.

One dictionary is trained on text of label 1, the other on text of label 0. A text is
cut into short windows, each window is compressed with both, and the differences in
length, together with a calibration fitted to labelled texts, make the score.

zstandard's trainer gets all windows of a label. Where a label shows in a few words
(toxicity), a second pair of dictionaries adds features of its own: both have the same
stock, trained on what the labels have in common, and each ends in a cover of the
stretches of bytes that its label's documents contain significantly more often than
the other's: the most frequent passages first, each one only if it brings a stretch
not covered yet. So these two differ in what is typical and in nothing else.

Fitting uses a bounded sample of labelled documents; scoring reads every text whole,
in one pass without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clubledger.llm.common import rows_in_pieces, tidy

#: Bounds of the training sample: documents per label, and bytes of each, taken in
#: evenly spaced passages from its whole text.
PER_LABEL, DOC_BYTES, PASSAGE_BYTES = 1500, 6000, 1000
#: Bytes that zstandard's trainer gives: the shared stock, or a plain dictionary.
STOCK, PLAIN = 16384, 8192
GRAM = 5  # bytes of the stretches that are counted
BUCKETS = 1 << 22
LIFT = 10  # typical: in so many times the share of the other label's documents
FALSE = 0.05  # of the typical stretches, the expected share that is so by chance
OWN = 98_304  # bytes of typical passages, which with the stock fit a window of zstandard
FEATURES = 8  # of each pair of dictionaries
SAMPLES = 30_000  # windows that a dictionary is trained on


@dataclass
class Settings:
    """How texts are read and dictionaries made: words per window, whether letter case
    is ignored, whether a contrasting pair is added to the plain one."""

    window_words: int = 16
    fold_case: bool = False
    contrast: bool = False

    def windows(self, text: bytes) -> list[bytes]:
        words = text.split()
        n = self.window_words
        return [b" ".join(words[i : i + n]) for i in range(0, len(words), n)]

    def bytes_of(self, text: str | None) -> bytes:
        text = text or ""
        return (text.lower() if self.fold_case else text).encode()


def _gram_codes(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    count = max(0, len(data) - GRAM + 1)
    code = np.zeros(count, np.uint64)
    for k in range(GRAM):
        code = (code << np.uint64(8)) | data[k : k + count]
    code *= np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(64 - 22)).astype(np.int64)


def _document_counts(texts: list[bytes]) -> np.ndarray:
    """In how many of the texts each hashed stretch occurs."""
    counts = np.zeros(BUCKETS, np.int32)
    for text in texts:
        counts[np.unique(_gram_codes(text))] += 1
    return counts


def _tails(own: np.ndarray, other: np.ndarray, share: float) -> np.ndarray:
    """How likely at least ``own`` of ``own + other`` documents have a label of that
    share by chance."""
    total = own + other
    most = int(total.max(initial=0))
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most + 1)))])
    out = np.zeros(len(own))
    for i, (k, n) in enumerate(zip(own, total, strict=True)):
        j = np.arange(k, n + 1)
        log = logs[n] - logs[j] - logs[n - j] + j * np.log(share) + (n - j) * np.log1p(-share)
        out[i] = np.exp(log).sum()
    return out


def _typical(own: np.ndarray, n_own: int, other: np.ndarray, n_other: int) -> np.ndarray:
    """Which hashed stretches are typical of one label's documents: in ``LIFT`` times
    the share of the other's, and significantly so. The evidence asked for falls with
    the number of stretches that have it (Benjamini and Hochberg's step-up), so many
    rare terms are found as a few frequent ones are."""
    seen = np.flatnonzero((own > 0) | (other > 0))
    pairs, which = np.unique(
        np.stack([own[seen], other[seen]]).astype(np.int64), axis=1, return_inverse=True
    )
    chance = np.ones(pairs.shape[1])
    lifted = pairs[0] * n_other > LIFT * pairs[1] * n_own
    chance[lifted] = _tails(*pairs[:, lifted], n_own / (n_own + n_other))
    chance = chance[which.ravel()]
    ranked = np.sort(chance)
    passing = np.flatnonzero(ranked <= FALSE * np.arange(1, len(seen) + 1) / max(1, len(seen)))
    typical = np.zeros(len(own), bool)
    if len(passing):
        typical[seen[chance <= ranked[passing[-1]]]] = True
    return typical


def _cover(texts: list[bytes], typical: np.ndarray, most: int) -> bytes:
    """Passages that hold the typical stretches, the most frequent ones last, where
    a window finds them at the smallest distance."""
    passages: Counter[bytes] = Counter()
    for text in texts:
        marked = np.flatnonzero(typical[_gram_codes(text)])
        if len(marked):
            for run in np.split(marked, np.flatnonzero(np.diff(marked) > 1) + 1):
                passages[text[run[0] : run[-1] + GRAM]] += 1
    covered: set[int] = set()
    chosen, size = [], 0
    for passage, _ in sorted(passages.items(), key=lambda x: (-x[1], x[0])):
        codes = _gram_codes(passage)
        if new := set(codes[typical[codes]].tolist()) - covered:
            covered |= new
            chosen.append(passage)
            size += len(passage)
        if size >= most:
            break
    return b"".join(reversed(chosen))[-most:]


def _trained(samples: list[bytes], size: int) -> bytes:
    """What zstandard's trainer finds common in the samples; of too few for it, the
    samples themselves."""
    samples = samples[:: max(1, len(samples) // SAMPLES)]
    if len(samples) >= 64:
        try:
            found = zstandard.train_dictionary(size, samples, k=48, d=6, level=3)
            return found.as_bytes()[-size:]
        except zstandard.ZstdError:
            pass
    return b" ".join(dict.fromkeys(samples))[-size:]


def _compressor(content: bytes, fine: bool) -> zstandard.ZstdCompressor:
    # Tables that hold every place of the dictionary.
    log = max(14, len(content).bit_length())
    parameters = zstandard.ZstdCompressionParameters(
        window_log=17,
        chain_log=log,
        hash_log=log,
        search_log=4,
        min_match=3 if fine else 4,
        target_length=16,
        strategy=zstandard.STRATEGY_BTOPT if fine else zstandard.STRATEGY_LAZY2,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=parameters)


@dataclass
class CompressionModel:
    settings: Settings
    #: Dictionaries of label 1 and label 0: the plain pair, then the contrasting one.
    pairs: list[tuple[bytes, bytes]]
    means: np.ndarray = None
    scales: np.ndarray = None
    weights: np.ndarray = None
    bias: float = 0.0
    _made: list = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_made": None}

    def differences(
        self, text: bytes, pair: int = -1
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per window: bytes that label 1 saves over label 0, bytes under label 0,
        bytes uncompressed."""
        return self._differences(self.settings.windows(text), pair)

    def _differences(self, windows: list[bytes], pair: int):
        if self._made is None:
            self._made = [
                tuple(_compressor(d, fine=k > 0).compress for d in own)
                for k, own in enumerate(self.pairs)
            ]
        one, zero = self._made[pair]
        sizes = np.fromiter(map(len, windows), np.int64, len(windows))
        with_zero = np.fromiter(map(len, map(zero, windows)), np.int64, len(windows))
        with_one = np.fromiter(map(len, map(one, windows)), np.int64, len(windows))
        return with_zero - with_one, with_zero, sizes

    def features(self, texts: list[bytes]) -> np.ndarray:
        """One row per text; zeros for one without a window. The windows of all texts
        go through one dictionary after the other."""
        windows = [self.settings.windows(t) for t in texts]
        lengths = np.fromiter(map(len, windows), np.int64, len(windows))
        flat = [w for own in windows for w in own]
        out = np.zeros((len(texts), FEATURES * len(self.pairs)))
        held = np.flatnonzero(lengths)
        if not len(held):
            return out
        n = lengths[held]
        starts = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(held)), n)
        for pair in range(len(self.pairs)):
            saved, packed, sizes = self._differences(flat, pair)
            total = np.add.reduceat(sizes, starts)
            # Sums over the first windows of a text by what they save, and over the last.
            sums = np.concatenate([[0], np.cumsum(saved[np.lexsort((saved, owner))])])
            few = np.minimum(n, 3)
            found = [
                np.add.reduceat(saved, starts) / total,
                (sums[starts + n] - sums[starts + n - few]) / few,
                (sums[starts + few] - sums[starts]) / few,
                np.add.reduceat((saved >= 1).astype(np.int64), starts) / n,
                np.add.reduceat((saved >= 3).astype(np.int64), starts) / n,
                np.add.reduceat((saved <= -1).astype(np.int64), starts) / n,
                np.add.reduceat((saved <= -3).astype(np.int64), starts) / n,
                np.add.reduceat(packed, starts) / total,
            ]
            out[held, pair * FEATURES : (pair + 1) * FEATURES] = np.stack(found, 1)
        return out

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        features = self.features([self.settings.bytes_of(t) for t in texts])
        x = (features - self.means) / self.scales
        return 1 / (1 + np.exp(-np.clip((x * self.weights).sum(axis=1) + self.bias, -30, 30)))


def _calibrate(model: CompressionModel, features: np.ndarray, labels: np.ndarray, base: float):
    """Logistic regression by Newton steps with a small ridge. ``base``: the share of
    label 1 among all labelled documents, which the sample need not have."""
    model.means = features.mean(axis=0)
    model.scales = features.std(axis=0) + 1e-6
    x = np.column_stack([(features - model.means) / model.scales, np.ones(len(features))])
    share = labels.mean()
    weight = np.where(labels == 1, base / share, (1 - base) / (1 - share))
    ridge = np.eye(x.shape[1]) * 0.5
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (labels - p)) - ridge @ w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        w += np.linalg.solve(hessian, gradient)
    model.weights, model.bias = w[:-1], float(w[-1])


def _plain(by_label: list[list[bytes]], settings: Settings) -> list[bytes]:
    """A dictionary of each label's windows, in no order."""
    rng = np.random.default_rng(11)
    out = []
    for own in by_label:
        windows = [w for t in own for w in settings.windows(t)]
        out.append(_trained([windows[i] for i in rng.permutation(len(windows))], PLAIN))
    return out


def _contrasting(by_label: list[list[bytes]], settings: Settings) -> list[bytes]:
    """Dictionaries that share their stock and differ in typical stretches."""
    by_label = [list(dict.fromkeys(own)) for own in by_label]  # copies are no evidence
    counts = [_document_counts(own) for own in by_label]
    sizes = [max(1, len(own)) for own in by_label]
    typical = [_typical(counts[k], sizes[k], counts[1 - k], sizes[1 - k]) for k in (0, 1)]
    either = typical[0] | typical[1]
    windows = [w for own in by_label for t in own for w in settings.windows(t)]
    stock = _trained([w for w in windows if not either[_gram_codes(w)].any()], STOCK)
    own = [_cover(by_label[k], typical[k], OWN) for k in (0, 1)]
    # Both of one length, so that the stock lies at the same distance from a window.
    size = max(map(len, own))
    return [stock + bytes(size - len(o)) + o for o in own]


def fit(texts: list[str], labels: list[int], settings: Settings, base: float) -> CompressionModel:
    """Dictionaries from half of the labelled texts, calibration from the other half,
    for a dictionary knows its own training text too well."""
    parts = [[], []]
    for i, (text, label) in enumerate(zip(texts, labels, strict=True)):
        parts[i % 2].append((settings.bytes_of(text), label))
    by_label = [[t for t, y in parts[0] if y == label] for label in (0, 1)]
    makers = [_plain, _contrasting] if settings.contrast else [_plain]
    pairs = [tuple(reversed(make(by_label, settings))) for make in makers]
    model = CompressionModel(settings, pairs)
    features = model.features([t for t, _ in parts[1]])
    known = np.array([y for _, y in parts[1]])
    if 0 < known.sum() < len(known):
        _calibrate(model, features, known, base)
    else:
        _constant(model, base)
    return model


def _constant(model: CompressionModel, base: float) -> None:
    n = FEATURES * len(model.pairs)
    model.means, model.scales, model.weights = np.zeros(n), np.ones(n), np.zeros(n)
    base = min(max(base, 1e-6), 1 - 1e-6)
    model.bias = float(np.log(base / (1 - base)))


def constant_model(settings: Settings, base: float = 0.5) -> CompressionModel:
    """A model without labelled text: every text scores ``base``."""
    model = CompressionModel(settings, [(b"\0" * 8, b"\0" * 8)])
    _constant(model, base)
    return model


def _passages(text: str) -> str:
    """A bounded part of a long text, in passages evenly spaced over all of it."""
    if len(text) <= DOC_BYTES:
        return text
    n = DOC_BYTES // PASSAGE_BYTES
    step = (len(text) - PASSAGE_BYTES) / (n - 1)
    return "\n".join(text[int(i * step) : int(i * step) + PASSAGE_BYTES] for i in range(n))


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    settings: Settings,
    doc_id: str = "doc_id",
    text: str = "text",
    per_label: int = PER_LABEL,
) -> CompressionModel:
    """A model from about ``per_label`` documents of either label, chosen by a hash.

    The driver holds at most ``4 * per_label * DOC_BYTES`` characters of them. Rows
    of ``labels`` without an id or with a label other than 0 and 1 are left out; of
    several rows for an id the smallest label counts. Without documents of both
    labels every text scores the share of label 1 (one half, if nothing is known).
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("doc_id"))
        .agg(F.min(label).cast("int").alias("label"))
    )
    usable = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts:
        return constant_model(settings)
    million = 1_000_000
    shares = [min(million, -(-per_label * million // counts.get(k, 1))) for k in (0, 1)]
    share = F.when(F.col("label") == 1, F.lit(shares[1])).otherwise(F.lit(shares[0]))
    place = F.pmod(F.xxhash64(F.lit("compression"), "doc_id"), F.lit(million))
    # Bounded: about ``per_label`` ids of each label, so the texts need no shuffle.
    chosen = known.where(place < share).limit(4 * per_label)

    def shorten(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rows_in_pieces(whole):
                short = [_passages(t or "") for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), pa.array(short, pa.string())], ["label", "text"]
                )

    sample = usable.join(F.broadcast(chosen), "doc_id").select("label", "text")
    rows = sample.mapInArrow(shorten, "label int, text string").limit(4 * per_label).collect()
    rows = sorted((r["text"], r["label"]) for r in rows)
    order = np.random.default_rng(5).permutation(len(rows))
    rows = [rows[i] for i in order]
    base = counts.get(1, 0) / sum(counts.values())
    if len({y for _, y in rows}) < 2:
        return constant_model(settings, base)
    return fit([t for t, _ in rows], [y for _, y in rows], settings, base)


def score_texts(
    docs: DataFrame,
    model: CompressionModel,
    threshold: float,
    text: str = "text",
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1, and ``predicted``, 1 where
    it reaches ``threshold`` (columns of those names are replaced).

    Whole texts are read. Null and empty texts have no window and score as such,
    the same everywhere; repeated rows stay as they are.
    """
    left_out = {"score", "predicted"} | (set() if keep_text else {text})
    others = [c for c in docs.columns if c not in left_out]
    schema = docs.select(*others).schema.add("score", "double").add("predicted", "integer")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rows_in_pieces(whole):
                held = shared.value
                texts = batch.column(text).to_pylist()
                found = held.scores(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in others),
                        pa.array(found, pa.float64()),
                        pa.array((found >= threshold).astype(np.int32)),
                    ],
                    [*others, "score", "predicted"],
                )

    return docs.select(*dict.fromkeys([*others, text])).mapInArrow(tidy(score), schema)
