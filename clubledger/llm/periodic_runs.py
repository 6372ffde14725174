"""Periodic runs of words, found by a dictionary of basic factors.

The factors of power-of-two length ``l`` that a document holds get names: equal
factors of one document, equal names. A name of length ``2 l`` is the pair of names of
its halves, so every length costs one sort of the positions that still matter, which
are those whose factor occurs again in the document.

The successor of a position is the next one with the same name. In a run of smallest
period ``q`` and at least four periods, the factors of a length from ``q`` to below
``2 q`` recur at distance ``q`` and never sooner, because the period is not itself a
repetition. So the positions of a run, except for its last ``q + l - 1``, have
successors at the one distance ``q``: arithmetic progressions side by side. Each
maximal stretch of neighbours with an equal distance proposes that period and is
extended by the period and the factor to the whole run; the progression's first
position has no neighbour before it that continues the period, so the run is maximal.
Distances up to ``l / 2`` are left to shorter factors, which see the same run, and
distances beyond ``l``, though within ``2 l``, to the next length, where they are
certain to be smallest periods. Proposals of the same run are made one.

Documents are taken together by the hundred thousand words, so that a sort serves
many short ones; a document longer than that is taken by itself, whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clubledger.llm.common import rows_in_pieces, tidy

#: A run has at least this many words and this many times its period.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words whose factors are named together; a longer document is named by itself.
WORDS_AT_ONCE = 1 << 17
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _stretches(first: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of neighbouring positions that share a distance."""
    breaks = np.flatnonzero((np.diff(first) != 1) | (np.diff(distance) != 0)) + 1
    return np.concatenate([[0], breaks]), np.concatenate([breaks, [len(first)]]) - 1


def runs_of(
    words: np.ndarray,
    sizes: np.ndarray,
    least_words: int = LEAST_WORDS,
    least_periods: int = LEAST_PERIODS,
) -> np.ndarray:
    """``(start, length, period)`` of all runs in documents that lie one after another.

    ``words`` are numbers of words, ``sizes`` the documents' numbers of words; starts
    are positions in ``words``. Sorted by start and period.
    """
    if least_periods < 4:
        raise ValueError("runs of fewer than four periods are not certain to be proposed")
    total, longest = len(words), int(sizes.max(initial=0))
    at = np.arange(total)
    document = np.repeat(np.arange(len(sizes)), sizes)
    room = np.repeat(np.cumsum(sizes), sizes) - at  # words up to the document's end
    name = document * (int(words.max(initial=0)) + 1) + words
    named = np.empty(total, dtype=np.int64)
    found, length = [np.empty((0, 3), dtype=np.int64)], 1
    while len(at) and length // 2 < longest // least_periods:
        order = np.argsort(name, kind="stable")
        place, name = at[order], name[order]
        same = name[1:] == name[:-1]
        distance = np.diff(place)
        near = same & (distance <= length) & (2 * distance > length)
        first, step = place[:-1][near], distance[near]
        if len(first):
            order = np.argsort(first)
            first, step = first[order], step[order]
            low, high = _stretches(first, step)
            period = step[low]
            extent = first[high] - first[low] + period + length
            long = extent >= np.maximum(least_words, least_periods * period)
            found.append(np.column_stack([first[low], extent, period])[long])
        again = np.zeros(len(place), dtype=bool)
        again[1:] |= same
        again[:-1] |= same
        number = np.cumsum(np.concatenate([[True], ~same])) if len(place) else place
        named.fill(-1)
        named[place[again]] = number[again]
        at = np.sort(place[again])
        at = at[room[at] >= 2 * length]
        at = at[named[at + length] >= 0]
        name = named[at] * (total + 1) + named[at + length]
        length *= 2
    every = np.unique(np.concatenate(found), axis=0)
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def kept_words(total: int, runs: np.ndarray) -> np.ndarray:
    """Whether a word is in no run or only among the first period of its runs."""
    change = np.zeros(total + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:total]) == 0


def _numbered(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    words = (numbers.setdefault(w, len(numbers)) for d in documents for w in d)
    return np.fromiter(words, np.int64, int(sizes.sum())), sizes


def _search(
    documents: list[list[bytes]], least_words: int, least_periods: int
) -> tuple[list[np.ndarray], list[bytes]]:
    """The runs of each document, starts within it, and its kept words joined."""
    words, sizes = _numbered(documents)
    runs = runs_of(words, sizes, least_words, least_periods)
    kept = kept_words(len(words), runs)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    cuts = np.searchsorted(runs[:, 0], bounds)
    own, rest = [], []
    for i, document in enumerate(documents):
        mine = runs[cuts[i] : cuts[i + 1]]
        own.append(mine - [bounds[i], 0, 0])
        if len(mine):
            document = [w for w, k in zip(document, kept[bounds[i] : bounds[i + 1]]) if k]
        rest.append(b" ".join(document))
    return own, rest


def _groups(column: pa.Array) -> Iterator[list[list[bytes]]]:
    """Documents as lists of words, several to a group up to ``WORDS_AT_ONCE``.

    ``bytes.split`` parts at the ASCII blanks and at nothing else, and no byte of a
    longer UTF-8 character is one of them."""
    group, size = [], 0
    for text in column:
        words = (text.as_py() or b"").split()
        if group and size + len(words) > WORDS_AT_ONCE:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def periodic_runs(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least_words: int = LEAST_WORDS,
    least_periods: int = LEAST_PERIODS,
) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` of every document.

    ``runs`` holds start, length and period, in words and from word 0, of every
    maximal stretch with that smallest period, at least ``least_words`` words and
    ``least_periods`` periods long (four or more), sorted by start and period.
    ``collapsed`` is the text with the first period of each run only, words joined by
    one space. Words are runs of characters other than ASCII blanks, compared as they
    are. A null or empty text has no words, no runs and an empty collapsed text.
    Repeated rows and rows without an id have a row each; other columns are not read.
    Nothing is shuffled; a worker holds about ``WORDS_AT_ONCE`` words, or one whole
    document if that is longer, at some hundred bytes a word.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
        for whole in batches:
            for batch in rows_in_pieces(whole):
                start = 0
                for group in _groups(batch.column("text").cast(pa.binary())):
                    runs, rest = _search(group, least_words, least_periods)
                    flat = np.concatenate(runs)
                    offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
                    parts = [pa.array(flat[:, c], pa.int64()) for c in range(3)]
                    values = pa.StructArray.from_arrays(parts, fields=list(kind))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").slice(start, len(group)),
                            pa.array([len(d) for d in group], pa.int64()),
                            pa.ListArray.from_arrays(pa.array(offsets), values),
                            pa.array([r.decode() for r in rest], pa.string()),
                        ],
                        ["doc_id", "n_words", "runs", "collapsed"],
                    )
                    start += len(group)

    schema = f"doc_id {id_type}, n_words bigint, runs array<{RUN}>, collapsed string"
    return narrow.mapInArrow(tidy(search), schema)
