"""Vector codes, periodic runs and archives against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from clubledger.llm import periodic_runs as runs_module
from clubledger.llm import queries, warc
from clubledger.llm.periodic_runs import kept_words, periodic_runs, runs_of
from clubledger.llm.vector_codes import (
    curve_order,
    encode_vectors,
    hilbert_index,
    make_blocks,
    shortlists,
)
from clubledger.llm.warc import (
    DamagedArchive,
    archive_frames,
    parse_record,
    read_archives,
    read_record,
    write_archives,
)


# -- vector codes -----------------------------------------------------------------------
def plain_codes(rows, parts=16, n_entries=64, rounds=2, factor=256):
    """Codes, errors and the codebook of ``(vec_id, vector, label)`` rows."""
    kept = [
        (i, [int(np.floor(float(x) * factor)) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts)) * parts
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    each = width // parts

    def cut(v, j):
        return v[j * each : (j + 1) * each]

    book = [[cut(v, j) for _, v, _ in kept[:n_entries]] for j in range(parts)]

    def closest(v, j):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, j), c)), e) for e, c in enumerate(book[j]))

    for _ in range(rounds):
        members = [[[] for _ in b] for b in book]
        for _, v, _ in kept:
            for j in range(parts):
                members[j][closest(v, j)[1]].append(cut(v, j))
        book = [
            [[sum(x) // len(m) for x in zip(*m)] if m else c for c, m in zip(b, ms)]
            for b, ms in zip(book, members)
        ]
    out = []
    for i, v, label in kept:
        found = [closest(v, j) for j in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    total = {}
    for _, label, _, error in out:
        total[label] = total.get(label, 0) + error
    return sorted(map(str, [(*r, total[r[1]]) for r in out])), book


def vector_frame(spark, rows, schema="vec_id long, embedding array<float>, label int"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("chunk_rows", [None, 7, 50])
def test_codes_as_plain_python(spark, chunk_rows):
    rng = random.Random(chunk_rows or 1)
    rows = [
        (i, [round(rng.gauss(0, 0.2), 3) for _ in range(32)], rng.choice([None, 1, 2]))
        for i in range(150)
    ]
    rows += [rows[3], rows[3], (None, rows[5][1], 1), (-4, [0.0] * 32, 2), (-4, [0.5] * 32, 2)]
    rows += [(7, None, 1), (8, [0.1] * 31 + [None], 1), (9, [float("nan")] * 32, 1)]
    rows += [(10, [float("-inf")] + [0.0] * 31, None)]
    coded, book = encode_vectors(vector_frame(spark, rows).repartition(3), chunk_rows=chunk_rows)
    found = sorted(str(tuple(r)) for r in coded.collect())
    expected, plain_book = plain_codes(rows)
    assert found == expected
    assert book.tolist() == plain_book


def test_ties_unused_entries_and_clashing_names(spark):
    rows = [(i, [float(i % 3)] * 16, i % 2) for i in range(90)]
    extra = vector_frame(spark, rows).withColumns(
        {c: F.lit("x") for c in ("code", "error", "key", "n", "vector", "raw", "ids", "label_error")}
    )
    coded, book = encode_vectors(extra, entries=5)
    expected, plain_book = plain_codes(rows, n_entries=5)
    assert sorted(str(tuple(r)) for r in coded.collect()) == expected
    assert book.tolist() == plain_book


def test_short_and_ragged_vectors(spark):
    rows = [(1, [0.5, -0.5, 0.25], 1), (2, [], 1), (3, [0.1] * 20, None), (4, [0.5, -0.5], None)]
    coded, book = encode_vectors(vector_frame(spark, rows))
    expected, plain_book = plain_codes(rows)
    assert sorted(str(tuple(r)) for r in coded.collect()) == expected
    assert book.tolist() == plain_book and book.shape == (16, 4, 2)


def test_no_vectors(spark):
    coded, book = encode_vectors(vector_frame(spark, []))
    assert coded.collect() == [] and book.size == 0
    assert coded.columns == ["vec_id", "label", "code", "error", "label_error"]
    assert encode_vectors(vector_frame(spark, [(1, None, 2), (2, [None], 2)]))[0].collect() == []


def test_large_numbers(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-2.0**17, 2.0**17) for _ in range(16)], 0) for i in range(100)]
    coded, book = encode_vectors(vector_frame(spark, rows, "vec_id long, embedding array<double>, label int"))
    expected, plain_book = plain_codes(rows)
    assert sorted(str(tuple(r)) for r in coded.collect()) == expected
    assert book.tolist() == plain_book
    with pytest.raises(Exception, match="no exact distances"):
        encode_vectors(vector_frame(spark, [(1, [1e9] * 16, 1)]))[0].collect()


@pytest.mark.parametrize("dimensions, bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_neighbours(dimensions, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions), -1).reshape(-1, dimensions)
    place = hilbert_index(grid, bits)
    assert sorted(place) == list(range(len(grid)))
    steps = np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1)
    assert set(steps) == {1}


def test_blocks_are_smaller_on_the_curve_and_lists_lose_nothing():
    rng = np.random.default_rng(4)
    points = rng.normal(0, 40, (16384, 4)).astype(np.int64)
    entries = points[:64]
    order, full, low, high, sums = make_blocks(points, 16)
    assert sorted(order) == list(range(16384)) and (sums.sum(axis=0) == points.sum(axis=0)).all()
    listed = shortlists(low, high, entries)
    grid = ((full[:, None] - entries[None]) ** 2).sum(axis=2)
    nearest = grid == grid.min(axis=1)[:, None]
    assert (listed.repeat(16, axis=0) | ~nearest).all()
    unsorted = points.reshape(-1, 16, 4)
    loose = shortlists(unsorted.min(axis=1), unsorted.max(axis=1), entries)
    assert listed.mean() < 0.6 * loose.mean()
    assert (curve_order(np.zeros((5, 70), dtype=np.int64)) == np.arange(5)).all()


# -- periodic runs ------------------------------------------------------------------------
def plain_runs(words):
    """All runs of a list of words, by definition."""
    n, out = len(words), []
    for period in range(1, n // 4 + 1):
        i = 0
        while i + period < n:
            if words[i] != words[i + period]:
                i += 1
                continue
            start = i
            while i + period < n and words[i] == words[i + period]:
                i += 1
            run = words[start : i + period]
            smaller = any(run[q:] == run[:-q] for q in range(1, period))
            if len(run) >= max(6, 4 * period) and not smaller:
                out.append((start, len(run), period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    words = [rng.choice("abcä") for _ in range(rng.randint(0, 70))]
    if words and rng.random() < 0.7:
        a = rng.randrange(len(words))
        p = 1 + rng.randrange(1 + (len(words) - a) // 3)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "x"
    return words


def test_runs_as_by_definition():
    rng = random.Random(7)
    for _ in range(400):
        documents = [random_words(rng) for _ in range(rng.randint(0, 4))]
        flat = [ord(w) for d in documents for w in d]
        sizes = np.array([len(d) for d in documents], dtype=np.int64)
        found = runs_of(np.array(flat, dtype=np.int64), sizes)
        starts = np.cumsum([0, *sizes])
        expected = [
            (s + at, n, p) for at, d in zip(starts, documents) for s, n, p in plain_runs(d)
        ]
        assert [tuple(r) for r in found.tolist()] == expected


def test_nested_and_touching_runs():
    words = ("a a a a a a b " * 5 + "c d " * 4 + "d " * 6).split()
    numbers = np.array([ord(w) for w in words])
    found = [tuple(r) for r in runs_of(numbers, np.array([len(words)])).tolist()]
    assert found == plain_runs(words) and (0, 35, 7) in found and (0, 6, 1) in found
    assert kept_words(len(words), np.array(found)).sum() < len(words) / 3
    with pytest.raises(ValueError):
        runs_of(numbers, np.array([len(words)]), least_periods=3)


def planted(doc_id, text):
    words = re_words(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def re_words(text):
    return [w.decode() for w in (text or "").encode().split()]


def plain_row(doc_id, text):
    words = planted(doc_id, text)
    runs = plain_runs(words)
    drop = {i for s, n, p in runs for i in range(s + p, s + n)}
    collapsed = " ".join(w for i, w in enumerate(words) if i not in drop)
    best = [None] * 4
    if runs:
        s, n, p = min(runs, key=lambda r: (-(r[1] * 10**9 // r[2]), r[0], r[2]))
        best = [s, n, p, 1000 * n // p]
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (doc_id, len(runs), *best, *[hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed)])


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize("at_once", [1 << 17, 40])
def test_run_query_against_brute_force(spark, tmp_path, monkeypatch, at_once):
    monkeypatch.setattr(runs_module, "WORDS_AT_ONCE", at_once)
    rng = random.Random(11)
    rows = [(i, " \t\n".join(random_words(rng)) + rng.choice(["", " ", "\x0b"])) for i in range(120)]
    rows += [(None, "a a a a a a a b"), (None, None), (500, None), (501, ""), (502, " \n ")]
    rows += [(503, "x y " * 9), (503, "x y " * 9), (504, "  " * 7 + "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit(1) for c in ("words", "n", "a", "p", "g", "runs", "best", "collapsed", "start")}
    )
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op12_periodic_runs(spark, str(tmp_path)).select(*RUN_COLUMNS).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str(plain_row(*r)) for r in rows)


def test_run_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs(empty).collect() == []
    long_word, many = "w" * 3_000_000, " ".join(str(i % 1000) for i in range(400_000))
    rows = [(1, long_word), (2, many), (3, f"{long_word} " * 2)]
    found = {r["doc_id"]: r for r in periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(r) for r in found[2]["runs"]] == [(0, 400_000, 1000)]
    assert found[2]["collapsed"] == " ".join(str(i) for i in range(1000))
    assert found[1]["runs"] == [] and found[1]["collapsed"] == long_word


# -- archives -------------------------------------------------------------------------------
PAGE = "<html><head><title>{0}</title></head><body>{1}</body></html>"


def page_rows(rng, n=300):
    texts = [PAGE.format(i, f"wörter und {i} " * rng.randint(1, 60)) for i in range(60)]
    rows = [(i, f"http://h/{i}", rng.choice(texts)) for i in range(n)]
    rows += [(1000, "http://a\r\nb", "x" * 99), (1001, None, "x" * 99), (1002, "", "y" * 100)]
    rows += [(999, "http://z", "y" * 100), (1003, "u", None), (1004, "u", ""), (None, "u", "y" * 100)]
    rows += [(None, None, "q" * 200), (None, None, "q" * 200), (2000, "v: w", "r" * 150)]
    rows += [(2000, "v: w", "r" * 150)] * 7 + [(2001, "v", "r" * 150), (2000, "t", "r" * 150)]
    return rows


def plain_pages(rows):
    groups, out = {}, []
    for i, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    for data, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        for k, i in enumerate(ids):
            again = k > 0 and len(data) >= 100
            kind = ("revisit", ids[0]) if again else ("response", None)
            out.append((i, len(data), hashlib.sha256(data).hexdigest(), *kind))
    return sorted(map(str, out))


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("archive_bytes, copies", [(1 << 25, 10_000), (5_000, 3)])
def test_archives_read_back(spark, tmp_path, archive_bytes, copies):
    rows = page_rows(random.Random(3))
    pages = spark.createDataFrame(rows, PAGES).withColumns(
        {c: F.lit(1) for c in ("payload", "digest", "size", "first", "m", "portion", "key", "heavy")}
    )
    path = str(tmp_path / "warc")
    write_archives(
        pages.repartition(4), path, archive_bytes=archive_bytes, copies_per_task=copies
    )
    back = read_archives(spark, path, payload_too=True)
    assert sorted(str(tuple(r)) for r in back.select(*COLUMNS).collect()) == plain_pages(rows)
    answers = back.where("record_type = 'response'").collect()
    texts = {(i, url): (html or "").encode() for i, url, html in rows}
    for r in answers:
        url = r["url"].replace("%0D%0A", "\r\n") if r["url"] else r["url"]
        assert bytes(r["payload"]) == texts[r["page_id"], url]
    row = answers[len(answers) // 2]
    content = bytes(
        spark.read.format("binaryFile").load(path).where(F.col("path") == row["file"]).first()["content"]
    )
    assert parse_record(read_record(content, row["offset"]))[2] == bytes(row["payload"])


def test_archive_is_a_sound_file_of_its_own(spark, tmp_path):
    rows = [(i, f"http://h/{i}", PAGE.format(i, f"Seite {i} " * 40)) for i in range(200)]
    path = tmp_path / "warc"
    write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), str(path), archive_bytes=10_000)
    files = sorted(path.glob("part-*"))
    assert len(files) > 3
    for file in files:
        content = file.read_bytes()
        assert content[:4] == b"\x5d\x2a\x4d\x18"  # the dictionary's frame
        size = int.from_bytes(content[4:8], "little")
        held = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(content[8 : 8 + size]))
        plain = zstandard.ZstdDecompressor(dict_data=held)
        rest = plain.stream_reader(content[8 + size :], read_across_frames=True).read()
        assert rest.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        frames = list(archive_frames(content))
        assert b"".join(r for _, r in frames) == rest
        names = [parse_record(r)[0]["WARC-Record-ID"] for _, r in frames]
        assert len(set(names)) == len(names)
    large = sum(f.stat().st_size for f in files)
    alone = sum(len(zstandard.compress(h.encode())) for _, _, h in rows)
    assert large < 0.9 * alone + 70_000 * len(files)


def test_damaged_archives():
    frame = zstandard.compress(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n")
    assert [r for _, r in archive_frames(frame)] == [b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"]
    for wrong in (frame[:-3], b"nothing of the kind", frame + b"\x5d\x2a\x4d\x18" + bytes(4)):
        with pytest.raises((DamagedArchive, zstandard.ZstdError)):
            list(archive_frames(wrong))
    with pytest.raises(DamagedArchive):
        parse_record(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab\r\n\r\n")
    with pytest.raises(DamagedArchive):
        parse_record(b"HTTP/1.1 200 OK\r\n\r\n")


def test_empty_pages_and_long_ones(spark, tmp_path):
    path = str(tmp_path / "empty")
    write_archives(spark.createDataFrame([], PAGES), path)
    assert read_archives(spark, path).collect() == []
    rows = [(1, "u", "ab" * 4_000_000), (2, "u", "ab" * 4_000_000), (3, None, None)]
    path = str(tmp_path / "long")
    write_archives(spark.createDataFrame(rows, PAGES), path)
    found = read_archives(spark, path).select(*COLUMNS).collect()
    assert sorted(str(tuple(r)) for r in found) == plain_pages(rows)
