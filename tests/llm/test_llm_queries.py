"""The registered queries and the pipeline over the smallest tables."""

import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from clubledger.llm.queries import QUERIES, SQL
from clubledger.llm.simhash_bk import fingerprint

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def documents(sql):
    return sql.sql("SELECT doc_id, text, lang, source FROM documents").fetchall()


def ids_of(name, text, end):
    library = Tokenizer.from_file(str(public_tokenizers.path(name)))
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def test_all_are_registered():
    names = contract.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES if q != "pipeline"}
    assert set(QUERIES) <= set(names) and set(SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "quality_rules", "simhash_near_dedup", "mixing", "packing",
    ]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sql, name):
    found = QUERIES[name](spark, str(DATA))
    columns = sorted(found.columns)
    expected = sql.sql(SQL[name])
    assert columns == sorted(expected.columns)
    rows = expected.select(*[f'"{c}"' for c in columns]).fetchall()
    assert Counter(map(str, rows)) == Counter(str(tuple(r)) for r in found.select(*columns).collect())


def test_token_queries(spark, documents):
    sums = Counter()
    seen = set()
    for _, text, lang, source in sorted(documents):
        if (text or "") not in seen:
            seen.add(text or "")
            sums[source, lang] += len(ids_of("byte_bpe_50k.json", text, 0))
    found = QUERIES["op2_token_counts"](spark, str(DATA)).collect()
    assert {(r.source, r.lang): r.n_tokens for r in found} == dict(sums)
    at = 0
    found = {r.doc_id: r for r in QUERIES["op7_token_files"](spark, str(DATA)).collect()}
    for i, text, *_ in sorted(documents):
        ids = ids_of("word_bpe_49k.json", text, 1)
        row = found.pop(i)
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert not found


def test_near_duplicate_query(spark, documents):
    prints = {i: fingerprint((t or "").encode(), 4) & (2**64 - 1) for i, t, *_ in documents}
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    found = QUERIES["op5_simhash_near_dedup"](spark, str(DATA)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {
        i: (f"{p:016x}", root(i)) for i, p in prints.items()
    }


@pytest.mark.parametrize("name, fold, folds", [("op6_toxicity", 1, 3), ("op9_language_id", 2, 4), ("op10_quality", 2, 4)])
def test_scores_cover_all_documents(spark, documents, name, fold, folds):
    found = QUERIES[name](spark, str(DATA)).collect()
    assert Counter(r.doc_id for r in found) == Counter(d[0] for d in documents)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
        assert 0 <= r.score <= 1
        assert name == "op9_language_id" or r.predicted == int(r.score >= 0.7)


def test_pipeline_stages(spark, sql, documents):
    table = kept = spark.read.parquet(f"{DATA}/documents.parquet")
    folder = corpus_pipeline.write_through
    before = {d[0]: d for d in documents}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = folder(stage(spark, kept, str(DATA)), name)
        assert after.columns == table.columns
        ids_before = Counter(r.doc_id for r in kept.select("doc_id").collect())
        rows = after.select("doc_id", "text", "lang", "source").collect()
        ids = Counter(r.doc_id for r in rows)
        assert all(tuple(r) == before[r.doc_id] for r in rows)
        if name == "language_id":
            assert len(ids) >= 0.98 * len(ids_before)
        if name == "quality_rules":
            verdicts = dict(sql.sql(f"SELECT doc_id, kept FROM ({SQL['op3_quality_rules']})").fetchall())
            assert ids == Counter(i for i in ids_before if verdicts[i])
        if name == "simhash_near_dedup":
            prints = {i: fingerprint((before[i][1] or "").encode(), 4) & (2**64 - 1) for i in ids_before}
            assert max(ids.values()) == 1 and set(ids) <= set(ids_before)
            near = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
            assert not near
            assert all(any((prints[a] ^ prints[b]).bit_count() <= 4 for b in prints if b != a) for a in set(prints) - set(ids))
        if name == "mixing":
            assert set(ids) <= set(ids_before) and max(ids.values()) <= 3
        kept = after
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(DATA)).collect()
    want = Counter()
    for i, n in ids.items():
        want[i] = n * len(ids_of("byte_bpe_50k.json", before[i][1], 0))
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == want


def test_the_rest_does_without(monkeypatch):
    import builtins
    import importlib

    real = builtins.__import__

    def absent(name, *args, **kwargs):
        if name.startswith("clubledger.llm"):
            raise ModuleNotFoundError(f"No module named '{name}'", name="clubledger.llm")
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", absent)
    names = importlib.reload(contract).queries()
    monkeypatch.undo()
    assert names and not any(n.startswith("op1") or n == "pipeline" for n in names)
    importlib.reload(contract)
