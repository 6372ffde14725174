"""SimHash groups and exact top-k search against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from clubledger.llm import simhash_bk, topk_pivots

DOCS = "doc_id bigint, text string"


def brute_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    shingles = [words[i : i + k] for i in range(len(words) - k + 1)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(values))]


def documents():
    rnd = random.Random(3)
    rows = [(i, None if i < 2 else "" if i < 4 else "Word") for i in range(6)]
    for i in range(10, 60):
        base = [rnd.choice("abcdefghij") * 3 + str(rnd.randint(0, 9)) for _ in range(rnd.choice([2, 30, 400]))]
        rows.append((i, " ".join(base)))
        for c in range(rnd.randint(0, 3)):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = "Changed"
            rows.append((1000 + 10 * i + c, "\t".join(copy)))
    return [*rows, rows[20], rows[20], (None, rows[20][1]), (None, "all alone here and nowhere else")]


def test_groups(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, DOCS).withColumn("value", F.lit(1)).withColumn("component", F.lit(2))
    values = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(values, 4)
    low = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    want = sorted(
        (str(i), f"{v:016x}", str(low.get(r))) for (i, _), v, r in zip(rows, values, roots, strict=True)
    )
    found = simhash_bk.simhash_groups(docs).collect()
    assert sorted((str(a), b, str(c)) for a, b, c in found) == want
    kept = simhash_bk.one_per_group(docs)
    assert kept.columns == docs.columns
    more = docs.withColumns({c: F.lit(f"own {c}") for c in ("_text_key", "winner", "w", "i", "h")})
    again = simhash_bk.one_per_group(more)
    assert again.columns == more.columns
    assert {tuple(r[c] for c in more.columns[-5:]) for r in again.collect()} == {
        ("own _text_key", "own winner", "own w", "own i", "own h")
    }
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(roots))
    assert set(ids) == {low.get(r) for r in roots}


@pytest.mark.parametrize("shard_rows", [3, 4096])
@pytest.mark.parametrize("radius", [0, 2, 4])
def test_links_connect_what_pairs_connect(spark, shard_rows, radius):
    rnd = random.Random(radius)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    values = {0, (1 << 64) - 1, *(c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for c in centres for _ in range(20))}
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    table = spark.createDataFrame([(v,) for v in signed], "value bigint")
    links = simhash_bk.fingerprint_links(table, radius, shard_rows).collect()
    unsigned = sorted(values)
    place = {v: i for i, v in enumerate(signed)}
    parent = list(range(len(signed)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_signed = dict(zip(signed, unsigned, strict=True))
    for r in links:
        parent[root(place[r.a])] = root(place[r.b])
    got = [root(i) for i in range(len(signed))]
    want = brute_components([by_signed[s] for s in signed], radius)
    pairs = [(i, j) for i in range(len(signed)) for j in range(i)]
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i, j in pairs)


def test_dense_shard_has_one_link_per_member():
    values = [1 << i for i in range(60)] + [0]
    assert len(simhash_bk.shard_links(values, 4)) == len(values) - 1


def test_blocks_grow_with_the_number_of_fingerprints():
    assert simhash_bk._blocks(1_000, 4, 4096) == 5
    assert simhash_bk._blocks(10**9, 4, 4096) == 6
    assert simhash_bk._blocks(10**9, 0, 4096) == 1


def brute_top(rows, k, every):
    vectors = [
        (i, [int(np.floor(64 * float(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    queries = {}
    for i, v in vectors:
        if i % every == 0:
            width = max(len(x) for _, x in vectors)
            padded = v + [0] * (width - len(v))
            queries[i] = min(queries.get(i, padded), padded)
    for i, q in queries.items():
        scores = sorted(
            ((-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i)
        )[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows, block", [(16384, 4096), (50, 7)])
def test_top_k_is_exact(spark, shard_rows, block):
    rnd = random.Random(9)
    rows = [(i, [rnd.gauss(i % 4, 1) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(120)]  # one very common vector
    rows += [(3000, [0.0] * 6), (3005, None), (3010, [1.0, None, 2.0, 3.0, 4.0, 5.0])]
    rows += [(3015, [float("nan")] * 6), (3020, [float("inf")] * 6), (None, [9.0] * 6)]
    rows += [(3025, [50.0, -3.0]), (3030, []), (20, rows[20][1]), (40, rows[41][1])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("pivot", F.lit(0))
    found = topk_pivots.top_k(
        table, F.col("vec_id") % 5 == 0, k=10, shard_rows=shard_rows, block_queries=block, pivots=9
    )
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())
    assert got == brute_top(rows, 10, 5)


def test_top_k_of_large_components_and_of_nothing(spark):
    rows = [(i, [float(3**14 + i), float(-(2**20) * i)]) for i in range(12)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = topk_pivots.top_k(table, F.col("vec_id") % 5 == 0, k=4)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())
    assert got == brute_top(rows, 4, 5)
    assert topk_pivots.top_k(table.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert simhash_bk.simhash_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_search_leaves_far_annuli_out():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(4, 8)) * 300
    vectors = np.floor(np.repeat(centres, 500, axis=0) + rng.normal(size=(2000, 8)))
    sphere = topk_pivots.Sphere((vectors**2).sum(axis=1).max(), vectors[[0, 500, 1000, 1500]])
    distances = sphere.distances(vectors)
    assert (distances.argmin(axis=1) == np.arange(2000) // 500).mean() > 0.95
    query = vectors[:1]
    scores = np.sort(vectors @ query[0])[::-1]
    reach = sphere.radius(np.linalg.norm(query, axis=1), scores[19:20])
    at = sphere.query_distances(query)[0]
    low = np.array([distances[distances.argmin(axis=1) == p, p].min() for p in range(4)])
    high = np.array([distances[distances.argmin(axis=1) == p, p].max() for p in range(4)])
    gaps = np.maximum(0, np.maximum(low - at, at - high))
    assert (gaps <= reach[0]).sum() < 4


def test_search_of_sorted_batches_holds_one_shard_at_a_time():
    rng = np.random.default_rng(1)
    vectors = np.floor(rng.normal(size=(90, 5)) * 20)
    sphere = topk_pivots.Sphere((vectors**2).sum(axis=1).max(), vectors[:3])
    distances = sphere.distances(vectors)
    pivot = distances.argmin(axis=1)
    rows = pd.DataFrame({
        "pivot": pivot, "part": 0, "block": 0, "is_query": False, "id": np.arange(90),
        "vector": list(vectors), "distance": distances.min(axis=1), "bound": np.nan,
    })
    asked = pd.concat([
        rows.iloc[::7].assign(pivot=p, is_query=True, distance=np.nan, bound=-np.inf) for p in range(3)
    ])
    # Nobody asks shard (9, 0, 0), and (9, 1, 0) is asked but has no vectors.
    idle = rows.iloc[:3].assign(pivot=9)
    vain = asked.iloc[:2].assign(pivot=9, part=1)
    stream = pd.concat([rows, asked, idle, vain]).sort_values([*topk_pivots.KEY, "is_query"])
    for size in (1, 4, 1000):
        batches = [stream.iloc[i : i + size] for i in range(0, len(stream), size)]
        out = pd.concat(topk_pivots.search_sorted(iter(batches), sphere, 5, 6, True))
        best = out.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        best = best.groupby("query_id").head(6)
        for q in range(0, 90, 7):
            scores = vectors @ vectors[q]
            expected = sorted((-scores[j], j) for j in range(90) if j != q)[:6]
            mine = best[best["query_id"] == q]
            assert list(zip(-mine["score"], mine["vec_id"])) == expected
