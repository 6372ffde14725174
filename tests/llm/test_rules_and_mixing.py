"""Quality rules and source mixing against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clubledger.llm import mixing
from clubledger.llm.quality_rules import MEASURES, POLICIES, ablations, apply_policy, rule_ledger

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def measured(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return {
        "n_words": len(words),
        "word_chars": sum(len(w.decode()) for w in words),
        "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def texts():
    rnd = random.Random(4)
    words = ["a", "bb", "ccc", "d#", "é", "€uro", " x", "|", "\x1cy"]
    out = [None, "", " \n\t\n ", "one", "a\x0bb\x0cc\rd", "x\ny\nx\n\nx\n"]
    for n in (7, 8, 9, 30, 300):
        out.append(" ".join(rnd.choice(words) for _ in range(n)))
    out.append("\n".join(["the same line of eight words goes here"] * 40))
    out.append(" ".join(["w"] * 20) + " " + " ".join(f"v{i}" for i in range(200)))
    return out


def test_measurements_and_bits(spark):
    rows = [(i % 5 or None, t, "x", i) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words string, row int")
    found = {r["row"]: r for r in apply_policy(rule_ledger(docs), "base-1").collect()}
    assert len(found) == len(rows)
    for _, text, _, row in rows:
        want = measured(text)
        assert {m: found[row][m] for m in MEASURES} == want, text
        failed = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        assert found[row]["kept"] == (not failed)
        assert bool(found[row]["failures"] & 3) == failed


def test_columns_of_the_documents_stay(spark):
    names = ("_words", "_lines", "_glued", "_at", "_hashes", "_sorted", "_starts", "own")
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id bigint, text string")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in names})
    found = apply_policy(rule_ledger(docs), "prose-1").collect()
    assert [{c: r[c] for c in names} for r in found] == [{c: f"own {c}" for c in names}] * 2


def test_a_filter_on_the_verdict_keeps_the_steps_apart(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(50)))], "doc_id bigint, text string")
    kept = apply_policy(rule_ledger(docs), "prose-1").where("kept").select("doc_id")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") == 1
    assert kept.count() == 1


def test_ablations_are_bit_arithmetic(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id bigint, text string")
    ledger = rule_ledger(docs)
    bits = [r[0] for r in ledger.select("failures").collect()]
    found = {(r.policy, r.rule): r for r in ablations(ledger).collect()}
    names = list(POLICIES["prose-1"])
    for policy, rules in POLICIES.items():
        mask = sum(1 << names.index(r) for r in rules)
        for rule in rules:
            bit = 1 << names.index(rule)
            got = found[policy, rule]
            assert got.n_failed == sum(bool(b & bit) for b in bits)
            assert got.n_failed_alone == sum(b & mask == bit for b in bits)
            assert got.n_kept_without == sum(not b & mask & ~bit for b in bits)


def targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight, again and again, until no source is above its bound."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, float(sum(sizes.values()))
    while True:
        rest = [s for s in names if s not in fixed]
        if not rest:
            return fixed
        share = (total - sum(fixed.values())) / sum(weight[s] for s in rest)
        above = [s for s in rest if share * weight[s] > most * sizes[s]]
        if not above:
            return fixed | {s: share * weight[s] for s in rest}
        fixed |= {s: float(most * sizes[s]) for s in above}


def documents(seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = rnd.choice(["b", "a", "hot", "hot", "hot", "", None, "é"])
        size = 0 if rnd.random() < 0.05 else rnd.randint(1, 200)
        rows.append((i, " ".join(["w"] * size) if size else None, "en", source, 1))
    return [*rows, *rows[:20], (None, "x y", "en", "a", 1), (None, "x y", "en", "a", 1), (5000, "q", "en", "tiny", 1)]


@pytest.mark.parametrize("block", [4, 96])
def test_mix_meets_its_targets(spark, block):
    rows = documents(1)
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash"))
    found = mixing.mixing_decisions(docs, block=block).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in found) == Counter(
        (r[0], r[3], len((r[1] or "").split())) for r in rows
    )
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want, taken = targets(sizes), Counter()
    for r in found:
        taken[r.source] += r.taken
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"]
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert abs(r.copies - r.target / r.source_size) < 1
    for source, target in want.items():
        assert abs(taken[source] - target) <= 101  # half of the largest document
    again = mixing.mixing_decisions(docs.repartition(7), block=block).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))


def test_expected_copies(spark):
    # Over many seeds documents of every size are taken as often as their source asks for.
    rows = [(i, " ".join(["w"] * (i // 2 % 7 + 1)), "en", "ab"[i % 2], 1) for i in range(280)]
    docs = spark.createDataFrame(rows, DOCS).cache()
    total, rates, seeds = Counter(), {}, range(8)
    for seed in seeds:
        for r in mixing.mixing_decisions(docs, seed=seed, block=8).collect():
            total[r.source, r["size"]] += r.copies
            rates[r.source] = r.target / r.source_size
            assert int(rates[r.source]) <= r.copies <= int(rates[r.source]) + 1
    # 20 documents of a size and source, 8 times: the standard error is below 0.04.
    for (source, _), copies in total.items():
        assert copies / 160 == pytest.approx(rates[source], abs=0.16)
    assert len(total) == 14


def test_mixed_documents_are_the_decided_copies(spark):
    rows = documents(2, 120)
    docs = spark.createDataFrame(rows, DOCS)
    taken = Counter()
    for r in mixing.mixing_decisions(docs).collect():
        taken[r.doc_id, r.source] += r.copies
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == +taken
    names = ("_size", "_row", "unit", "copies", "rows", "row", "place", "size", "i", "s", "n")
    more = docs.withColumns({c: F.lit(f"own {c}") for c in names})
    again = mixing.mixed_documents(more)
    assert again.columns == more.columns
    found = again.collect()
    assert Counter((r.doc_id, r.source) for r in found) == +taken
    assert {tuple(r[c] for c in names) for r in found} == {tuple(f"own {c}" for c in names)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert rule_ledger(none).count() == 0
    assert mixing.mixing_decisions(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0
