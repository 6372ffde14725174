"""Tokens, token files, token counts and packing against the tokenizers library."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clubledger.llm import packing, token_counts, token_files
from clubledger.llm.queries import QUERIES
from clubledger.llm.tokens import encoder

DOCS = "doc_id bigint, text string, lang string, source string, start string, ids_crc32 int"
BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def plain(name):
    library = Tokenizer.from_file(str(public_tokenizers.path(name)))
    return lambda text: library.encode(text or "", add_special_tokens=False).ids


PIECES = ["a", "Foo", "été", "ß", "İ", "'s", "don't", "x1", "...", "—", "<|endoftext|>", "日本", "é"]
PIECES += [" ", "  ", "\n", "\r\n", "\t", " ", " ", "\x1c", "\x85", "﻿", "=", "̸", "9", "#", "😀"]


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_ids_are_those_of_the_library(name):
    expected = plain(name)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join) | st.text(max_size=20))
    def same(text):
        coder = encoder(name)
        assert coder.ids(coder.encode([text])[0]).tolist() == expected(text)

    same()


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_added_tokens_are_found_anywhere(name):
    coder, expected = encoder(name), plain(name)
    words = [f"Wort{i}" for i in range(400)]
    for mark in ("<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "<|"):
        for at in (0, 1, 200, 399, 400):
            for glue in (" ", ""):
                text = " ".join(words[:at]) + glue + mark + glue + " ".join(words[at:])
                assert coder.ids(coder.encode([text])[0]).tolist() == expected(text)
    ids = expected("the end <|endoftext|> of it")
    assert len(ids) == (6 if name == BYTE else 5)
    assert coder.ids(coder.encode(["the end <|endoftext|> of it"])[0]).tolist() == ids


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr("clubledger.llm.tokens.REMEMBERED", 5)
    coder, expected = encoder(BYTE), plain(BYTE)
    coder.known, coder.older = {}, {}
    for text in ("a b c d e f g h", "h i j k l", "a b z", "q r s t u v w", "a b c"):
        assert coder.ids(coder.encode([text])[0]).tolist() == expected(text)
    assert len(coder.known) + len(coder.older) < 20


def test_memory_of_whole_words_is_bounded(monkeypatch):
    monkeypatch.setattr("clubledger.llm.tokens.REMEMBERED", 5)
    coder, expected = encoder(WORD), plain(WORD)
    monkeypatch.setattr(coder, "known", {})
    monkeypatch.setattr(coder, "older", {})
    for text in ("a b. c, d e f g h", "h, i j k l", "a b z!", "q r s t u v w x y", "z A, b! c a."):
        assert coder.ids(coder.encode([text])[0]).tolist() == expected(text)
    assert len(coder.known) + len(coder.older) < 40


def test_words_are_cut_once_and_not_text_by_text(monkeypatch):
    # Marks after a word are no part of it; other words are cut once in all texts.
    coder, expected = encoder(WORD), plain(WORD)
    monkeypatch.setattr(coder, "known", {})
    monkeypatch.setattr(coder, "older", {})
    cut, stretches = [], coder.stretches
    monkeypatch.setattr(coder, "stretches", lambda t: cut.append(t) or stretches(t))
    texts = ["The end, the\tEnd.\n", None, "", " \v", "été! été", "a~!b 12, the end.", "Don't~!", "x-ray"]
    texts = [*texts, *texts[::-1], "end (the end), a.b,c !!", "  the"]
    found = [coder.ids(data).tolist() for data in coder.encode(texts)]
    assert found == [expected(t) for t in texts]
    assert len(cut) == len(set(cut))
    assert not {"The", "the", "end.", "End.", "été!", "été"} & {w for w in cut if w in coder.known}
    assert not any(" " in w for w in cut)
    assert coder.encode([]) == [] and coder.encode([None, " "]) == [b"", b""]


def rows():
    rnd = random.Random(5)
    vocabulary = ["word", "another", "Ünlike", "x,", "\n", "longerwordhere", "7"]
    out = [(i, t, "en", "s", "clash", 1) for i, t in enumerate([None, "", " ", "a", "<|endoftext|>"])]
    for i in range(5, 60):
        n = rnd.choice([1, 20, 200, 3000])
        out.append((i, " ".join(rnd.choice(vocabulary) for _ in range(n)), None, f"s{i % 3}", "clash", 1))
    return [*out, out[9], out[9], (None, "no id", "en", "s", "c", 1), (None, "no id", "en", "s", "c", 1)]


def test_every_id_lies_in_one_piece(spark):
    docs = spark.createDataFrame(rows(), DOCS).repartition(3)
    expected = plain(BYTE)
    limits = packing.Limits(256, 6, 256)
    found = packing.pack_documents(docs, BYTE, 0, limits=limits, window=16).collect()
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 256 and len(pieces) <= 6
    want = Counter()
    for i, text, *_ in rows():
        want[i, len(expected(text)) + 1] += 1
    got = Counter()
    for r in found:
        ids = np.array([*expected({x[0]: x[1] for x in rows()}[r.doc_id]), 0], dtype="<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == Counter({(i, n): n * c for (i, n), c in want.items()})


def test_padding_is_little(spark):
    docs = spark.createDataFrame(rows(), DOCS).repartition(2)
    found = packing.pack_documents(docs, BYTE, 0).collect()
    used = Counter()
    for r in found:
        used[r.sequence_id] += r.length
    assert all(n == 1024 or n & (n - 1) == 0 for n in used.values())


def test_examples_stay_whole(spark):
    rnd = random.Random(1)
    needs = [(i, rnd.randint(1, 90), rnd.randint(1, 4), rnd.randint(0, 30)) for i in range(300)]
    needs += [(900, 0, 1, 0), (901, None, None, None), (None, 5, 1, 1)]
    table = spark.createDataFrame(needs, "conv_id bigint, tokens int, segments int, loss_tokens int")
    limits = packing.Limits(100, 8, 60)
    found = packing.pack_examples(table.repartition(1), limits, "conv_id", window=64).collect()
    assert Counter(r.example_id for r in found) == Counter(n[0] for n in needs if n[1])
    size = {n[0]: n[1:] for n in needs}
    load = {}
    for r in found:
        assert r.length == size[r.example_id][0]
        load.setdefault(r.sequence_id, []).append(size[r.example_id])
    for own in load.values():
        t, s, loss = map(sum, zip(*own, strict=True))
        assert t <= 100 and s <= 8 and loss <= 60
    assert len(load) <= 1.25 * sum(n[1] or 0 for n in needs) / 100  # tokens fill most of it
    with pytest.raises(Exception, match="larger than a sequence"):
        packing.pack_examples(spark.createDataFrame([(1, 101, 1, 1)], table.schema), limits, "conv_id").collect()


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_DOCS", 7)
    docs = spark.createDataFrame(rows() * 3, DOCS)
    path, expected = str(tmp_path / "ids"), plain(WORD)
    token_files.write_token_files(docs, path, WORD, 1)
    found = token_files.read_token_files(spark, path, ids_too=True).orderBy("start").collect()
    assert [r.doc_id for r in found][-6:] == [None] * 6
    known = [r.doc_id for r in found][:-6]
    assert known == sorted(known)
    assert Counter(known) == Counter(r[0] for r in rows() * 3 if r[0] is not None)
    texts, at = {r[0]: r[1] for r in rows()}, 0
    for r in found:
        ids = [*expected(texts[r.doc_id]), 1]
        assert (r.start, r.n_tokens, list(r.ids)) == (at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
    few = token_files.read_documents(spark, path, [8, 41, 777]).collect()
    assert {r.doc_id: list(r.ids) for r in few} == {i: [*expected(texts[i]), 1] for i in (8, 41)}


def test_token_counts_follow_events(spark, tmp_path):
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "ledger"))
    schema = "event string, doc_id bigint, source string, lang string, tokenizer string, tokens bigint, sequence int"

    def batch(*events):
        return spark.createDataFrame([(*e, n) for n, e in enumerate(events)], schema)

    def totals():
        return {(r.source, r.lang, r.tokenizer): (r.n_documents, r.n_tokens) for r in ledger.totals().collect()}

    assert totals() == {}
    load = batch(
        ("insert", 1, "a", "en", "v1", 10), ("insert", 2, "a", None, "v1", 5), ("insert", 3, None, "en", "v1", 7),
        ("insert", 3, None, "en", "v1", 7), ("insert", None, "a", "en", "v1", 2), ("insert", None, "a", "en", "v1", 2),
        ("insert", 4, "b", "en", "v1", None),
    )
    assert ledger.commit("load", load) and not ledger.commit("load", load)
    assert totals() == {("a", "en", "v1"): (3, 14), ("a", None, "v1"): (1, 5), (None, "en", "v1"): (1, 7), ("b", "en", "v1"): (1, 0)}
    change = batch(
        ("delete", 1, None, None, "v1", None), ("revise", 2, "c", "de", "v1", 6), ("revise", 3, None, "en", "v2", 8),
        ("delete", 3, None, "en", "v1", 0), ("delete", 99, "a", "en", "v1", 3), ("delete", None, "a", "en", "v1", 2),
        ("insert", 4, "b", "en", "v1", 1), ("revise", 4, "b", "en", "v1", 9),
    )
    assert ledger.commit("change", change)
    want = {("a", "en", "v1"): (2, 4), ("c", "de", "v1"): (1, 6), (None, "en", "v2"): (1, 8), ("b", "en", "v1"): (1, 9)}
    assert totals() == want
    # What a failed commit left is replaced, and counts only when it is complete.
    batch(("insert", 7, "x", "x", "x", 1)).drop("event", "sequence").write.parquet(f"{ledger.path}/deltas/late")
    assert totals() == want and ledger.batches() == ["change", "load"]
    assert ledger.commit("late", batch(("insert", 8, "a", "en", "v1", 1)))
    assert totals() == {**want, ("a", "en", "v1"): (3, 5)}
    with pytest.raises(Exception, match="unknown event"):
        ledger.commit("bad", batch(("upsert", 1, "a", "en", "v1", 1)))
    with pytest.raises(ValueError):
        ledger.commit("../x", load)


def test_version_change_keeps_documents_without_an_id(spark, tmp_path):
    texts = [(1, "one two"), (1, "one two"), (2, "three"), (3, "one two"), (4, None)]
    texts += [(None, "no id here"), (None, "no id here"), (None, "another"), (None, "one two")]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in texts], "doc_id bigint, text string, lang string, source string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    size = plain(BYTE)
    want = [size(t) for t in ("one two", "three", None, "no id here", "no id here", "another", "one two")]
    found = QUERIES["op2_token_counts"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [("s", "en", "byte_bpe_50k+end", 7, sum(map(len, want)) + 7)]
    # Again, and back, on a ledger of several groups.
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "ledger"))
    rows = [("insert", None, "a", None, "v1", n) for n in (3, 3, 4)] + [("insert", 5, "a", None, "v1", 6), ("insert", None, "b", "en", "v1", 0)]
    ledger.commit("load", spark.createDataFrame(rows, "event string, doc_id bigint, source string, lang string, tokenizer string, tokens bigint"))
    for n, (old, new, more) in enumerate([("v1", "v2", 1), ("v2", "v3", 2), ("v3", "v1", -3)]):
        assert ledger.commit(f"{n}", token_counts.version_change(ledger, old, new, more))
        more = (1, 3, 0)[n]
        assert {tuple(r) for r in ledger.totals().collect()} == {("a", None, new, 4, 16 + 4 * more), ("b", "en", new, 1, more)}


@pytest.mark.parametrize(("buckets", "state_every"), [(1, 100), (5, 2)])
def test_states_sum_up_the_batches(spark, tmp_path, buckets, state_every):
    schema = "event string, doc_id int, source string, lang string, tokenizer string, tokens int, sequence int"
    drawn = random.Random(buckets)
    path, counted, free = str(tmp_path / "ledger"), {}, Counter()
    for n in range(5):
        # A ledger opened again keeps its buckets, whatever it is asked for.
        ledger = token_counts.TokenLedger(spark, path, buckets=buckets if n == 0 else 7, state_every=state_every)
        assert ledger.buckets == buckets
        events = []
        for k in range(40 if n == 0 else 6):
            event, doc = drawn.choice(["insert", "revise", "delete"]), drawn.choice([None, *range(30)])
            group = (drawn.choice(["a", None]), drawn.choice(["en", "de"]), drawn.choice(["v1", "v2", None]))
            events.append((event, doc, *group, drawn.randrange(9), k))
        for event, doc, source, lang, version, tokens, _ in events:
            if doc is None:
                free[source, lang, version, tokens] += event != "delete"
            elif event == "delete":
                counted.pop((doc, version), None)
            else:
                counted[doc, version] = (source, lang, tokens)
        assert ledger.commit(f"b{n}", spark.createDataFrame(events, schema).repartition(3))
        assert not ledger.commit(f"b{n}", spark.createDataFrame(events, schema))
        want = Counter({(s, l, v): 0 for (_, v), (s, l, _) in counted.items()})
        size = Counter()
        for (_, v), (s, l, t) in counted.items():
            want[s, l, v] += 1
            size[s, l, v] += t
        for (s, l, v, t), times in free.items():
            want[s, l, v] += times
            size[s, l, v] += times * t
        found = {tuple(r[:3]): tuple(r[3:]) for r in ledger.totals().collect()}
        assert found == {g: (want[g], size[g]) for g in want if want[g] or size[g]}
        now = {(r.doc_id, r.tokenizer): (r.source, r.lang, r.tokens) for r in ledger.documents().collect() if r.doc_id is not None}
        assert now == counted
    assert len(ledger._states()) == 5 // state_every and ledger.write_state() == "0000000005"
    # A state that is not complete does not count, and is written anew.
    batches = ledger.batches()
    assert {r.batch for r in spark.read.parquet(f"{path}/states/0000000005/covers").collect()} == set(batches)
    (tmp_path / "ledger/states/0000000009/documents").mkdir(parents=True)
    assert ledger._states()[-1] == "0000000005" and ledger.write_state() is None


def test_a_small_batch_reads_its_buckets(spark, tmp_path, capsys):
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "ledger"), "string", state_every=1)
    schema = "event string, doc_id string, source string, lang string, tokenizer string, tokens bigint"
    load = [("insert", f"d{n}", "a", "en", "v1", n) for n in range(500)] + [("insert", None, "a", "en", "v1", 1)] * 3
    assert ledger.commit("load", spark.createDataFrame(load, schema))
    touched = spark.createDataFrame([("d7", "v1"), ("d450", "v1")], "doc_id string, _t string")
    found = ledger._counted(touched)
    found.explain("formatted")
    plan = capsys.readouterr().out
    buckets = {r.bucket for r in ledger._history().where("doc_id in ('d7', 'd450')").collect()}
    shown = next(x for x in plan.splitlines() if x.startswith("PartitionFilters"))
    assert all(f"{b}" in shown for b in buckets) and "bucket" in shown
    assert "GreaterThanOrEqual(doc_id,d450)" in plan and "LessThanOrEqual(doc_id,d7)" in plan
    assert sorted(r.tokens for r in found.collect()) == [7, 450]
    # Nothing touched: rows without an id only.
    assert ledger.commit("more", spark.createDataFrame(load[-1:], schema))
    assert [tuple(r) for r in ledger.totals().collect()] == [("a", "en", "v1", 504, sum(range(500)) + 4)]
    with pytest.raises(ValueError):
        token_counts.TokenLedger(spark, str(tmp_path / "none"), buckets=0)


def test_counts_of_whole_texts(spark):
    docs, expected = spark.createDataFrame(rows(), DOCS), plain(BYTE)
    found = token_counts.count_tokens(docs, BYTE, "v").collect()
    assert Counter((r.doc_id, r.tokens) for r in found) == Counter((r[0], len(expected(r[1]))) for r in rows())
    none = docs.limit(0)
    assert token_counts.count_tokens(none, BYTE, "v").count() == 0
    assert packing.pack_documents(none, BYTE, 0).count() == 0


def test_empty_token_files(spark, tmp_path):
    token_files.write_token_files(spark.createDataFrame([], DOCS), str(tmp_path / "none"), WORD, 1)
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0
