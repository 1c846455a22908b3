"""Quality, near duplicates, repeated passages, decontamination, token counts, licenses and shards against brute force."""

import random
import re
import time
import tracemalloc

import brute
import numpy as np
import pytest
from catalens.llm import decontaminate, licenses, neardup, quality, shards, substring, token_counts
from catalens.llm.common import pack_sorted, unpack_sorted, window_hashes


def empty(documents):
    return documents.filter("false")


def test_packed_numbers_come_back():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64))
    for v in (values, values[:1], values[:0], np.array([0, 0, 1 << 63], np.uint64)):
        assert (unpack_sorted(pack_sorted(v)) == v).all()


def test_rolling_hash_depends_on_the_window_only():
    rng = np.random.default_rng(2)
    run = rng.integers(0, 1 << 63, 8).astype(np.uint64)
    h = window_hashes(np.concatenate([run, rng.integers(0, 1 << 63, 5).astype(np.uint64), run]), 8)
    assert h[0] == h[13] and len(set(h.tolist())) == 13


def test_quality_counts_equal_brute_force(documents, prose):
    got = {(r["doc_id"], r["text"]): tuple(r[c] for c in quality.COUNTS) for r in quality.features(documents).collect()}
    assert got == {(i, t): brute.counts(t) for i, t in prose}


def test_repeated_windows_that_overlap(spark):
    texts = ["a b " * 20, " ".join("abcdefgh") + " x " + " ".join("abcdefgh"), "l\nl\n\nl\nm", " ".join("abcdefghij") * 1]
    rows = quality.features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: tuple(r[c] for c in quality.COUNTS) for r in rows} == {i: brute.counts(t) for i, t in enumerate(texts)}


def test_weak_supervision_separates_junk_that_one_rule_would_not(spark):
    rng = random.Random(3)
    words = ["the", "of", "and", "to", "river", "mountain", "walked", "stone", "evening", "quiet"]
    good = [" ".join(rng.choice(words) for _ in range(60)).replace("stone", "stone.") for _ in range(200)]
    junk = [" | ".join("".join(rng.choices("XQZKT", k=4)) for _ in range(60)) for _ in range(30)]
    odd = ["the river & the stone. " * 1 + g for g in good[:5]]  # one odd sign in prose
    docs = spark.createDataFrame(list(enumerate(good + junk + odd)), "doc_id long, text string")
    model = quality.fit(quality.features(docs))
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(quality.features(docs), model).collect()}
    assert all(kept[i] for i in range(200)) and not any(kept[i] for i in range(200, 230)) and all(kept[i] for i in range(230, 235))
    assert model.accuracy("symbols") > 0.9 and 0.8 < model.prior < 0.95


def test_quality_on_nothing_and_stage_keeps_columns(documents):
    assert quality.fit(quality.features(empty(documents))).iterations == 0
    assert quality.kept_documents(empty(documents)).collect() == []
    out = quality.kept_documents(documents)
    assert out.columns == documents.columns and {r["kept"] for r in out.collect()} <= {"x"}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(documents, prose, size, percent):
    got = {r["doc_id"]: r for r in neardup.near_duplicates(documents.filter("doc_id is not null"), words=size, percent=percent).collect()}
    own = [(i, t) for i, t in prose if i is not None]
    expected = brute.components(own, size, percent)
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(brute.shingles(t, size)) for i, t in own}
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_null_ids_join_components_but_do_not_name_them(documents, prose):
    rows = [r for r in neardup.near_duplicates(documents).collect() if r["doc_id"] is None]
    first = min(i for i, t in prose if t == prose[0][1] and i is not None)
    assert sorted((r["component_id"] is None, r["kept"]) for r in rows) == [(False, False), (True, True)] and {r["component_id"] for r in rows} == {None, first}


def test_large_group_of_near_copies_and_chain(spark, monkeypatch):
    """More near copies than a leaf holds, and a chain whose ends are not alike."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(200)] = f"e{i}"
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(200)]
    for k in range(12):
        chain[k * 12 : k * 12 + 4] = [f"n{k}{j}" for j in range(4)]
        rows.append((1000 + k, " ".join(chain)))
    monkeypatch.setattr(neardup, "LEVELS", 2)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()}
    assert got == brute.components(rows, 3, 85)


def test_large_node_with_several_components_is_finished(spark, monkeypatch):
    """Two families that share nine tenths of their minwise tokens' nodes but are not linked stay apart, links across are found."""
    base = [f"b{i}" for i in range(300)]
    rows = []
    for family in range(3):
        own = list(base)
        for k in range(0, 300, 12):
            own[k] = f"f{family}_{k}"
        for i in range(20):
            w = list(own)
            w[5 + i * 12] = f"v{family}_{i}"
            rows.append((family * 100 + i, " ".join(w)))
    monkeypatch.setattr(neardup, "LEAF", 4)
    monkeypatch.setattr(neardup, "LEVELS", 1)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()}
    assert got == brute.components(rows, 3, 85)


def test_near_duplicates_of_nothing_and_stage(documents):
    assert neardup.near_duplicates(empty(documents)).collect() == []
    out = neardup.one_of_each(documents)
    expected = {r["doc_id"] for r in neardup.near_duplicates(documents).filter("kept").collect()}
    assert out.columns == documents.columns and {r["doc_id"] for r in out.collect()} == expected


def test_repeated_passages_equal_brute_force(documents, prose, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(substring, "PART_BYTES", 9000)
    own = sorted((i, t) for i, t in prose if i is not None)
    expected = {i: sorted(g) for (i, _), g in zip(own, brute.removed(own, 20), strict=True)}
    got = {r["doc_id"]: r for r in substring.dedup_windows(documents.filter("doc_id is not null")).collect()}
    assert {i: [k for s in r["removed"] for k in range(s["start"], s["stop"])] for i, r in got.items()} == expected
    for i, t in own:
        w = t and brute.words(t) or []
        assert got[i]["n_words"] == len(w) and got[i]["n_removed"] == len(expected[i]) and got[i]["kept"] == " ".join(x for k, x in enumerate(w) if k not in set(expected[i]))
        assert all(a["stop"] < b["start"] for a, b in zip(got[i]["removed"], got[i]["removed"][1:], strict=False))  # maximal


def test_repeated_passages_of_nothing_and_stage(documents):
    assert substring.dedup_windows(empty(documents)).collect() == []
    out = substring.without_repeats(documents)
    assert out.columns == documents.columns
    assert {r["kept"] for r in out.collect()} == {"x"}
    same = {r["doc_id"]: r["text"] for r in out.collect()}
    assert same[201] == "" and 208 in same


def test_tiling_equals_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        item = [rng.randrange(6) for _ in range(rng.randint(5, 30))]
        doc = [rng.randrange(6) for _ in range(40)] + item[len(item) // 2 :] + [9] + item[: len(item) // 2]
        at = [(a, b) for a in range(len(doc) - 2) for b in range(len(item) - 2) if doc[a : a + 3] == item[b : b + 3]]
        found = decontaminate.tiles(np.array([a for a, _ in at]), np.array([b for _, b in at]), 3)
        assert sorted(found) == brute.tiling(doc, item, 3)
        everywhere = np.ones(len(doc), dtype=bool)
        assert sorted(decontaminate.tiles_by_length(np.array(doc, np.uint64), np.array(item, np.uint64), 3, everywhere)) == brute.tiling(doc, item, 3)


@pytest.mark.parametrize("pair_seeds", [1 << 18, 0])
@pytest.mark.parametrize("chunk_seeds", [1 << 20, 1])
def test_leaks_equal_brute_force(monkeypatch, pair_seeds, chunk_seeds):
    monkeypatch.setattr(decontaminate, "PAIR_SEEDS", pair_seeds)
    monkeypatch.setattr(decontaminate, "CHUNK_SEEDS", chunk_seeds)
    rng = random.Random(11)
    draw = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(k, draw(rng.randint(0, 24))) for k in range(12)]
    docs = [draw(rng.randint(0, 40)) + " ! " + rng.choice(items)[1].upper() for _ in range(25)] + ["", "a " * 30]
    got = decontaminate.Block.of(items, 5).leaks([d.encode() for d in docs], 5, 0.5)
    for doc, found in zip(docs, got, strict=True):
        words = doc.lower().split()
        plain = [w for w in words if w != "!"]
        place = [k for k, w in enumerate(words) if w != "!"]
        expected = {}
        for k, item in items:
            if len(item.split()) >= 5:
                tiled = brute.tiling(plain, item.split(), 5)
                if sum(n for _, _, n in tiled) >= 0.5 * len(item.split()):
                    expected[k] = [(place[a], b, n) for a, b, n in tiled]
        assert {x["item"]: [(t["doc_word"], t["item_word"], t["length"]) for t in x["tiles"]] for x in found} == expected


def test_one_word_over_and_over_needs_little():
    text = b"word " * 20_000
    tracemalloc.start()
    began = time.monotonic()
    (found,) = decontaminate.Block.of([(1, text.decode())], 5).leaks([text], 5, 0.5)
    assert found[0]["coverage"] == 1 and len(found[0]["tiles"]) == 1
    assert time.monotonic() - began < 10 and tracemalloc.get_traced_memory()[1] < 1 << 28
    tracemalloc.stop()


def test_reordered_passages_are_found_and_clean_documents_stay(spark, monkeypatch):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    docs = [
        (1, f"Some text, then: {item.upper()}! and more"), (2, " ".join(w[10:]) + " unrelated words " + " ".join(w[:10])), (3, " ".join(w[:6]) + " and nothing else"),
        (4, None), (5, ""), (6, "clean text " * 50), (7, " ".join(reversed(w))), (2, " ".join(w[10:]) + " unrelated words " + " ".join(w[:10])),
    ]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, leaks string")
    bench = spark.createDataFrame([(9, item), (10, "too short"), (11, None), (None, item), (12, "another item of five and more words")], "item_id long, text string")
    for block in (decontaminate.BLOCK_WORDS, 3):  # in one block, and item by item
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        rows = decontaminate.find_leaks(frame, bench).collect()
        assert sorted((r["doc_id"], x["item"]) for r in rows for x in r["leaks"]) == [(1, 9), (2, 9), (2, 9)]
        assert {len(x["tiles"]) for r in rows if r["doc_id"] == 2 for x in r["leaks"]} == {2}
    assert sorted(r["doc_id"] for r in decontaminate.clean_documents(frame, bench).filter("leaks = 'x'").collect()) == [3, 4, 5, 6, 7]
    assert decontaminate.find_leaks(frame.filter("false"), bench).collect() == []
    assert not any(r["leaks"] for r in decontaminate.find_leaks(frame, bench.filter("false")).collect())


def test_token_counts_equal_brute_force(documents, prose):
    pieces = ["▁", "▁w", "w", "1", "2", "3", "12", "23", "▁w1", "ed", "it", "▁edit", "▁the", "t", "h", "e", "É", "té"]
    scores = {p: -float(k + 1) for k, p in enumerate(pieces)}
    got = {(r["doc_id"], r["text"]): (r["n_pretokens"], r["n_tokens"], round(r["token_score"], 6)) for r in token_counts.count_tokens(documents, scores).collect()}
    low = min(scores.values()) - 10
    for i, t in prose:
        w = (t or "").encode().split()
        best = [brute.segment("▁" + x.decode(), scores, low) for x in w]
        assert got[i, t] == (len(w), sum(n for _, n in best), round(sum(s for s, _ in best), 6))
    assert token_counts.count_tokens(empty(documents), scores).collect() == []


def test_vocabulary_is_ranked():
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    scores = token_counts.vocabulary(path)
    assert len(scores) > 30000 and abs(sum(np.exp(list(scores.values()))) - 1) < 1e-6


TEXTS = [
    "This is under the GNU General Public License version 3, or the MIT License.", "nothing", None, "", "CC BY-SA 4.0 and CC BY", "mit license mit license",
    "Licensed under the Apache License, Version 2.0", "the apache\nlicense", "Copyright (c) 2020 all rights reserved", "SPDX-License-Identifier: BSD-3-Clause", "élicense cc_by", "hcc by", "MİT license",
]


def plain_scan(text):
    """Detections by the same signatures with Python's regexes, intervals compared pair by pair."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    line = " " + " ".join(w) + " "
    found = []
    for rank, rule in enumerate(licenses.signatures()):
        if rule.keyword in line:
            for m in re.finditer(f"(?<= )(?:{rule.regex})(?= )", line):
                start = line[: m.start()].count(" ") - 1
                found.append((start, start + m[0].count(" ") + 1, rank, rule.label))
    kept = [f for f in found if not any(o != f and o[0] <= f[0] and f[1] <= o[1] and ((o[0], o[1]) != (f[0], f[1]) or o[2] < f[2]) for o in found)]
    return len(w), sorted((a, b, label) for a, b, _, label in kept)


def test_license_detections_equal_brute_force(spark):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, base string")
    for r in licenses.scan(frame).collect():
        assert (r["n_words"], [(d["start"], d["stop"], d["label"]) for d in r["detections"]]) == plain_scan(TEXTS[r["doc_id"]])
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (TEXTS[r["doc_id"]] or "").translate({i: i + 32 for i in range(65, 91)}))
        assert sorted((b["start"], b["label"]) for b in r["base"]) == sorted((i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    assert licenses.scan(frame.filter("false")).collect() == []
    scores = {r["doc_id"]: r["s"] for r in licenses.scan(frame).select("doc_id", licenses.score().alias("s")).collect()}
    assert scores[1] == scores[2] == scores[3] == 0 and 0.8 < scores[5] < 1


def test_every_keyword_opens_the_gate():
    gate = re.compile(licenses.gate(licenses.signatures()))
    assert all(gate.search(f"x {r.keyword} y") for r in licenses.signatures()) and len(licenses.signatures()) > 300


def test_shards_hold_every_row_once(documents, prose, tmp_path, monkeypatch):
    out = shards.write_shards(documents, 8, bucket_bytes=4000, path=str(tmp_path / "shards")).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out) == sorted((str(i), str(t)) for i, t in prose)
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert len({(r["shard"], r["bucket"]) for r in out}) > 8 and {r["kept"] for r in out} == {"x"}
    again = shards.write_shards(documents.repartition(3), 8, bucket_bytes=4000).collect()
    assert sorted((r["shard"], r["slot"], str(r["doc_id"])) for r in again) == sorted((r["shard"], r["slot"], str(r["doc_id"])) for r in out)
    assert shards.write_shards(empty(documents)).collect() == []


def test_one_more_shard_only_takes_rows(documents):
    from pyspark.sql import functions as F

    moved = documents.select(shards.shard_of(F.col("doc_id"), F.col("text"), 8).alias("a"), shards.shard_of(F.col("doc_id"), F.col("text"), 9).alias("b"), F.octet_length("text").alias("n")).collect()
    assert all(r["a"] == r["b"] or r["b"] == 8 for r in moved) and any(r["b"] == 8 for r in moved)


def test_fisher_yates_is_uniform():
    seen = [tuple(shards.fisher_yates(3, 7, k)) for k in range(3000)]
    assert len(set(seen)) == 6 and all(400 < seen.count(p) < 600 for p in set(seen))
