"""Mixing to target weights, conversation repair and whitening against plain versions."""

import collections
import hashlib
import itertools
import json
import math
import random
import zlib

import brute
import numpy as np
import pytest
from catalens.llm import mixing, queries, repair, whitening
from pyspark.sql import functions as F

# --- mixing


def water_level(sizes, weights, rounds, budget):
    """Targets by raising the level until the budget is spent: the excess of full sources goes to the others, again and again."""
    target, open_ = {}, set(sizes)
    left = budget
    while open_:
        whole = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / whole for s in open_}
        full = [s for s in open_ if share[s] > rounds * sizes[s]]
        if not full:
            return target | share
        for s in full:
            target[s] = rounds * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def plain_mix(docs, weights=(5, 2, 1), rounds=3, share=1.0):
    """(source, size) per document in queue order → taken per document, by serving one copy after the other."""
    names = sorted({s for s, _ in docs}, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    sizes = collections.Counter()
    for s, n in docs:
        sizes[s] += n
    copies, sent = [], collections.Counter()
    for turn in range(rounds):
        for i, (s, n) in enumerate(docs):
            sent[s] += n
            if n:
                copies.append((sent[s] / weight[s], names.index(s), sent[s], i, n))
    taken, total, budget = collections.Counter(), 0, int(sum(sizes.values()) * share)
    for *_, i, n in sorted(copies):
        total += n
        if total > budget:
            break
        taken[i] += n
    return taken, water_level(sizes, weight, rounds, budget), sizes


def queue_order(rows):
    return sorted(rows, key=lambda r: int(hashlib.md5(f"{mixing.SEED}:{r[0]}".encode()).hexdigest()[:15], 16))


@pytest.mark.parametrize(("weights", "rounds", "share"), [((5, 2, 1), 3, 1.0), ((7, 1), 2, 0.4), ((1, 9), 2, 5.0)])
def test_mix_equals_one_queue(spark, weights, rounds, share):
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([0, 1, 3, 20, 90]), rng.choice(["a", "a", "a", "b", "é", "Z", "", None])) for i in range(400)] + [(900, None, "empty"), (901, " \t", None)]
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, source string, taken string, _row int").repartition(5)
    got = {r["doc_id"]: r for r in mixing.mix(frame, weights, rounds, share).collect()}
    ordered = queue_order(rows)
    taken, target, sizes = plain_mix([(s, len(brute.words(t))) for _, t, s in ordered], weights, rounds, share)
    assert len(got) == len(rows)
    for k, (i, text, source) in enumerate(ordered):
        r, size = got[i], len(brute.words(text))
        assert (r["size"], r["source_size"], r["taken"], r["_row"]) == (size, sizes[source], taken[k], 5)
        assert math.isclose(r["target"], target[source], rel_tol=1e-9, abs_tol=1e-6) and r["taken"] == r["repeats"] * size <= rounds * size
    of_source = collections.Counter()
    for i, _, s in rows:
        of_source[s] += got[i]["taken"]
    assert all(abs(of_source[s] - target[s]) <= 90 + 90 * len(sizes) for s in sizes)


def test_mix_is_the_same_again_and_streams_copies(spark):
    rows = [(1, "same text here", "a")] * 300 + [(None, "no id", "a")] * 50 + [(i, "other words " * 5, "b") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = [collections.Counter((r["doc_id"], r["text"], r["taken"]) for r in mixing.mix(frame.repartition(n), keep_text=True).collect()) for n in (1, 7)]
    assert out[0] == out[1] and sum(out[0].values()) == len(rows)
    mixed = mixing.mix(frame, keep_text=True)
    stream = mixing.mixture(mixed).collect()
    assert sum(r["size"] for r in stream) == mixed.agg(F.sum("taken")).first()[0]
    assert [r["finish"] for r in stream] == sorted(r["finish"] for r in stream)
    assert [r["position"] for r in stream] == [0, *itertools.accumulate(r["size"] for r in stream[:-1])]
    assert mixing.mix(frame.filter("false")).collect() == [] and mixing.mixture(mixing.mix(frame.filter("false"))).collect() == []
    assert [r["taken"] for r in mixing.mix(frame.withColumn("text", F.lit(None).cast("string"))).collect()] == [0] * len(rows)


# --- conversation repair


def all_audits(rows):
    """Every audit of at most eight (initial, fault) rows with the cost of each, by search; the cheapest, then least."""
    best = None
    limit = 2 * len(rows)  # deleting all is always possible
    legal = lambda out: out == "" or out.removeprefix("s") == "ua" * (len(out.removeprefix("s")) // 2) != "" or False
    stack = [(0, 0, "", "")]
    while stack:
        at, cost, audit, out = stack.pop()
        plain = out.removeprefix("s")
        if cost > limit or out.count("s") > 1 or "s" in plain or any(c != "ua"[i % 2] for i, c in enumerate(plain)):
            continue
        if at == len(rows) and legal(out):
            best = min(best, (cost, audit)) if best else (cost, audit)
        for c in "ua":
            if cost + 5 <= limit:
                stack.append((at, cost + 5, audit + "I", out + c))
        if at < len(rows):
            initial, fault = rows[at]
            stack.append((at + 1, cost + 2, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                stack.append((at + 1, cost + extra, audit + "K", out + initial if initial in tuple("sua") else out + "s" * 2))
                stack += [(at + 1, cost + extra + 1, audit + "R", out + c) for c in "ua"]
    return best


def test_audits_equal_a_search_over_all():
    rng = random.Random(11)
    for _ in range(400):
        rows = [(rng.choice(["s", "u", "u", "a", "a", "t", ""]), rng.choice([None, None, None, "truncated", "duplicate", "blank"])) for _ in range(rng.randint(0, 6))]
        best = repair.best_audits(repair.Row(i, f) for i, f in rows)
        assert repair.choose({s: (c, a.text()) for s, (c, a) in best.items()}) == all_audits(rows), rows


@pytest.mark.parametrize("modulus", [repair.MODULUS, 3])
def test_prefixes_of_linked_audits(monkeypatch, modulus):
    """With a modulus of 3 most hashes collide, and letters decide."""
    monkeypatch.setattr(repair, "MODULUS", modulus)
    rng = random.Random(2)
    nodes = [(repair.Audit(), "")]
    for _ in range(600):
        node, text = rng.choice(nodes[-40:])
        letter = rng.choice("DIKR")
        nodes.append((repair.Audit(node, letter), text + letter))
    for _ in range(3000):
        (a, x), (b, y) = rng.choice(nodes), rng.choice(nodes)
        shared = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert a.text() == x and repair.common(a, b) == shared and repair.before(a, b) == (x < y)


def plain_repair(rows):
    """Results of a conversation from (turn, role, text) rows after damage."""
    rows = sorted([(t is not None, t or 0, r, x) for t, r, x in rows])
    seen, listed, counts = set(), [], collections.Counter()
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        counts[fault] += 1
        listed.append((role[:1], fault))
    turns = {t for known, t, _, _ in rows if known}
    cost, audit = all_audits(listed)
    out, queue = [], [(r, x) for _, _, r, x in rows]
    for c in audit:
        role, text = queue.pop(0) if c != "I" else (None, "")
        if c in "RI":
            role = "assistant" if out and out[-1][0] == "user" else "user"
        if c != "D":
            out.append((role, text))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(listed))
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def random_conversations(n, rng):
    texts = ["Yes.", "No", "What?", " ", "", None, "Ünd so!", "x" * 300 + ".", "a\x85", "end.\n\n", "multi\nline."]
    return [(c, rng.choice([None, *range(9)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), rng.choice(texts)) for c in [*range(n), None] for _ in range(rng.randint(1, 6))]


@pytest.mark.parametrize("chunk_rows", [2000, 2])
def test_repair_equals_brute_force(spark, chunk_rows):
    """With chunks of two rows nearly every conversation goes the way of the long ones."""
    rows = random_conversations(150, random.Random(chunk_rows))
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(4)
    dropped = F.crc32(F.concat_ws("/", "conv_id", "turn", "text").cast("binary")) % 4 == 0
    of = collections.defaultdict(list)
    for c, t, r, x in rows:
        key = "/".join(str(v) for v in (c, t, x) if v is not None)
        of[c] += [] if zlib.crc32(key.encode()) % 4 == 0 else [(t, r if r is not None else " ", x if x is not None else " ")]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.repair(frame, dropped=dropped, chunk_rows=chunk_rows).collect()}
    assert got.keys() == of.keys()
    for c, members in of.items():
        assert got[c] == plain_repair(members), (c, members)


def test_a_conversation_of_many_rows_and_copies(spark):
    rng = random.Random(4)
    rows = [("long", None, "user", "again and again.")] * 500 + [("long", t, rng.choice(["user", "assistant", "assistant"]), rng.choice([f"line {t}.", f"line {t}", "hm."])) for t in range(1500)]
    frame = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").repartition(6)
    whole, cut = (repair.repair(frame, chunk_rows=n).collect() for n in (10_000, 16))
    assert whole == cut and len(whole) == 1
    r = whole[0]
    assert r["duplicate"] >= 499 and len(r["audit"].replace("I", "")) == 2000 and r["gaps"] == 0
    assert repair.repair(frame.filter("false")).collect() == []
    gone = repair.repair(frame, dropped=F.lit(True), chunk_rows=16).collect()
    assert [tuple(x) for x in gone] == [("long", 0, 0, 0, 0, 0, 0, "", repair.EMPTY)]


def test_op12_damage(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("user", "Hi."), ("assistant", "Ho!"), ("user", "A. b? c!"), ("assistant", None)] * 30)] + [(2, None, None, "q.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    expected = collections.Counter()
    for c, t, r, x in rows:
        f = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", " " if x is None else x
        x = "" if f == 1 else "".join(k for k in x if k not in ".!?") if f == 2 else x
        expected[c, t, "user" if f == 4 else r, x, f == 0] += 2 if f == 3 else 1
    got = queries.damaged(frame).collect()
    assert collections.Counter((r["conv_id"], r["turn"], r["role"], r["text"], r["dropped"]) for r in got) == expected


# --- whitening


def plain_whitening(vectors, k, scale):
    d = max(map(len, vectors))
    x = np.array([[math.floor(scale * c) for c in v] + [0] * (d - len(v)) for v in vectors], dtype=float)
    fit = np.unique(x, axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(d, d))
    return x, fit, values[::-1][:k], axes[:, ::-1][:, :k], values.sum()


def test_eigenpairs_of_symmetric_matrices():
    rng = np.random.Generator(np.random.PCG64(1))
    q = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    spectra = [np.arange(24.0), np.repeat([9.0, 9.0, 4.0, 1.0], 6), np.zeros(24), np.r_[1e8, 1e8 - 1e-3, np.linspace(0, 1, 22)], -np.arange(24.0)]
    for m in [q @ np.diag(s) @ q.T for s in spectra] + [np.eye(24), np.diag(np.arange(24.0)), np.array([[3.0]]), np.array([[2.0, 1.0], [1.0, 2.0]])]:
        m = (m + m.T) / 2
        k, norm = min(5, len(m)), max(1.0, np.abs(m).max())
        values, vectors = whitening.principal_components(m, k)
        assert np.allclose(values, np.linalg.eigvalsh(m)[::-1][:k], rtol=0, atol=1e-13 * norm * len(m))
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
        assert np.abs(m @ vectors - vectors * values).max() < 1e-12 * norm * len(m)


def test_whitening_equals_numpy(spark):
    rng = random.Random(6)
    base = [[rng.gauss(0, 1 + (j == 2) * 3 + (j == 4)) for j in range(7)] for _ in range(300)]
    awkward = [[0.5] * 7] * 200 + [[-0.0, 0.0], [], [1.0, None], None, [math.nan] * 7, [math.inf], [1.0] * 6]
    rows = [(i, v, "x") for i, v in enumerate(base + awkward)] + [(None, base[0], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").repartition(5)
    got = whitening.whiten(frame, k=3, scale=64).collect()
    kept = [(i, v) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x, fit, values, axes, trace = plain_whitening([v for _, v in kept], 3, 64)
    n, sums = len(fit), fit.sum(axis=0)
    assert len(got) == 3 * len(kept) and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1
    assert max(r["identity_error"] for r in got) < 1e-10
    expected = (x - sums / n) @ axes / np.sqrt(values)
    by = collections.defaultdict(list)
    for r in got:
        by[r["vec_id"], r["component"]].append(r)
    for c in range(3):
        sign = math.copysign(1, by[0, c + 1][0]["whitened"] * expected[0, c]) if kept[0][0] == 0 else 1
        for (i, _), row, e in zip(kept, x, expected[:, c], strict=True):
            r = by[i, c + 1][0]
            assert math.isclose(sign * r["whitened"], e, abs_tol=1e-9) and math.isclose(r["explained"], values[c] / trace, rel_tol=1e-9)
            assert int(r["deviation"]) == sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True))


def test_whitening_of_few_and_of_large_numbers(spark):
    frame = lambda vs: spark.createDataFrame(list(enumerate(vs)), "vec_id long, embedding array<double>")
    for vectors in ([], [None], [[1.0, 2.0]] * 5, [[]], [[], []]):
        out = whitening.whiten(frame(vectors))
        assert out.collect() == [] and out.columns == ["vec_id", "embedding", *whitening.RESULTS]
    two = whitening.whiten(frame([[0.0, 0.0], [2.0, 0.0], [2.0, 0.0]]), scale=1).collect()
    assert [(r["vec_id"], r["component"], abs(r["whitened"]), int(r["deviation"])) for r in sorted(two, key=lambda r: r["vec_id"])] == [(i, 1, 1.0, 4) for i in range(3)]
    large = whitening.whiten(frame([[2.0**60, 0.0], [0.0, 2.0**60], [1.0, 1.0]]), k=1, scale=1).collect()
    x = [[2**60, 0], [0, 2**60], [1, 1]]
    assert [int(r["deviation"]) for r in sorted(large, key=lambda r: r["vec_id"])] == [sum((3 * v - sum(c)) ** 2 for v, c in zip(row, zip(*x), strict=True)) for row in x]


def test_new_queries_on_the_small_tables(spark):
    d = "/root/testdata/sf0.001"
    convs = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id").distinct().count()
    assert queries.QUERIES["op12_conversation_repair"](spark, d).count() == convs
    rows = queries.QUERIES["op13_embedding_whitening"](spark, d).collect()
    assert {r["component"] for r in rows} == {1, 2, 3, 4} and max(r["identity_error"] for r in rows) < 1e-4
    assert json.dumps(sorted({r["n"] for r in rows}))
    mixed = queries.QUERIES["op11_mixing_sources"](spark, d).collect()
    assert sum(r["taken"] for r in mixed) <= sum(r["size"] for r in mixed)
