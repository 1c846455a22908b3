"""Shards of a table in which many rows are alike."""

import collections

from catalens.llm import shards


def test_repeats_do_not_fill_one_bucket(spark):
    rows = [(1, "x" * 99, "a")] * 800 + [(None, "y" * 99, "b")] * 400 + [(2, "z" * 99, str(i)) for i in range(400)] + [(i, f"text {i} " * 9, None) for i in range(10, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    out = shards.write_shards(docs, 2, bucket_bytes=20_000).collect()
    assert collections.Counter((r["doc_id"], r["text"], r["lang"]) for r in out) == collections.Counter(rows)
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert all(len({r["shard"] for r in out if r["doc_id"] == i}) == 1 for i in (1, 2, None))
    held = collections.Counter()
    for r in out:
        held[r["shard"], r["bucket"]] += len(r["text"]) + 1
    assert max(held.values()) < 60_000  # 80,000 bytes were alike
    again = shards.write_shards(docs.repartition(7), 2, bucket_bytes=20_000).collect()
    assert sorted((r["shard"], r["slot"], str(r)) for r in again) == sorted((r["shard"], r["slot"], str(r)) for r in out)
