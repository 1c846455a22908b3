"""Input columns named like those that the operators use inside come back as they were."""

import pytest
from catalens.llm import licenses, quality, shards

NAMES = "_text _words _lines _runs _windows _line _tie _rows _size _per _chunk _one _shard _bucket".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "under the mit license " * 9)] * 90 + [(None, "y" * 99)] * 60 + [(i, f"text {i} apache license " * 5) for i in range(2, 20)] + [(60, None), (61, "")]
    return spark.createDataFrame([(*r, *[f"{n} {k % 2}" for n in NAMES], {"k": k % 2}) for k, r in enumerate(rows)], f"doc_id long, text string, {', '.join(f'{n} string' for n in NAMES)}, marks map<string,int>").repartition(3)


def plain(rows, names):
    return sorted(str([r[n] for n in names]) for r in rows)


@pytest.mark.parametrize("apply", [quality.features, licenses.scan, lambda d: shards.write_shards(d, 2, bucket_bytes=9000)])
def test_columns_come_back(docs, apply):
    out = apply(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert plain(out.collect(), docs.columns) == plain(docs.collect(), docs.columns)


@pytest.mark.parametrize("name, apply, of", [("_text", quality.features, "n_words"), ("_WORDS", licenses.scan, "n_words"), ("_tie", lambda d, text: shards.write_shards(d, 2, text=text, bucket_bytes=9000), "shard")])
def test_the_text_itself_may_have_such_a_name(docs, name, apply, of):
    named = docs.select("doc_id", docs["text"].alias(name))
    assert plain(apply(named, text=name).collect(), [name, of]) == plain(apply(docs.select("doc_id", "text"), text="text").collect(), ["text", of])
