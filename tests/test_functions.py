import difflib
import itertools
import random
import uuid
import zlib

import pandas as pd
from pyspark.sql import functions as F

from catalens.functions import similarity, text, values


def one(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values()) or (0,)], list(row) or ["_"])
    return df.select(column.alias("x")).first()["x"]


def test_normalize_match_text(spark):
    df = spark.createDataFrame([("CHÂTEAU  Rosé №1",), ("Ёлка",), ("Straße Æon",), (None,)], "t string")
    got = {r["t"]: r["n"] for r in df.withColumn("n", text.match_text(F.col("t"))).collect()}
    assert got == {"CHÂTEAU  Rosé №1": "chateau rose no1", "Ёлка": "eлкa", "Straße Æon": "strasse aeon", None: ""}


def test_transliteration_and_stems(spark):
    assert one(spark, text.to_search_latin(F.col("t")), t="абрау") == "abrau"
    assert one(spark, text.to_search_latin(F.col("t")), t="wx") == "vks"
    assert one(spark, text.ru_to_lat(F.col("t")), t="Щука") == "schuka"
    assert one(spark, text.lat_to_ru(F.col("t")), t="zhschaka") == "жщака"
    assert one(spark, text.stem(F.col("t")), t="амфорах") == "амфор"
    assert one(spark, text.stem(F.col("t")), t="вин") == "вин"
    assert one(spark, text.term_stems(F.col("t")), t="Игристое вино (пояснение)") == ["игрист", "вин"]
    assert one(spark, text.text_variants(F.col("t")), t="Рислинг")[1] == "risling"


def test_numbers(spark):
    assert one(spark, values.alcohol_numbers(F.col("t")), t="12,5-13%") == [12.5, 13.0]
    assert one(spark, values.alcohol_numbers(F.col("t")), t="12.5") == []
    assert one(spark, values.alcohol_numbers(F.col("t")), t="99%") == []
    assert one(spark, values.format_percent_range(F.lit(12.0), F.lit(12.5))) == "12-12.5%"
    assert one(spark, values.format_percent_range(F.lit(12.0), F.lit(None).cast("double"))) == "12%"
    assert one(spark, values.format_temperature(F.lit("8–10 °C"))) == "8-10°C"
    assert [one(spark, F.round(values.clip_bonus(F.lit(x)), 9)) for x in (0.55, 1.0, -1.0, 0.775)] == [0, 1, 0, 0.5]
    assert [one(spark, values.review_frame(F.lit(n))) for n in (0, 1, 10, 50, 100, 101)] == ["none", "bronze", "silver", "gold", "gold", "diamond"]


def test_ids(spark):
    namespace = uuid.uuid5(uuid.NAMESPACE_URL, "catalens/food")
    names = ["сыры", "abc", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(values.uuid5(namespace, F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(namespace, n)) for n in names]
    assert one(spark, values.stable_shuffle(F.col("n")), n="сыры") == zlib.crc32("сыры".encode())


def test_urls_and_paths(spark):
    assert one(spark, values.slug_from_url(F.lit("https://x.org/wines/abc/"))) == "abc"
    assert one(spark, values.slug_from_url(F.lit("https://x.org/a/wines/abc"))) is None
    assert one(spark, values.query_keys(F.lit("a=1&b=2&a=3&=4"))) == ["a", "b"]
    assert one(spark, values.normalize_photo_dir(F.lit("2026 INFO __main__:  w/p/original.jpg"))) == "w/p"
    assert one(spark, values.normalize_photo_dir(F.lit("Missing 3 photos"))) is None


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row[:]
        for j, y in enumerate(b, 1):
            row[j] = prev[j - 1] + 1 if x == y else max(prev[j], row[j - 1])
    return row[-1]


def words(seed, n):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice("abcde fgh") for _ in range(rng.randint(1, 11))).strip() or "x" for _ in range(n)})


def test_indel_ratio(spark):
    df = spark.createDataFrame([("abcbdab", "bdcaba"), ("", ""), ("a", ""), ("x" * 90, "y" + "x" * 80)], "a string, b string")
    rows = df.select("a", "b", similarity.indel_ratio_udf("a", "b").alias("u"), similarity.indel_ratio(F.col("a"), F.col("b")).alias("e")).collect()
    for r in rows:
        expected = 2 * lcs(r["a"], r["b"]) / (len(r["a"]) + len(r["b"])) if r["a"] or r["b"] else 1.0
        assert abs(r["u"] - expected) < 1e-12 and abs(r["e"] - expected) < 1e-12


def test_similar_pairs_are_complete(spark):
    left, right = words(1, 150), words(2, 150)
    a, b = spark.createDataFrame([(w,) for w in left], "word string"), spark.createDataFrame([(w,) for w in right], "known string")
    for threshold in (0.75, 0.88):
        got = {(r["word"], r["known"]) for r in similarity.similar_pairs(a, b, threshold).collect()}
        assert got == {(x, y) for x, y in itertools.product(left, right) if 2 * lcs(x, y) / (len(x) + len(y)) >= threshold}


def test_close_matches(spark):
    left, right = words(3, 120), words(4, 120)
    a, b = spark.createDataFrame([(w,) for w in left], "word string"), spark.createDataFrame([(w,) for w in right], "known string")
    near = similarity.similar_pairs(a, b, 0.75, scorer=similarity.ratcliff_ratio_udf)
    got = {r["word"]: r["k"] for r in near.groupBy("word").agg(F.max_by("known", F.struct("ratio", "known")).alias("k")).collect()}
    expected = {w: m[0] for w in left if (m := difflib.get_close_matches(w, right, n=1, cutoff=0.75))}
    assert got == expected


def test_bit_vectors_count_the_longest_common_subsequence():
    from catalens.functions.similarity import indel_ratios, lcs_lengths

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcé🙂щ") for _ in range(n))
    sizes = [0, 1, 2, 5, 9, 31, 63, 64, 65, 130]
    pairs = [(word(rng.choice(sizes)), word(rng.choice(sizes))) for _ in range(400)] + [("", ""), ("", "x"), ("same", "same"), ("a" * 64, "a" * 64), ("a" * 200, "a" * 199)]
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    assert lcs_lengths(a, b).tolist() == [plain(x, y) for x, y in pairs]
    assert lcs_lengths([], []).tolist() == []
    ratios = indel_ratios(pd.Series([*a, None]), pd.Series([*b, "x"]))
    assert [round(r, 9) for r in ratios] == [round(2 * plain(x, y) / (len(x) + len(y)), 9) if x or y else 1.0 for x, y in pairs] + [0.0]


def test_name_ratios_hold_every_pair_of_names(spark, tmp_path):
    from catalens.plans import load_all

    names = ["blue ring", "red bolt", "blue gear", "old rod", "red bolt", "new nut"]
    spark.createDataFrame([(10 * i, n) for i, n in enumerate(names)], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = {(r["a"], r["b"]) for r in load_all().QUERIES["name_indel_ratio"](spark, str(tmp_path)).collect()}
    assert got == {(a, b) for a in names for b in names if a < b}
