import datetime
import json
import os
import shutil
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from catalens.functions.text import normalize_match_text, to_search_latin
from catalens.operators import activity, aggregates, enrichment, facets, glossary, ingest
from catalens.operators.aggregates import latest_per_key
from catalens.session import scratch_path
from catalens.sources import files
from catalens.streaming import jobs


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_upsert_is_idempotent_and_overwrites_nulls(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    source = spark.createDataFrame([(2, None), (3, "c")], "id int, v string")
    once = ingest.upsert(target, source, ["id"])
    assert sorted(once.collect(), key=lambda r: r["id"]) == sorted(ingest.upsert(once, source, ["id"]).collect(), key=lambda r: r["id"])
    assert {r["id"]: r["v"] for r in once.collect()} == {1: "a", 2: None, 3: "c"}


def test_read_catalog_with_missing_optional_table(spark, tmp_path):
    (tmp_path / "food.json").write_text(json.dumps([{"id": "1", "name": "Сыры"}], ensure_ascii=False))
    tables = files.read_catalog(spark, str(tmp_path), {k: files.CATALOG_SCHEMAS[k] for k in ("food", "wine_terms")})
    assert tables["food"].first()["name"] == "Сыры" and tables["wine_terms"].isEmpty()


def test_photo_scan(spark, tmp_path):
    for photo, name in (("main", "original.jpg"), ("flux_1", "original.jpg"), ("yandex_2", "original.png"), ("junk", "original.jpg")):
        (tmp_path / "w1" / photo).mkdir(parents=True)
        (tmp_path / "w1" / photo / name).write_bytes(b"x")
    got = rows(files.scan_photo_inventory(spark, str(tmp_path)), "photo", "is_main", "is_generated", "kind", "missing")
    assert got == [("flux_1", False, True, "flux", False), ("main", True, False, "main", False), ("yandex_2", False, False, "yandex", True)]
    assert rows(files.collect_eval_set(spark, str(tmp_path)), "expected", "photo")[0] == ("w1", "flux_1")


def test_exact_quantiles_match_sorted_values(spark):
    values = [float((i * 7919) % 1000) for i in range(5000)] + [3.0] * 4000
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)], "g int, v double")
    got = {r["g"]: (r["p95"], r["p10"]) for r in aggregates.exact_quantiles(df, ["g"], "v", {"p95": 0.95, "p10": 0.1}, accuracy=100).collect()}
    for g in (0, 1):
        s = sorted(v for i, v in enumerate(values) if i % 2 == g)
        assert got[g] == (s[-(-len(s) * 95 // 100) - 1], s[-(-len(s) * 10 // 100) - 1])


def test_streak_and_sessions(spark):
    days = spark.createDataFrame([(1, f"2024-01-0{d}") for d in (1, 2, 3, 5, 6)], "u int, d string").withColumn("d", F.to_date("d"))
    assert aggregates.longest_streak(days, "u", "d").first()["longest_streak"] == 3
    times = spark.createDataFrame([(1, t) for t in ("2024-01-01 00:00:00", "2024-01-01 00:59:00", "2024-01-01 01:59:00", "2024-01-01 03:00:00")], "u int, t string").withColumn("t", F.to_timestamp("t"))
    assert rows(aggregates.sessions(times, "u", "t", 3600), "n") == [(1,), (3,)]


def test_ranges_rank_like_one_window(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("k"))
    order = [F.col("k").desc(), F.col("id")]
    whole = df.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    assert rows(aggregates.enumerate_rows(df, order), "id", "rank") == rows(whole, "id", "rank")


def greedy(tokens, phrases):
    used, spans, out = set(), [], []
    for entity, phrase in sorted(phrases, key=lambda p: (-len(p[1]), -len(" ".join(p[1])))):
        for i in range(len(tokens) - len(phrase) + 1):
            span = (i, i + len(phrase))
            if entity not in used and tokens[i : span[1]] == phrase and not any(a < span[1] and span[0] < b for a, b in spans):
                used.add(entity)
                spans.append(span)
                out.append((entity, *span))
    return sorted(out)


def test_phrase_tagging(spark):
    texts = spark.createDataFrame([(1, "Cabernet Sauvignon & Sauvignon Blanc, sauvignon"), (2, "merlot merlot")], "id int, text string")
    phrases = [("cab", "cabernet sauvignon"), ("sau", "sauvignon"), ("bla", "sauvignon blanc"), ("mer", "Merlot")]
    dictionary = spark.createDataFrame(phrases, "entity string, spelling string")
    got = enrichment.tag_phrases(texts, dictionary, "id", "text")
    for key, raw in ((1, "cabernet sauvignon sauvignon blanc sauvignon"), (2, "merlot merlot")):
        mine = rows(got.filter(F.col("id") == key), "entity", "start", "end")
        assert mine == greedy(raw.split(), [(e, p.lower().split()) for e, p in phrases])
    assert texts.select(normalize_match_text(F.col("text"))).count() == 2


def test_glossary(spark):
    page = '<section class="lexicon-items"><div class="h2-heading">А</div><p><strong>Ассамблаж</strong> – смесь вин..</p><p><strong>ассамблаж</strong>: повтор</p><p><strong>Вино игристое</strong> - с газом &amp; пеной</p></section>'
    import uuid

    got = enrichment.extract_glossary(spark.createDataFrame([(1, page)], "id int, html string"), "id", "html", uuid.NAMESPACE_URL)
    assert rows(got, "term", "letter", "definition") == [("Ассамблаж", "А", "смесь вин."), ("Вино игристое", "А", "с газом & пеной")]
    terms = spark.createDataFrame([("t1", "Игристое вино"), ("t2", "Вино"), ("t3", "Балк")], "term_id string, term string")
    texts = spark.createDataFrame([(1, "Игристые вина и вино; Балка. Вино!")], "id int, text string")
    notes = glossary.annotate_terms(texts, glossary.term_index(terms), "id", "text")
    assert rows(notes, "term_id", "start", "end") == [("t1", 0, 13), ("t2", 16, 20)]
    pieces = glossary.segments(texts, notes, "id", "text").first()["pieces"]
    assert "".join(p["text"] for p in pieces) == "Игристые вина и вино; Балка. Вино!" and [p["term_id"] for p in pieces] == ["t1", None, "t2", None]


def test_wine_search(spark):
    schema = "item_id string, name string, producer string, grapes array<string>, region string, color string, sugar string, alcohol string, description string, foods array<string>, rating double"
    cards = spark.createDataFrame([
        ("1", "Абрау Брют", "Абрау-Дюрсо", ["Шардоне"], "Кубань", "Белое", "брют", "12%", "Свежее игристое", ["Закуски"], 4.8),
        ("2", "Каберне", "Фанагория", ["Каберне Совиньон"], "Кубань", "Красное", "сухое", "14,5%", "Плотное, с перцем", ["Мясо и стейки"], 4.2),
        ("3", "Саперави", "Фанагория", ["Саперави"], "Крым", "Красное", "полусладкое", None, None, [], None),
    ], schema)
    entries = facets.with_occasions(facets.prepare_entries(cards))
    searches = [facets.Search(1, text="abrau"), facets.Search(2, occasion="grill"), facets.Search(3, text="сапереви"), facets.Search(4, tastes=("full",), colors=("Красное",))]
    fixed, seen = facets.resolve_texts(entries, facets.search_table(spark, searches))
    assert {r["query_id"]: r["corrected"] for r in fixed.collect()} == {1: None, 2: None, 3: "саперави", 4: None}
    pages = {(r["query_id"], r["rank"]): r for r in facets.result_pages(seen, fixed).collect()}
    assert pages[1, 1]["item_id"] == "1" and pages[1, 1]["score"] == 40.0  # found through the Latin spelling
    assert pages[2, 1]["item_id"] == "2" and pages[2, 1]["score"] == 5.0
    assert pages[2, 1]["reasons"] == ["красное сухое — к жареному мясу", "сочетается с: мясо и стейки", "со специями — в описании: «перцем»", "насыщенное — в описании: «плотное»"]
    assert pages[3, 1]["item_id"] == "3" and pages[4, 1]["total"] == 1
    counts = {(r["dim"], r["value"]): r["n"] for r in facets.facet_counts(entries, seen, fixed).filter("query_id = 4").collect()}
    assert counts["colors", "Красное"] == 1 and counts["colors", "Белое"] == 0 and counts["dishes", "meat"] == 1 and counts["occasions", "grill"] == 1


@pytest.fixture(scope="module")
def split_events(spark, tmp_path_factory):
    """Events in several files, so a stream needs several batches."""
    base = f"{tmp_path_factory.mktemp('events')}/parts"
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    days = events.select(F.min("ts"), F.max("ts")).first()
    cuts = [days[0] + (days[1] - days[0]) / 4 * i for i in range(1, 4)]
    for low, high in zip([None, *cuts], [*cuts, None]):  # one file after another: streams read files by age
        part = events.filter(F.lit(True) if low is None else F.col("ts") >= low).filter(F.lit(True) if high is None else F.col("ts") < high)
        part.coalesce(1).write.mode("append").parquet(base)
    return events, base


def batches(spark, events, base, files=1):
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(base)


def viewed(df):
    return df.select(F.col("event_id").alias("search_id"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("item"), F.col("ts").alias("created_at"))


def test_change_log_resumes_and_equals_batch(spark, split_events, tmp_path):
    """One file a batch, stopped after each half of the files; deletes fall on both sides of the cuts."""
    events, base = split_events
    shape = lambda df: df.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("item"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), "value", "ts", F.col("event_id").alias("seq"))
    initial = events.filter("event_id % 7 = 0").select("user_id", F.lit(10_000 + F.col("event_id")).alias("item"), "value", F.col("ts").alias("created_at"), F.col("ts").alias("updated_at")).union(
        spark.createDataFrame([], "user_id long, item long, value double, created_at timestamp, updated_at timestamp"))
    files = sorted(os.listdir(base), key=lambda f: os.path.getmtime(f"{base}/{f}"))
    files = [f for f in files if f.endswith(".parquet")]
    grown = tmp_path / "grown"
    grown.mkdir()
    for part in (files[:2], files[2:]):
        for f in part:
            shutil.copy2(f"{base}/{f}", grown / f)
        got = jobs.change_log_stream(shape(batches(spark, events, str(grown))), initial, ["user_id", "item"], ["value"], "upsert", str(tmp_path / "job"))
    whole = activity.apply_changes(initial, shape(events), ["user_id", "item"], ["value"], "upsert")
    columns = ("user_id", "item", "value", "created_at", "updated_at")
    assert rows(got, *columns) == rows(whole, *columns)
    assert len([x for x in os.listdir(tmp_path / "job" / "out") if x.startswith("batch=")]) >= len(files)


def test_change_log_takes_many_keys_in_one_batch(spark, tmp_path):
    """Keys are reduced by the engine: one Python call per key took minutes for as many; puts and deletes follow the batches' order, null keys count."""
    n, schema = 200_000, "k long, v long, op string, ts timestamp, seq long"
    made = spark.range(3 * n).select((F.col("id") % n).alias("k"), F.col("id").alias("v"), F.when(F.col("id") % 7 == 3, "delete").otherwise("put").alias("op"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"))
    day = datetime.datetime(2020, 1, 1)
    late = spark.createDataFrame([(None, 5, "put", day, 1), (3, 0, "delete", day, 1), (5, 8, "put", day, 2)], schema)
    initial = spark.createDataFrame([(3, 1, day, day), (n + 1, 2, day, day)], "k long, v long, created_at timestamp, updated_at timestamp")
    for part in (made, late):  # the second batch is older than the first and still comes after it
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        begin = time.monotonic()
        got = jobs.change_log_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "log")), initial, ["k"], ["v"], "upsert", str(tmp_path / "job"))
        table = {r["k"]: (r["v"], r["created_at"], r["updated_at"]) for r in got.collect()}
        assert time.monotonic() - begin < 60
    assert table[None] == (5, day, day) and 3 not in table and table[n + 1] == (2, day, day) and table[5][0] == 8 and table[5][2] == day
    assert table[0] == (2 * n, *[datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=2 * n)] * 2)  # a delete lies between its puts
    ids = range(3 * n)
    assert len(table) == sum(any(i % 7 != 3 for i in ids[k::n][-1:]) for k in range(n) if k != 3) + 2


def test_latest_views_in_batches(spark, split_events, tmp_path):
    events, base = split_events
    got = jobs.latest_view_stream(viewed(batches(spark, events, base)), str(tmp_path / "views"))
    whole = latest_per_key(viewed(events).select("user_id", "item", "created_at", "search_id"), ["user_id", "item"], "created_at", "search_id")
    assert rows(got, "user_id", "item", "created_at", "search_id") == rows(whole, "user_id", "item", "created_at", "search_id")


def test_upsert_keeps_sticky_columns(spark):
    """A review edited without a notification keeps the link it had."""
    state = spark.createDataFrame([(1, 1, "old", 7, 0, 0), (2, 1, "old", 8, 0, 0)], "u int, i int, comment string, note int, created_at int, updated_at int")
    changes = spark.createDataFrame([(1, 1, "new", None, "put", 5, 1), (2, 1, "a", 9, "put", 5, 1), (2, 1, None, None, "put", 6, 2), (3, 1, "first", None, "put", 5, 1)], "u int, i int, comment string, note int, op string, ts int, seq int")
    got = activity.apply_changes(state, changes, ["u", "i"], ["comment", "note"], "upsert", sticky=("note",))
    assert sorted((r["u"], r["comment"], r["note"]) for r in got.collect()) == [(1, "new", 7), (2, None, 9), (3, "first", None)]


def test_nicknames_are_unique(spark):
    users = spark.range(500).select("id", F.when(F.col("id") % 5 == 0, F.concat(F.lit("n"), "id")).alias("nick"))
    got = activity.assign_nicknames(users, "id", "nick", "guest")
    assert got.select(F.lower("nick")).distinct().count() == 500 and got.filter("nick IS NULL").isEmpty()


def test_tokens_find_the_words_that_hold_them(spark):
    """All substrings of the vocabulary, in both scripts, against a plain search."""
    vocabulary = ["абрау", "дюрсо", "wine", "xerez", "a", "brand12", "12", "каберне"]
    latin = dict(spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", to_search_latin(F.col("w"))).collect())
    tokens = sorted({w[i:j] for w in vocabulary for i in range(len(w)) for j in range(i + 1, len(w) + 1)} | {"abrau", "kaberne", "vine", "zz", "kserez", "dursoo"})
    forms = dict(spark.createDataFrame([(t,) for t in tokens], "t string").select("t", to_search_latin(F.col("t"))).collect())
    got = facets.token_words(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(w,) for w in vocabulary], "known string"))
    assert rows(got, "token", "known") == sorted((t, w) for t in tokens for w in vocabulary if t in w or (forms[t] and forms[t] in latin[w]))


def test_search_plan_does_not_grow_with_the_searches(spark):
    from catalens.plans import faceted

    def nodes(n):
        e = faceted.entries(spark, "/root/testdata/sf0.001")
        searches = facets.search_table(spark, faceted.GRID[:n])
        seen = facets.examine(e, searches, faceted.PART_RULES)
        return facets.facet_counts(e, seen, searches, faceted.PART_RULES)._jdf.queryExecution().optimizedPlan().toString().count("\n")

    assert nodes(5) == nodes(1000)


def test_streamed_upserts_keep_sticky_columns_like_the_batch(spark, tmp_path):
    state = spark.createDataFrame([(1, 1, "old", 7, datetime.datetime(2020, 1, 1), datetime.datetime(2020, 1, 1))], "u int, i int, comment string, note int, created_at timestamp, updated_at timestamp")
    schema, day = "u int, i int, comment string, note int, op string, ts timestamp, seq int", lambda n: datetime.datetime(2020, 1, n)
    parts = [
        [(1, 1, "new", None, "put", day(5), 1), (2, 1, "a", 9, "put", day(5), 2)],
        [(2, 1, None, None, "put", day(6), 3), (3, 1, "first", None, "put", day(6), 4), (3, 1, "second", 4, "put", day(7), 5), (3, 1, "third", None, "put", day(8), 6)],
        [(1, 1, None, None, "delete", day(9), 7), (1, 1, "again", None, "put", day(10), 8)],
    ]
    for at, part in enumerate(parts):  # a restart between the batches
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
        got = jobs.change_log_stream(stream, state, ["u", "i"], ["comment", "note"], "upsert", str(tmp_path / "job"), sticky=("note",))
        whole = activity.apply_changes(state, spark.createDataFrame(sum(parts[: at + 1], []), schema), ["u", "i"], ["comment", "note"], "upsert", sticky=("note",))
        columns = ("u", "i", "comment", "note", "created_at", "updated_at")
        assert rows(got, *columns) == rows(whole, *columns)
    assert {(r["u"], r["comment"], r["note"]) for r in got.collect()} == {(1, "again", None), (2, None, 9), (3, "third", 4)}


def test_quantiles_of_many_columns_equal_numpy(spark):
    rng = np.random.default_rng(4)
    data = [(None if i % 7 == 0 else i % 3, float(x), None if i % 5 == 0 else int(y)) for i, (x, y) in enumerate(zip(rng.exponential(size=500), rng.integers(0, 9, 500)))] + [(9, None, None)]
    df = spark.createDataFrame(data, "k int, x double, y int")
    wanted = {"x_mid": ("x", 0.5, True), "x_95": ("x", 0.95, False), "y_mid": ("y", 0.5, True), "y_low": ("y", 0.0, False), "y_top": ("y", 1.0, False)}
    got = {r["k"]: r for r in aggregates.exact_quantiles_of(df, ["k"], wanted, accuracy=50).collect()}
    assert set(got) == {None, 0, 1, 2}
    for k, r in got.items():
        x, y = ([row[c] for row in data if row[0] == k and row[c] is not None] for c in (1, 2))
        assert r["x_mid"] == pytest.approx(np.median(x)) and r["x_95"] == sorted(x)[int(np.ceil(len(x) * 0.95)) - 1]
        assert (r["y_mid"], r["y_low"], r["y_top"]) == (np.median(y), min(y), max(y))
    assert aggregates.exact_quantiles_of(df.filter("false"), [], wanted).first()["x_mid"] is None
    plan = aggregates.exact_quantiles_of(df, ["k"], wanted)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2  # one pass for the sketch, one for the counts


def test_search_joins_keep_entries_apart(spark):
    """Sizes guessed from compressed files would send all postings or all entries to every machine."""
    from catalens.plans import faceted

    e = faceted.entries(spark, "/root/testdata/sf0.01")
    q = facets.search_table(spark, faceted.SEARCHES)
    for df in (facets.text_matches(e, facets.ready(q, faceted.PART_RULES).filter("size(tokens) > 0")), facets.examine(e, q, faceted.PART_RULES)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_pages_and_counts_of_copies_equal_those_of_single_entries(spark):
    from catalens.plans import faceted

    part = faceted.entries(spark, "/root/testdata/sf0.001")
    again = part.withColumn("item_id", F.col("item_id") + 100000).withColumn("shuffle", F.crc32(F.col("item_id").cast("string").cast("binary")))
    e = part.unionByName(again)
    q = facets.search_table(spark, faceted.SEARCHES + [faceted.grid_search(i) for i in range(20, 42)])
    seen = facets.examine(e, q, faceted.PART_RULES).cache()
    plain = facets.result_pages(seen, q)
    assert rows(facets.search_pages(e, q, faceted.PART_RULES), *plain.columns) == rows(plain, *plain.columns)
    plain = facets.facet_counts(e, seen, q, faceted.PART_RULES)
    assert rows(facets.facet_counts(e, facets.examine_alike(e, q, faceted.PART_RULES), q, faceted.PART_RULES), *plain.columns) == rows(plain, *plain.columns)


def test_badge_grid_is_opened_after_the_last_shuffle(spark):
    """Progress by hand, and a grid of users and badges that no exchange carries: it went through five."""
    from catalens.operators import badges as b

    table = spark.createDataFrame([(1, "a", "c", 5, "items", True, "s", False), (2, "b", "c", 9, "items", False, "s", False), (3, "m", "meta", 2, "earned", False, None, True), (4, "h", "meta", 1, "hidden_earned", True, None, True)], b.BADGE_SCHEMA)
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    metrics = spark.createDataFrame([(1, "items", 7), (1, "none", 3), (2, "items", None)], "user_id long, metric string, value long")
    earned = spark.createDataFrame([(2, "b", datetime.datetime(2020, 1, 1))], "user_id long, code string, earned_at timestamp")
    df = b.with_visibility(b.progress(users, table, metrics, earned))
    plan = df._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate explode")]
    assert "Exchange" not in above
    got = {(r["user_id"], r["code"]): (r["progress"], r["newly_earned"], r["earned"], r["visible"]) for r in df.collect()}
    assert got[1, "a"] == (5, True, True, True) and got[1, "b"] == (7, False, False, True) and got[1, "m"] == (1, False, False, True) and got[1, "h"] == (1, True, True, True)
    assert got[2, "a"] == (0, False, False, False) and got[2, "b"] == (0, False, True, True) and got[2, "m"] == (1, False, False, True) and got[2, "h"] == (0, False, False, False) and len(got) == 8
