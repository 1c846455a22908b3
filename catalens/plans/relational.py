"""Joins, set operations, aggregates, ordered scans and top-k over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalens.operators import aggregates as a
from catalens.operators import evaluation, logs, relational
from catalens.plans.registry import Tables, query

C = F.col


@query("order_customers", "J1", "SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000")
def _(spark, d):
    t = Tables(spark, d)
    return t.orders.filter("o_totalprice > 300000").join(t.customer, C("c_custkey") == C("o_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@query("items_with_region", "J2", "SELECT p_partkey, n_name FROM part LEFT JOIN nation ON n_nationkey = p_size")
def _(spark, d):
    t = Tables(spark, d)
    return t.part.join(t.nation, C("n_nationkey") == C("p_size"), "left").select("p_partkey", "n_name")


@query("orders_with_returns", "J3", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def _(spark, d):
    t = Tables(spark, d)
    return t.orders.join(t.lineitem.filter("l_returnflag = 'R'"), C("l_orderkey") == C("o_orderkey"), "left_semi").select("o_orderkey")


@query("customers_without_orders", "J4", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def _(spark, d):
    t = Tables(spark, d)
    return t.customer.join(t.orders.filter("o_orderstatus = 'F'"), C("o_custkey") == C("c_custkey"), "left_anti").select("c_custkey")


@query(
    "types_by_text", "J5",
    "SELECT p_partkey, alias FROM part LEFT JOIN (SELECT DISTINCT lower(p_type) || ' ' AS spelling, 'alias of ' || p_type AS alias FROM part WHERE p_type <> 'SMALL') ON trim(spelling) = lower(trim(p_type))",
)
def _(spark, d):
    t = Tables(spark, d)
    aliases = t.part.filter("p_type <> 'SMALL'").select(F.concat(F.lower("p_type"), F.lit(" ")).alias("spelling"), F.concat(F.lit("alias of "), "p_type").alias("alias")).distinct()
    return relational.text_join(t.part, aliases, F.lower(F.trim("p_type")), F.trim("spelling")).select("p_partkey", "alias")


@query(
    "events_in_own_period", "J6",
    """WITH o AS (SELECT user_id, min(ts) + INTERVAL 2 DAY AS a, min(ts) + INTERVAL 9 DAY AS b FROM events GROUP BY user_id) SELECT event_id, e.user_id FROM events e JOIN o USING (user_id) WHERE ts > a AND ts <= b""",
)
def _(spark, d):
    e = Tables(spark, d).events
    owners = e.groupBy("user_id").agg((F.min("ts") + F.expr("INTERVAL 2 DAY")).alias("a"), (F.min("ts") + F.expr("INTERVAL 9 DAY")).alias("b"))
    return relational.within_bounds(e, owners, "user_id", "ts", "a", "b").select("event_id", "user_id")


SESSION_SQL = """o AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
   s AS (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM o),
   ses AS (SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM s GROUP BY user_id, sid)"""


@query("activity_sessions", "W8", f"WITH {SESSION_SQL} SELECT * FROM ses")
def _(spark, d):
    return a.sessions(Tables(spark, d).events, "user_id", "ts", 6 * 3600)


@query("events_with_session", "J7,W8", f"WITH {SESSION_SQL} SELECT event_id, e.user_id, n FROM events e JOIN ses ON ses.user_id = e.user_id AND e.ts BETWEEN session_start AND session_end")
def _(spark, d):
    e = Tables(spark, d).events
    micros = lambda c: F.unix_micros(C(c).cast("timestamp"))
    spans = a.sessions(e, "user_id", "ts", 6 * 3600)
    return relational.contained_in(e.select("event_id", "user_id", "ts"), spans, ["user_id"], micros("ts"), micros("session_start"), micros("session_end"), 86_400_000_000).select("event_id", "user_id", "n")


@query("handled_items", "U1", "SELECT user_id, k FROM (SELECT user_id, (props->>'k')::BIGINT AS k FROM events WHERE event_type = 'purchase' UNION SELECT user_id, (props->>'k')::BIGINT FROM events WHERE event_type = 'signup')")
def _(spark, d):
    e = Tables(spark, d).events.select("user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    bought, joined = e.filter("event_type = 'purchase'"), e.filter("event_type = 'signup'")
    return bought.unionByName(joined).select("user_id", "k").distinct()


@query("shared_suppliers", "U2", "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N'")
def _(spark, d):
    pairs = Tables(spark, d).lineitem.select("l_partkey", "l_suppkey", "l_returnflag")
    return pairs.filter("l_returnflag = 'A'").drop("l_returnflag").intersect(pairs.filter("l_returnflag = 'N'").drop("l_returnflag"))


@query("suppliers_only_returned", "U3", "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R'")
def _(spark, d):
    pairs = Tables(spark, d).lineitem.select("l_partkey", "l_suppkey", "l_returnflag")
    return pairs.filter("l_returnflag = 'R'").drop("l_returnflag").subtract(pairs.filter("l_returnflag <> 'R'").drop("l_returnflag"))


@query("order_counts", "A1", "SELECT o_custkey, count(*) AS reviews, count_if(o_orderstatus <> 'P')::BIGINT AS commented FROM orders GROUP BY o_custkey")
def _(spark, d):
    return Tables(spark, d).orders.groupBy("o_custkey").agg(a.one("reviews"), F.count_if(C("o_orderstatus") != "P").alias("commented"))


@query("distinct_actors", "A2", "SELECT event_type, count(DISTINCT user_id) AS actors, count(DISTINCT props) AS items FROM events GROUP BY event_type")
def _(spark, d):
    return Tables(spark, d).events.groupBy("event_type").agg(F.count_distinct("user_id").alias("actors"), F.count_distinct("props").alias("items"))


@query("quiet_users", "A3", "SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id HAVING max(ts) <= TIMESTAMP '2024-01-30 06:00:00'")
def _(spark, d):
    return Tables(spark, d).events.groupBy("user_id").agg(F.max("ts").alias("last_seen")).filter("last_seen <= '2024-01-30 06:00:00'")


@query("most_likes_on_one", "A4", "SELECT l_suppkey, coalesce(max(likes), 0) AS best FROM (SELECT l_suppkey, l_partkey, count(*) FILTER (l_discount > 0.05) AS likes FROM lineitem GROUP BY ALL) GROUP BY l_suppkey")
def _(spark, d):
    per = Tables(spark, d).lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count_if(C("l_discount") > 0.05).alias("likes"))
    return per.groupBy("l_suppkey").agg(F.coalesce(F.max("likes"), F.lit(0)).alias("best"))


@query(
    "rating_distribution", "A5",
    f"""WITH r AS (SELECT l_partkey, CASE WHEN l_linenumber <= 5 THEN l_linenumber WHEN l_linenumber = 6 THEN 0 END AS rating FROM lineitem)
        SELECT l_partkey, count(*) AS reviews, count(nullif(rating, 0)) AS rated, round(avg(nullif(rating, 0)), 2) AS average, {', '.join(f'count_if(rating = {s})::BIGINT AS stars_{s}' for s in range(1, 6))} FROM r GROUP BY l_partkey""",
)
def _(spark, d):
    rating = F.when(C("l_linenumber") <= 5, C("l_linenumber")).when(C("l_linenumber") == 6, 0)
    return a.rating_summary(Tables(spark, d).lineitem.select("l_partkey", rating.alias("rating")), ["l_partkey"], "rating")


@query("value_spread", "A6", "SELECT user_id, event_type, round(avg(value), 6) AS mean, max(value) AS best, round(stddev_pop(value), 6) AS spread FROM events GROUP BY ALL")
def _(spark, d):
    return Tables(spark, d).events.groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("best"), F.round(F.stddev_pop("value"), 6).alias("spread"))


@query("mean_of_best_three", "A7", "SELECT user_id, round(avg(value), 6) AS top_mean FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS r FROM events) WHERE r <= 3 GROUP BY user_id")
def _(spark, d):
    return a.mean_of_best(Tables(spark, d).events, ["user_id"], "value", 3, "top_mean").withColumn("top_mean", F.round("top_mean", 6))


@query(
    "value_frequencies", "A10",
    """WITH w AS (SELECT p_partkey, 'word' AS dim, unnest(string_split(p_name, ' ')) AS value FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part)
       SELECT dim, value, count(*) AS n, count(*) <= 320 AS rare FROM w GROUP BY dim, value""",
)
def _(spark, d):
    p = Tables(spark, d).part
    pairs = F.concat(
        F.transform(F.split("p_name", " "), lambda w: F.struct(F.lit("word").alias("dim"), w.alias("value"))),
        F.array(F.struct(F.lit("type").alias("dim"), C("p_type").alias("value")), F.struct(F.lit("brand").alias("dim"), C("p_brand").alias("value"))),
    )
    counts = p.select(F.explode(pairs).alias("x")).select("x.*").groupBy("dim", "value").agg(a.one("n"))
    return counts.withColumn("rare", C("n") <= 320)


@query("largest_group", "A11", "SELECT o_custkey, max(n) AS largest FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey")
def _(spark, d):
    return Tables(spark, d).orders.groupBy("o_custkey", "o_orderpriority").agg(a.one("n")).groupBy("o_custkey").agg(F.max("n").alias("largest"))


@query("value_quantiles", "A12", "SELECT event_type, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.5) AS p50 FROM events GROUP BY event_type")
def _(spark, d):
    return a.exact_quantiles(Tables(spark, d).events, ["event_type"], "value", {"p95": 0.95, "p50": 0.5})


@query("value_medians", "A12", "SELECT user_id, round(median(value), 4) AS med FROM events GROUP BY user_id")
def _(spark, d):
    return a.exact_quantiles(Tables(spark, d).events, ["user_id"], "value", {"med": 0.5}, interpolate=True).withColumn("med", F.round("med", 4))


@query("order_page_with_total", "A13,T2,T4", "SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_custkey <> 77, o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 10")
def _(spark, d):
    hits = Tables(spark, d).orders.filter("o_orderstatus = 'P'")
    total = hits.agg(a.one("total"))
    rows = a.page(hits, [C("o_custkey") != 77, C("o_orderdate").desc(), C("o_orderkey")], 20, 10)
    return rows.select("o_orderkey", "o_orderdate").join(F.broadcast(total))  # single row


@query("latest_views", "W1", "SELECT user_id, k, ts, event_id FROM (SELECT user_id, (props->>'k')::BIGINT AS k, ts, event_id, row_number() OVER (PARTITION BY user_id, props->>'k' ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def _(spark, d):
    e = Tables(spark, d).events.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "ts", "event_id")
    return a.latest_per_key(e, ["user_id", "k"], "ts", "event_id")


@query(
    "longest_streaks", "W2,B3",
    """WITH dd AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), g AS (SELECT user_id, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS grp FROM dd)
       SELECT user_id, max(n) AS longest_streak FROM (SELECT user_id, grp, count(*) AS n FROM g GROUP BY ALL) GROUP BY user_id""",
)
def _(spark, d):
    e = Tables(spark, d).events.withColumn("day", F.to_date("ts"))
    return a.longest_streak(e, "user_id", "day")


@query("busiest_days", "W3,B3", "SELECT user_id, max(n) AS most_items_in_a_day FROM (SELECT user_id, ts::DATE AS day, count(DISTINCT props) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def _(spark, d):
    return a.busiest_day(Tables(spark, d).events.withColumn("day", F.to_date("ts")), "user_id", "day", "props")


def rank_order():
    return [C("c_acctbal").desc(), C("c_custkey")]


@query("customer_ranks", "W4", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer")
def _(spark, d):
    return a.enumerate_rows(Tables(spark, d).customer.select("c_custkey", "c_acctbal"), rank_order()).select("c_custkey", "rank")


@query("customer_ranks_ranged", "W4 partitioned path", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer")
def _(spark, d):
    return a.enumerate_rows(Tables(spark, d).customer.select("c_custkey", "c_acctbal"), rank_order()).select("c_custkey", "rank")


@query("first_seen_items", "W9", "SELECT user_id, props, min(event_id) AS event_id FROM events GROUP BY user_id, props")
def _(spark, d):
    return a.first_per_key(Tables(spark, d).events.select("user_id", "props", "ts", "event_id"), ["user_id", "props"], ["ts", "event_id"]).select("user_id", "props", "event_id")


@query("sorted_items", "T1,T3", "SELECT p_partkey, p_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_retailprice DESC, length(p_name) DESC, p_partkey) AS rank FROM part) WHERE rank <= 25")
def _(spark, d):
    order = [C("p_size").desc(), C("p_retailprice").desc(), F.length("p_name").desc(), C("p_partkey")]
    return a.top_k(Tables(spark, d).part, ["p_type"], order, 25).select("p_partkey", "p_type", "rank")


@query("item_page", "T1,T2", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 12 OFFSET 24")
def _(spark, d):
    return a.page(Tables(spark, d).part.select("p_partkey", "p_name"), [C("p_name"), C("p_partkey")], 12, 24)


@query("notification_queue", "T5", "SELECT o_custkey, last FROM (SELECT c_custkey AS o_custkey, max(o_orderdate) FILTER (o_orderstatus = 'F') AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) ORDER BY last NULLS FIRST, o_custkey LIMIT 200")
def _(spark, d):
    t = Tables(spark, d)
    last = t.orders.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    users = t.customer.select(C("c_custkey").alias("o_custkey")).join(last, "o_custkey", "left")
    return a.page(users, [C("last").asc_nulls_first(), C("o_custkey")], 200)


# --- request log: one event = one log line ---------------------------------------------------------
def log_lines(spark, d):
    e = Tables(spark, d).events
    method = F.when(C("event_type") == "signup", "POST").when(C("event_id") % 17 == 0, "OPTIONS").otherwise("GET")
    status = F.when(C("event_type") == "error", F.when(C("event_id") % 2 == 0, 500).otherwise(404)).otherwise(200)
    path = F.when(C("event_id") % 13 == 0, "/health").otherwise(F.concat(F.lit("/items/"), F.get_json_object("props", "$.k")))
    line = F.to_json(F.struct(
        F.date_format(C("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), F.lit("info").alias("level"), F.lit("api").alias("logger"),
        C("event_type").alias("event"), F.concat(F.lit("done "), "event_type").alias("message"), F.concat(F.lit("r"), (C("event_id") / 5).cast("int").cast("string")).alias("request_id"),
        F.concat(F.lit("anon:"), C("user_id").cast("string")).alias("actor"), method.alias("method"), path.alias("path"), status.alias("status"), (C("value") * 12).alias("millis"),
    ))
    return e.select("event_id", line.alias("value"))


LOG_EXTRA = {"method": "string", "path": "string", "status": "int", "millis": "double"}
LOG_SQL = """log AS (SELECT event_id, ts, event_type AS event, 'done ' || event_type AS message, 'r' || (event_id // 5) AS request_id, 'anon:' || user_id AS actor,
   CASE WHEN event_type = 'signup' THEN 'POST' WHEN event_id % 17 = 0 THEN 'OPTIONS' ELSE 'GET' END AS method, CASE WHEN event_id % 13 = 0 THEN '/health' ELSE '/items/' || (props->>'k') END AS path,
   CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 500 ELSE 404 END ELSE 200 END AS status, value * 12 AS millis FROM events),
   sev AS (SELECT *, CASE WHEN status >= 500 THEN 'error' WHEN status >= 400 OR millis >= 5000 THEN 'warning' WHEN method IN ('OPTIONS', 'HEAD') OR path LIKE '/health%' THEN 'debug' ELSE 'info' END AS severity FROM log)"""


def parsed_log(spark, d):
    p = logs.parse_events(log_lines(spark, d), "value", LOG_EXTRA)
    return p.withColumn("severity", logs.severity(C("status"), C("millis"), C("method"), C("path")))


@query("parsed_log", "L1,S12", f"WITH {LOG_SQL} SELECT event_id, ts, event, message, request_id, actor, path, status, round(millis, 6) AS millis FROM sev")
def _(spark, d):
    return parsed_log(spark, d).select("event_id", C("ts").cast("timestamp_ntz").alias("ts"), "event", "message", "request_id", "actor", "path", "status", F.round("millis", 6).alias("millis"))


@query("severity_counts", "L2", f"WITH {LOG_SQL} SELECT severity, event, count(*) AS n FROM sev GROUP BY ALL")
def _(spark, d):
    return parsed_log(spark, d).groupBy("severity", "event").agg(a.one("n"))


@query(
    "request_traces", "L3",
    f"""WITH {LOG_SQL}, e AS (SELECT request_id, min(ts) AS started, count(*) AS events, arg_max(event, event_id) AS outcome FROM sev GROUP BY request_id)
        SELECT request_id, event_id, event, events, outcome, ((epoch_us(ts) - epoch_us(started)) / 1000)::DOUBLE AS offset_ms FROM sev JOIN e USING (request_id)""",
)
def _(spark, d):
    return logs.request_trace(parsed_log(spark, d), "request_id", "ts", ["event_id", "event"], "event").select("request_id", "event_id", "event", "events", "outcome", "offset_ms")


STAGE_SQL = """st AS (SELECT event_id, stage, round(m, 6) AS millis, CASE WHEN value > 0 THEN least(100.0, m / value * 100) ELSE 0 END AS share FROM
   (SELECT event_id, value, unnest(['visual', 'text', 'rank']) AS stage, unnest([value * 0.5, (event_id % 7) * 10.0, value / 10]) AS m FROM events))"""


def stages(spark, d):
    e = Tables(spark, d).events.select("event_id", "value", F.round(C("value") * 0.5, 6).alias("visual"), ((C("event_id") % 7) * 10.0).alias("text"), F.round(C("value") / 10, 6).alias("rank"))
    return logs.stage_shares(e, ["visual", "text", "rank"], "value", ["event_id"])


@query("stage_shares", "L4", f"WITH {STAGE_SQL} SELECT event_id, stage, round(share, 4) AS share FROM st")
def _(spark, d):
    return stages(spark, d).select("event_id", "stage", F.round("share", 4).alias("share"))


@query("stage_percentiles", "L4,A12", f"WITH {STAGE_SQL} SELECT stage, quantile_disc(millis, 0.5) AS p50, quantile_disc(millis, 0.95) AS p95 FROM st GROUP BY stage")
def _(spark, d):
    return logs.stage_percentiles(stages(spark, d))


@query("one_event_kind", "L5", f"WITH {LOG_SQL} SELECT event_id, request_id FROM sev WHERE event = 'purchase'")
def _(spark, d):
    return logs.only_event(parsed_log(spark, d), "purchase").select("event_id", "request_id")


@query("latency_by_text_use", "E6", "SELECT user_id % 2 = 0 AS text_used, count(*) AS requests, round(avg(value * 15), 4) AS mean, max(value * 15) AS max, round(avg((value * 15 < 3000)::INT), 6) AS within_sla, quantile_disc(value * 15, 0.95) AS p95, round(median(value * 15), 4) AS median FROM events GROUP BY 1")
def _(spark, d):
    e = Tables(spark, d).events.select((C("user_id") % 2 == 0).alias("text_used"), (C("value") * 15).alias("millis"))
    return evaluation.latency_report(e, ["text_used"], "millis")


@query("latency_overall", "E6", "SELECT count(*) AS requests, round(avg(value * 15), 4) AS mean, max(value * 15) AS max, round(avg((value * 15 < 3000)::INT), 6) AS within_sla, quantile_disc(value * 15, 0.95) AS p95, round(median(value * 15), 4) AS median FROM events")
def _(spark, d):
    return evaluation.latency_report(Tables(spark, d).events.select((C("value") * 15).alias("millis")), [], "millis")
