"""Record and conversation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import records
from ..sources import excel, reports
from ..storage import scratch
from ..streaming import live
from ..streaming import telemetry as streams
from .catalog import query, table

COLS = ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"]
SRC = """src AS (SELECT c_custkey::VARCHAR AS k, CASE WHEN c_custkey % 4 = 0 THEN c_name || '*' ELSE c_name END AS n, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS m, c_nationkey AS x FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT (c_custkey + 1000000)::VARCHAR, c_name, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 50 = 0), tgt AS (SELECT c_custkey::VARCHAR AS k, c_name AS n, c_mktsegment AS m, c_nationkey AS x FROM customer)"""


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "customer").select(*COLS)
    s = t.where("c_custkey % 2 = 0").withColumns({"c_name": F.when(F.col("c_custkey") % 4 == 0, F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name")), "c_mktsegment": F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment"))})
    return t, s.unionByName(t.where("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000))


@query("d1_upsert", f"WITH {SRC} SELECT coalesce(tgt.k, src.k) AS c_custkey, CASE WHEN src.k IS NOT NULL THEN src.n ELSE tgt.n END AS c_name, CASE WHEN src.k IS NOT NULL THEN src.m ELSE tgt.m END AS c_mktsegment, CASE WHEN src.k IS NOT NULL THEN src.x ELSE tgt.x END AS c_nationkey FROM tgt FULL JOIN src ON tgt.k = src.k")
def d1(spark, d) -> DataFrame:
    return records.upsert(*_sides(spark, d), "c_custkey")


@query("a1_sheet_scan", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def a1(spark, d) -> DataFrame:
    # a workbook for each region, read with the types that its cells have
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey", F.col("n_regionkey").alias("book"))
    return excel.inferred(excel.parsed(excel.workbooks(n, "book"), ["n_nationkey", "n_name", "n_regionkey"]))


@query("b1_write_back", f"WITH {SRC} SELECT coalesce(tgt.k, src.k) AS c_custkey, CASE WHEN src.k IS NOT NULL THEN src.n ELSE tgt.n END AS c_name, CASE WHEN src.k IS NOT NULL THEN src.m ELSE tgt.m END AS c_mktsegment, (CASE WHEN src.k IS NOT NULL THEN src.x ELSE tgt.x END)::VARCHAR AS c_nationkey FROM tgt FULL JOIN src ON tgt.k = src.k")
def b1(spark, d) -> DataFrame:
    # upserted rows written as a workbook for each nation, then read back
    merged = records.upsert(*_sides(spark, d), "c_custkey").select(*COLS)
    return excel.parsed(excel.workbooks(merged.withColumn("book", F.col("c_nationkey")), "book"), COLS)


@query("b3_sample_log", "SELECT event_id, user_id, value FROM events")
def b3(spark, d) -> DataFrame:
    # samples appended in two runs, then read back
    e, path = table(spark, d, "events").select("event_id", "user_id", "value"), scratch(spark, "samples")
    for run in (0, 1):
        reports.append_csv(e.where(F.col("event_id") % 2 == run), path)
    return spark.read.schema(e.schema).option("header", True).csv(path)


LOG = f"""{SRC}, lg AS (SELECT src.k AS c_custkey, tgt.k IS NULL AS isnew, concat_ws(', ', CASE WHEN tgt.n IS DISTINCT FROM src.n THEN 'c_name: ' || coalesce(tgt.n, 'None') || ' -> ' || coalesce(src.n, 'None') END,
CASE WHEN tgt.m IS DISTINCT FROM src.m THEN 'c_mktsegment: ' || coalesce(tgt.m, 'None') || ' -> ' || coalesce(src.m, 'None') END, CASE WHEN tgt.x IS DISTINCT FROM src.x THEN 'c_nationkey: ' || coalesce(tgt.x::VARCHAR, 'None') || ' -> ' || coalesce(src.x::VARCHAR, 'None') END) AS ch
FROM src LEFT JOIN tgt ON tgt.k = src.k), cl AS (SELECT c_custkey, CASE WHEN isnew THEN 'new' WHEN ch <> '' THEN 'changed' ELSE 'same' END AS status, CASE WHEN isnew THEN '' ELSE ch END AS changes FROM lg)"""


@query("j17_change_log", f"WITH {LOG} SELECT * FROM cl")
def j17(spark, d) -> DataFrame:
    return records.change_log(*_sides(spark, d), "c_custkey")


@query("b2_notifications", f"WITH {LOG}, m AS (SELECT c_custkey, status || ' ' || c_custkey || CASE WHEN changes <> '' THEN ': ' || changes ELSE '' END AS t FROM cl WHERE status <> 'same') SELECT c_custkey, p::INT AS part, substring(t, p * 20 + 1, 20) AS message FROM (SELECT *, unnest(range(0, ceil(length(t) / 20.0)::BIGINT)) AS p FROM m)")
def b2(spark, d) -> DataFrame:
    return records.notifications(records.change_log(*_sides(spark, d), "c_custkey"), "c_custkey", 20)


@query("c1_renamed", "SELECT c_custkey, c_name AS label, NULL::VARCHAR AS note, c_mktsegment FROM customer")
def c1(spark, d) -> DataFrame:
    t = records.renamed(table(spark, d, "customer"), {"c_name": "label"}, ["c_custkey", "label", "note", "c_mktsegment"])
    return t.withColumn("note", F.col("note").cast("string"))


@query("c2_missing_columns", "SELECT unnest(['c_phone', 'c_email']) AS missing")
def c2(spark, d) -> DataFrame:
    gone = records.missing_columns(table(spark, d, "customer"), ["c_custkey", "c_phone", "c_name", "c_email"])
    return spark.createDataFrame([(c,) for c in gone], "missing string")


@query("c3_string_keys", "SELECT c_custkey::VARCHAR AS k, c_nationkey FROM customer")
def c3(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("k"), "c_nationkey")


@query("i1_append", "SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal, NULL::VARCHAR AS seg FROM supplier UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer")
def i1(spark, d) -> DataFrame:
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    return a.unionByName(b, allowMissingColumns=True)


@query("i2_difference", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def i2(spark, d) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).join(o, "k", "left_anti")


@query("i3_key_union", "SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders UNION SELECT s_suppkey FROM supplier")
def i3(spark, d) -> DataFrame:
    part = lambda t, c: table(spark, d, t).select(F.col(c).alias("k"))
    return part("customer", "c_custkey").union(part("orders", "o_custkey")).union(part("supplier", "s_suppkey")).distinct()


@query("i4_distinct", "SELECT DISTINCT c_mktsegment AS profile FROM customer")
def i4(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("profile")).distinct().orderBy("profile")


@query("a10_layered_config", """SELECT n_regionkey AS section, n_nationkey AS key, CASE WHEN n_nationkey % 3 = 0 THEN 'manual' WHEN n_nationkey % 2 = 0 THEN 'auto' ELSE 'fallback' END || n_nationkey AS value,
(CASE WHEN n_nationkey % 3 = 0 THEN 0 WHEN n_nationkey % 2 = 0 THEN 1 ELSE 2 END)::INT AS layer FROM nation""")
def a10(spark, d) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("section"), F.col("n_nationkey").alias("key"))
    layer = lambda name, by: n.where(F.col("key") % by == 0).withColumn("value", F.concat(F.lit(name), F.col("key").cast("string")))
    return records.layered(n, [layer("manual", 3), layer("auto", 2), layer("fallback", 1)], ["section", "key"], "value")


@query("a11_json_list", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '*' WHEN event_id % 3 = 1 THEN 'a' || event_id || ',b' ELSE '*' END AS origins FROM events")
def a11(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, None).when(F.col("event_id") % 3 == 1, F.concat(F.lit('["a'), F.col("event_id").cast("string"), F.lit('", "b"]'))).otherwise('["broken').alias("raw"))
    return e.select("event_id", F.array_join(records.json_list(F.col("raw")), ",").alias("origins"))


@query("a7_lookup", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k, CASE WHEN (props::JSON->>'k')::BIGINT % 2 = 0 THEN 'active' ELSE 'closed' END AS status FROM events")
def a7(spark, d) -> DataFrame:
    from ..sources.lookup import enrich

    e = table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))

    def service(keys: list) -> dict:
        return {k: {"status": "active" if k % 2 == 0 else "closed"} for k in keys if k is not None}

    return enrich(e, "k", service, "status string")


@query("g8_latest_by_role", "SELECT conv_id, max(turn) AS turn, max_by(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1")
def g8(spark, d) -> DataFrame:
    return records.latest_by_role(table(spark, d, "conversations"), "conv_id", "turn", "role", "assistant", ["text"])


@query("a8_thread_page", "SELECT conv_id, min(turn) AS first_id, max(turn) FILTER (r <= 3) AS last_id, least(count(*), 3)::BIGINT AS n, count(*) > 3 AS has_more FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY 1")
def a8(spark, d) -> DataFrame:
    return records.page(table(spark, d, "conversations"), "conv_id", "turn", 3).withColumn("n", F.col("n").cast("long"))


@query("n19_history", "SELECT conv_id, turn, string_agg(role || ':' || text, '|') OVER (PARTITION BY conv_id ORDER BY turn) AS history FROM conversations")
def n19(spark, d) -> DataFrame:
    h = records.history(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return h.select("conv_id", "turn", F.array_join(F.transform("history", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|").alias("history"))


@query("n19_live_history", "SELECT conv_id, turn, string_agg(role || ':' || text, '|') OVER (PARTITION BY conv_id ORDER BY turn) AS history FROM conversations")
def n19_live(spark, d) -> DataFrame:
    # sessions from a stream of the table's files, which may come in any order
    far = (table(spark, d, "conversations").agg(F.max("turn")).first()[0] or 0) + 1
    source = streams.read_stream(spark, f"{d}/conversations.parquet", 1000).withColumn("t", F.col("turn").cast("double"))
    found = live.drained(source, "conv_id", "turn", "t", lambda s: live.live_sessions(s, "conv_id", F.col("t"), "turn", "role", "text", late=f"{far} seconds"), scratch(spark), 3.0 * far)
    said = F.array_join(F.transform("history", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")
    return found.select(F.col("key").alias("conv_id"), F.col("id").alias("turn"), said.alias("history"))


@query("j16_chunks", "SELECT doc_id, p::INT AS part, substring(text, p * 4000 + 1, 4000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 4000.0)::BIGINT)) AS p FROM documents)")
def j16(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(scalar.chunks(F.col("text"))).alias("part", "chunk"))


@query("c14_empty_reply", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'Please enter a message.' ELSE text END AS reply, CASE WHEN turn % 4 = 0 THEN 'user' ELSE role END AS role FROM conversations")
def c14(spark, d) -> DataFrame:
    m = F.when(F.col("turn") % 3 != 0, F.col("text")).otherwise("  ")
    role = F.coalesce(F.when(F.col("turn") % 4 != 0, F.col("role")), F.lit("user"))
    return table(spark, d, "conversations").select("conv_id", "turn", records.reply_or_notice(m, F.col("text"), "Please enter a message.").alias("reply"), role.alias("role"))


@query("j19_flat_content", "SELECT conv_id, turn, 'text' AS type, text FROM conversations UNION ALL SELECT conv_id, turn, 'image', '{\"type\":\"image\"}' FROM conversations")
def j19(spark, d) -> DataFrame:
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("text"))
    text, none = F.struct(F.col("text").alias("value")), F.lit(None).cast("struct<value:string>")
    m = table(spark, d, "conversations").select("conv_id", "turn", F.array(part("text", text), part("image", none)).alias("content"))
    return m.select("conv_id", "turn", F.explode(scalar.flat_content(F.col("content"))).alias("c")).select("conv_id", "turn", "c.type", "c.text")


@query("n20_terminal_status", "SELECT o_custkey, min(o_orderkey) AS o_orderkey, min_by(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1")
def n20(spark, d) -> DataFrame:
    return records.terminal_status(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderstatus", ["F", "P"])


@query("n18_attempts", "SELECT o_custkey, max(a)::INT AS attempts, bool_or(ok) AS success, NOT bool_or(ok) AND max(a) >= 3 AS gave_up FROM (SELECT o_custkey, o_orderstatus = 'P' AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a FROM orders) WHERE a <= 3 GROUP BY 1")
def n18(spark, d) -> DataFrame:
    from pyspark.sql import Window

    a = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    r = table(spark, d, "orders").select("o_custkey", (F.col("o_orderstatus") == "P").alias("ok"), a.alias("a")).where("a <= 3")
    return records.attempts(r, "o_custkey", "a", "ok", 3)


@query("c4_tally", "SELECT count(*) AS total, count(*) FILTER (page_id % 5 <> 0 AND page_id % 3 <> 0) AS success, count(*) FILTER (page_id % 5 <> 0 AND page_id % 3 = 0) AS failed FROM pages")
def c4(spark, d) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 5 != 0, F.col("url")).when(F.col("page_id") % 10 == 0, "  ").alias("url"))
    return records.tally(p, "url", F.col("page_id") % 3 != 0)


@query("j20_local_time", "SELECT user_id, event_id, strftime(TIMESTAMP '2024-01-01' + INTERVAL 9 HOUR + to_seconds(floor(t)::BIGINT), '%Y-%m-%d %H:%M:%S') AS seoul FROM tl")
def j20(spark, d) -> DataFrame:
    from .catalog import timeline

    return timeline(spark, d).select("user_id", "event_id", scalar.local_time(F.lit(1704067200) + F.floor("t")).alias("seoul"))


@query("j18_classify", """SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the') THEN 'common' WHEN contains(lower(text), 'und') THEN 'german' WHEN contains(lower(text), 'que') THEN 'romance' ELSE 'other' END AS kind FROM conversations""")
def j18(spark, d) -> DataFrame:
    kind = scalar.classify(F.col("text"), [("the", "common"), ("und", "german"), ("que", "romance")], "other")
    return table(spark, d, "conversations").select("conv_id", "turn", kind.alias("kind"))


@query("u1_handlers", """SELECT conv_id, turn, CASE WHEN contains(lower(text), 'und') THEN 'retry' WHEN length(text) > 100 THEN 'split' ELSE 'log' END AS handler FROM conversations""")
def u1(spark, d) -> DataFrame:
    from ..functions.handlers import Handlers

    h = Handlers(default="log").register("split", F.length("text") > 100, 10).register("retry", F.lower("text").contains("und"), 5).register("drop", F.lit(True), 1)
    return table(spark, d, "conversations").select("conv_id", "turn", h.unregister("drop").column().alias("handler"))


@query("a2_directory_scan", "SELECT unnest(['documents.parquet', 'labels.parquet']) AS name")
def a2(spark, d) -> DataFrame:
    from ..sources.files import list_files

    found = list_files(spark, d, ("parquet",)).select(F.regexp_extract("path", r"/((?:documents|labels)\.parquet)(?:/|$)", 1).alias("name"))
    return found.where("name <> ''").distinct()
