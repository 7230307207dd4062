"""Queries on column normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriatim.functions import dates as D
from seriatim.functions import text as T
from seriatim.plans import views
from seriatim.plans.registry import Registry
from seriatim.plans.views import sql
from seriatim.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.query

#: Names of a chapter's badge codes, from 0.
BADGES = ("none", "update", "free", "advance", "premium")


@query(
    "n1_japan_day",
    """
SELECT event_id, event_type,
  CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(ts AS DATE) ELSE CAST(ts + INTERVAL 9 HOUR AS DATE) END AS said,
  CAST(ts + INTERVAL 9 HOUR AS DATE) AS by_seconds, CAST(ts + INTERVAL 9 HOUR AS DATE) AS by_millis
FROM events""",
)
def n1(spark, folder):
    """Event times written the ways sites write them, read back as Japan days."""
    ts, kind = F.col("ts"), F.col("event_type")
    zulu = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ahead = F.date_format(ts + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'+09:00'")
    http = F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    said = (
        F.when(kind == "click", zulu)
        .when(kind == "view", ahead)
        .when(kind == "error", http)
        .when(kind == "purchase", F.date_format(ts, "yyyy年M月d日 更新"))
        .otherwise(F.date_format(ts, "yyyy/M/d"))
    )
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    return table(spark, folder, "events", "event_id", "ts", "event_type").select(
        "event_id",
        "event_type",
        D.japan_day(said).alias("said"),
        D.epoch_day(seconds).alias("by_seconds"),
        D.epoch_day(seconds * 1000).alias("by_millis"),
    )


@query(
    "n2_positive_int",
    """
SELECT number, count(*) AS n_lines FROM (SELECT CASE l_returnflag WHEN 'A' THEN CAST(l_quantity AS BIGINT)
  WHEN 'R' THEN NULL ELSE nullif(greatest(CAST(l_quantity AS BIGINT) - 10, 0), 0) END AS number FROM lineitem) GROUP BY number""",
)
def n2(spark, folder):
    held = F.col("l_quantity").cast("bigint")
    text = (
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit(" 　"), held.cast("string"), F.lit(" ")))
        .when(F.col("l_returnflag") == "R", F.concat(held.cast("string"), F.lit(".5")))
        .otherwise((held - 10).cast("string"))
    )
    numbers = table(spark, folder, "lineitem", "l_quantity", "l_returnflag").select(T.positive_int(text).alias("number"))
    return numbers.groupBy("number").agg(F.count(F.lit(1)).alias("n_lines"))


@query(
    "n3_label_number",
    sql("listing", body="SELECT episode_id, TRY_CAST(nullif(regexp_extract(label, '[0-9]+', 0), '') AS BIGINT) AS number FROM listing"),
)
def n3(spark, folder):
    """Numbers in labels, half of the labels spelt with full-width digits."""
    label = F.col("label")
    wide = F.translate(label, T.DIGITS, T.WIDE_DIGITS)
    spelt = F.when(F.col("open"), label).otherwise(wide)
    return views.listing(spark, folder).select("episode_id", T.label_number(spelt).alias("number"))


@query(
    "n4_title_split",
    """
SELECT p_partkey AS part_id,
  CASE WHEN p_size < 10 THEN 'hint ' || p_brand ELSE p_name END AS dot_series, CASE WHEN p_size < 10 THEN p_name ELSE p_type END AS dot_episode,
  p_name AS dash_series, CASE WHEN p_size < 10 THEN '' ELSE p_type || ' | x' END AS dash_episode,
  p_type AS bar_second,
  CASE WHEN p_size < 10 THEN p_brand ELSE p_name END AS bracket_series, CASE WHEN p_size < 10 THEN p_name ELSE p_brand || ' ' || p_type END AS bracket_episode,
  CASE WHEN p_size < 10 THEN p_name ELSE p_name || '　' || p_brand END AS work_series, p_type AS work_episode,
  CASE WHEN p_size < 10 THEN p_type || ' - ' || p_name ELSE p_name END AS hint_series, CASE WHEN p_size < 10 THEN p_brand ELSE p_brand || ' - ' || p_type END AS hint_episode
FROM part""",
)
def n4(spark, folder):
    """Each way of writing two titles in one, put together from part columns and taken apart again."""
    part = table(spark, folder, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    name, brand, kind, small = F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size") < 10

    def text(*parts):
        return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    dot = T.split_middle_dot(
        F.when(small, text(name, " | site")).otherwise(text("#", name, "・", kind, " | site")),
        text("#hint ", brand),
        F.lit("id"),
    )
    dash = T.split_dash(F.when(small, text(name, " | site")).otherwise(text(name, " - ", kind, " | x | site")))
    bracket = T.split_brackets(F.when(small, name).otherwise(text(brand, " 『", name, "』", kind)), brand)
    work = T.split_known_work(
        F.when(small, text(name, "　", kind)).otherwise(text(name, "　", brand, "　", kind)),
        F.when(small, F.lit("")).otherwise(text(name, "　", brand)),
    )
    hint = T.split_by_hint(
        text(brand, " - ", kind, " - ", name),
        F.when(small, F.lit("nothing that helps")).otherwise(text(name, " ", brand, " - ", kind, "を読みました")),
    )
    return part.select(
        F.col("p_partkey").alias("part_id"),
        dot["series"].alias("dot_series"),
        dot["episode"].alias("dot_episode"),
        dash["series"].alias("dash_series"),
        dash["episode"].alias("dash_episode"),
        T.bar_part(text(name, "｜ ", kind, "｜｜", brand), 1).alias("bar_second"),
        bracket["series"].alias("bracket_series"),
        bracket["episode"].alias("bracket_episode"),
        work["series"].alias("work_series"),
        work["episode"].alias("work_episode"),
        hint["series"].alias("hint_series"),
        hint["episode"].alias("hint_episode"),
    )


@query(
    "n5_credits",
    """
SELECT c_custkey AS series_id, c_name || ' (原作), ' || c_mktsegment || ' (作画)' AS credits, 2 AS n_names FROM customer""",
)
def n5(spark, folder):
    customer = table(spark, folder, "customer", "c_custkey", "c_name", "c_mktsegment")
    text = F.concat(
        F.lit("原作／"), F.col("c_name"), F.lit("、作画 ／ "), F.col("c_mktsegment"), F.lit("、編集／、原作／"), F.col("c_name"),
        F.lit("、無名"),
    )
    named = customer.select(F.col("c_custkey").alias("series_id"), T.credits(text, "、", "／").alias("held"))
    return named.select("series_id", F.array_join("held", ", ").alias("credits"), F.size("held").alias("n_names"))


@query(
    "n5_credit_rows",
    """
SELECT c_custkey AS series_id, 1 AS pos, c_name AS name, '原作' AS role FROM customer
UNION ALL SELECT c_custkey, 2, c_mktsegment, '作画' FROM customer""",
)
def n5_rows(spark, folder):
    """Credits as one row per distinct name and role."""
    customer = table(spark, folder, "customer", "c_custkey", "c_name", "c_mktsegment")
    text = F.concat(F.lit("原作／"), F.col("c_name"), F.lit("、作画／"), F.col("c_mktsegment"), F.lit("、原作／"), F.col("c_name"))
    held = F.posexplode(T.credits(text, "、", "／")).alias("at", "credit")
    return customer.select(F.col("c_custkey").alias("series_id"), held).select(
        "series_id",
        (F.col("at") + 1).alias("pos"),
        F.regexp_extract("credit", r"^(.*) \((.*)\)$", 1).alias("name"),
        F.regexp_extract("credit", r"^(.*) \((.*)\)$", 2).alias("role"),
    )


@query(
    "n6_path_segment",
    """
SELECT p_partkey AS part_id, CASE WHEN p_size < 5 THEN '_' ELSE replace(p_name, ' ', '／') || p_type || p_brand END AS segment FROM part""",
)
def n6(spark, folder):
    title = F.when(F.col("p_size") < 5, F.lit("?*. ")).otherwise(
        F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(":"), F.col("p_type"), F.lit('"<>|'), F.col("p_brand"), F.lit(". "))
    )
    part = table(spark, folder, "part", "p_partkey", "p_name", "p_type", "p_brand", "p_size")
    return part.select(F.col("p_partkey").alias("part_id"), T.path_segment(title).alias("segment"))


@query(
    "n7_fallback_title",
    """
SELECT o_orderkey AS episode_id, CASE o_orderstatus WHEN 'F' THEN o_orderpriority WHEN 'O' THEN 'series ' || o_custkey
  ELSE CAST(o_orderkey AS VARCHAR) END AS title FROM orders""",
)
def n7(spark, folder):
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    status = F.col("o_orderstatus")
    own = F.when(status == "F", F.col("o_orderpriority")).when(status == "O", F.lit("　 "))
    work = F.when(status == "P", F.lit("")).otherwise(F.concat(F.lit("series "), F.col("o_custkey").cast("string")))
    title = T.first_text(own, work, F.col("o_orderkey").cast("string"))
    return orders.select(F.col("o_orderkey").alias("episode_id"), title.alias("title"))


@query("n8_publisher_sign", "SELECT s_suppkey AS supplier_id, s_name AS publisher FROM supplier")
def n8(spark, folder):
    named = F.when(F.col("s_acctbal") > 0, F.concat(F.lit("配信元： "), F.col("s_name"))).otherwise(
        F.concat(F.lit(" "), F.col("s_name"), F.lit("　"))
    )
    supplier = table(spark, folder, "supplier", "s_suppkey", "s_name", "s_acctbal")
    return supplier.select(F.col("s_suppkey").alias("supplier_id"), T.publisher_sign(named).alias("publisher"))


@query(
    "n9_code_label",
    """
SELECT CASE l_linenumber - 1 WHEN 0 THEN 'none' WHEN 1 THEN 'update' WHEN 2 THEN 'free' WHEN 3 THEN 'advance' WHEN 4 THEN 'premium'
  ELSE CAST(l_linenumber - 1 AS VARCHAR) END AS badge, count(*) AS n_lines FROM lineitem GROUP BY 1""",
)
def n9(spark, folder):
    lines = table(spark, folder, "lineitem", "l_linenumber")
    badge = T.code_label(F.col("l_linenumber") - 1, BADGES).alias("badge")
    return lines.groupBy(badge).agg(F.count(F.lit(1)).alias("n_lines"))


@query(
    "n10_episode_title",
    """
SELECT p_partkey AS part_id, CASE WHEN p_size < 10 THEN p_name WHEN p_size < 20 THEN p_type WHEN p_size < 30 THEN CAST(p_partkey AS VARCHAR)
  ELSE p_name || ' ' || p_type END AS title,
  CASE WHEN p_size < 25 THEN p_brand ELSE '第' || p_size || '話' END AS volume,
  CASE WHEN p_size < 25 THEN '' ELSE p_name END AS caption
FROM part""",
)
def n10(spark, folder):
    part = table(spark, folder, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    size = F.col("p_size")
    main = F.when((size < 10) | (size >= 30), F.col("p_name")).otherwise(F.lit(""))
    sub = F.when(((size >= 10) & (size < 20)) | (size >= 30), F.col("p_type")).otherwise(F.lit(""))
    caption = F.when(size < 25, F.lit("最新話を読む")).otherwise(F.concat(F.col("p_name"), F.lit(" はこちらから")))
    return part.select(
        F.col("p_partkey").alias("part_id"),
        T.title_with_sub(main, sub, F.col("p_partkey").cast("string")).alias("title"),
        T.volume_title(F.when(size < 25, F.col("p_brand")).otherwise(F.lit("")), size).alias("volume"),
        T.caption_title(caption).alias("caption"),
    )
