"""What sites hand over beside plain pages: JSON in pages, feeds, CSV, nested documents.

Absent or broken documents give no rows, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriatim.functions import urls as U
from seriatim.functions.text import credit
from seriatim.operators.links import unescape


def script_json(html: Column, element_id: str) -> Column:
    """The body of ``<script id=...>`` as a variant; null when absent or no JSON."""
    body = F.regexp_extract(html, rf"(?is)<script\b[^>]*(?<![\w\-])id\s*=\s*[\"']{element_id}[\"'][^>]*>(.*?)</script\s*>", 1)
    return F.try_parse_json(F.nullif(U.strip(body), F.lit("")))


def attribute_json(html: Column, attribute: str) -> Column:
    """The JSON an attribute such as ``data-value`` holds, entities undone."""
    held = F.regexp_extract(html, rf"(?is)\s{attribute}\s*=\s*(\"[^\"]*\"|'[^']*')", 1)
    text = unescape(F.regexp_replace(held, r"^[\"']|[\"']$", ""))
    return F.try_parse_json(F.nullif(text, F.lit("")))


def assigned_json(html: Column, name: str) -> Column:
    """The array a script assigns to ``name``, up to the bracket and semicolon that end it; those in strings end nothing."""
    text, ends = r'"(?:[^"\\]++|\\.)*+"', r"\](?=\s*(?:;|</script))"
    body = F.regexp_extract(html, rf"(?is)\b{name}\s*=\s*(\[(?:[^\]\"]++|{text}|(?!{ends})\])*+\])\s*(?:;|</script)", 1)
    return F.try_parse_json(F.nullif(body, F.lit("")))


def feed_listing(feeds: DataFrame, xml: str, *, cut_query: bool = False) -> DataFrame:
    """One row per feed item with a link: ``pos`` in feed order, ``link`` trimmed."""
    schema = "channel struct<item:array<struct<link:string>>>"
    kept = [c for c in feeds.columns if c != xml]
    links = F.transform(F.from_xml(F.col(xml), schema)["channel"]["item"], lambda i: U.strip(i["link"]))
    told = F.filter(links, lambda link: link.isNotNull() & (link != ""))
    rows = feeds.select(*kept, F.posexplode(told).alias("_at", "link")).withColumn("pos", F.col("_at") + 1).drop("_at")
    return rows.withColumn("link", U.drop_query(F.col("link"))) if cut_query else rows


#: The columns of a works catalogue.
CATALOGUE = ("タイトル", "著者1", "著者2", "著者3", "クレジット1", "クレジット2", "クレジット3")


def works_catalogue(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """A works catalogue CSV with its order as ``line``: file, block of the file, row in the block.

    ``multi_line`` accepts line breaks inside quotes, at the price of one task per file.
    """
    header = ", ".join(f"`{name}` string" for name in CATALOGUE)
    raw = spark.read.csv(path, header=True, schema=header, multiLine=multi_line, escape='"')
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return raw.withColumn("line", place)


def catalogue_credits(catalogue: DataFrame, order: str = "line") -> DataFrame:
    """The credits of every title, ``名前 (役割), ...``; the last row of a title wins.

    Rows without a title or without any name do not count.
    """
    entries = F.array(*[credit(F.coalesce(f"著者{n}", F.lit("")), F.col(f"クレジット{n}")) for n in (1, 2, 3)])
    named = catalogue.select(
        U.strip(F.coalesce("タイトル", F.lit(""))).alias("title"),
        F.filter(entries, lambda e: e.isNotNull()).alias("_credits"),
        order,
    ).where((F.col("title") != "") & (F.size("_credits") > 0))
    text = F.array_join("_credits", ", ")
    return named.groupBy("title").agg(F.max_by(text, F.col(order)).alias("credits"))


def credit_rows(catalogue: DataFrame, order: str = "line") -> DataFrame:
    """One row per credited name of a title, places counted from 1."""
    credits = catalogue_credits(catalogue, order)
    return credits.select("title", F.posexplode(F.split("credits", ", ")).alias("_at", "credit")).select(
        "title", (F.col("_at") + 1).alias("pos"), "credit"
    )


def chapter_entries(works: DataFrame, chapters: str) -> DataFrame:
    """Nested chapters as one row per episode: chapter order, each chapter's extra episode last.

    ``chapters`` is ``array<struct<episodes array<T>, extra T>>``; adds
    ``chapter``, ``place`` (both from 1) and ``entry``.
    """
    kept = [c for c in works.columns if c != chapters]
    one = works.select(*kept, F.posexplode(chapters).alias("_chapter", "_held")).where(F.col("_held").isNotNull())
    nothing = F.slice(F.col("_held.episodes"), 1, 0)
    extra = F.filter(F.array("_held.extra"), lambda e: e.isNotNull())
    episodes = F.filter(F.coalesce("_held.episodes", nothing, F.slice(extra, 1, 0)), lambda e: e.isNotNull())
    return one.select(
        *kept, (F.col("_chapter") + 1).alias("chapter"), F.posexplode(F.concat(episodes, extra)).alias("_at", "entry")
    ).withColumn("place", F.col("_at") + 1).drop("_at")


RESOURCE = "struct<id:string,type:string,attributes:map<string,string>>"


def json_api(documents: DataFrame, body: str, work_type: str, order_key: str) -> DataFrame:
    """JSON:API documents as one row per episode, its work's attributes beside it.

    Episodes lacking attributes or the order key are left out; the work is the
    first included resource of its type. Adds ``episode_id``, ``order_no``,
    ``attributes``, ``work_id`` and ``work`` (null when none is included).
    """
    kept = [c for c in documents.columns if c != body]
    parsed = documents.withColumn(
        "_doc", F.from_json(F.col(body), f"struct<data:array<{RESOURCE}>,included:array<{RESOURCE}>>")
    )
    works = F.filter("_doc.included", lambda r: r["type"] == work_type)
    episodes = F.filter("_doc.data", lambda r: r["attributes"].isNotNull() & F.map_contains_key(r["attributes"], order_key))
    return (
        parsed.withColumn("_work", F.get(works, F.lit(0)))
        .select(*kept, "_work", F.explode(episodes).alias("_episode"))
        .select(
            *kept,
            F.col("_episode.id").alias("episode_id"),
            F.element_at("_episode.attributes", F.lit(order_key)).try_cast("bigint").alias("order_no"),
            F.col("_episode.attributes").alias("attributes"),
            F.col("_work.id").alias("work_id"),
            F.col("_work.attributes").alias("work"),
        )
    )


#: Rows that ``pages_by_count`` makes of one row at once, at most.
STRETCH = 1 << 16


def pages_by_count(episodes: DataFrame, base: str, count: str, stretch: int = STRETCH) -> DataFrame:
    """One page per number up to ``count``, named after ``base``; none without a count.

    Counts beyond ``stretch``, mistaken ones among them, are cut into stretches
    of stretches, which are dealt out before they are cut further: no array and
    no task holds more than ``stretch`` rows of one episode.
    """
    last, at = F.col(count).cast("bigint"), F.col("_at")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    few = episodes.where(last.between(1, stretch)).withColumn("page_no", F.explode(F.sequence(one, last)))
    cut = episodes.where(last > stretch).withColumn("_at", one).withColumn("_to", last)
    for width in (stretch * stretch, stretch, 1):
        steps = F.sequence(zero, F.call_function("div", F.col("_to") - at, F.lit(width).cast("bigint")))
        cut = cut.withColumn("_step", F.explode(steps)).withColumn("_at", at + F.col("_step") * width)
        cut = cut.withColumn("_to", F.least(F.col("_to"), at + (width - 1))).drop("_step")
        if width > 1:
            cut = cut.repartition("_at", base)
    pages = few.unionByName(cut.withColumnRenamed("_at", "page_no").select(*few.columns))
    return pages.withColumn("page_url", F.concat(F.col(base), F.col("page_no").cast("string"), F.lit(".jpg")))
