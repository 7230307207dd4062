"""Links and blocks of a page corpus.

Everything about one page happens inside its row, on arrays: order is the
array's, so taking a page's links apart and de-duplicating them needs no
shuffle, and a page is never larger than its own text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriatim.functions import urls as U
from seriatim.functions.bind import let
from seriatim.operators import ordered, routing
from seriatim.sources.shared import measured, written

#: What holds no anchors although it may look so.
HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
#: What a body shows only without scripts.
NOSCRIPT = r"(?is)<noscript\b.*?</noscript\s*>"
#: An attribute's value, and the attributes that stand before the one looked for.
_VALUE = r"(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
_OTHERS = rf"(?:\s+(?!href\s*=)[^\s>\"'=]+(?:\s*=\s*{_VALUE})?)*+"
#: The rest of a tag; a quoted value may hold its closing sign.
_REST = r"[^>\"']*+(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*+)*+"
#: An anchor's href, double-quoted, single-quoted or bare.
ANCHOR_HREF = rf"(?is)<a{_OTHERS}\s+href\s*=\s*({_VALUE})"
#: A whole anchor, its text included.
ANCHOR = rf"(?is)<a{_OTHERS}\s+href\s*=\s*{_VALUE}{_REST}>.*?</a\s*>"
TAG = rf"(?s)<{_REST}>|<[^>]*>"
#: A character reference, by number or by name.
REFERENCE = r"&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[A-Za-z][A-Za-z0-9]*;|&|[^&]+"


def visible(html: Column) -> Column:
    return F.regexp_replace(html, HIDDEN, "")


def _referred(part: Column) -> Column:
    """What one character reference stands for; anything else as it is."""
    hexadecimal = F.lower(F.substring(part, 3, 1)) == "x"
    digits = F.when(hexadecimal, F.regexp_extract(part, "^&#[xX](.*);$", 1)).otherwise(
        F.hex(F.regexp_extract(part, "^&#([0-9]+);$", 1).try_cast("bigint"))
    )
    code = F.conv(digits, 16, 10).try_cast("bigint")
    sign = F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
    valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    names = F.create_map(*(F.lit(x) for n, c in sorted(name2codepoint.items()) for x in (n, chr(c))))
    named = F.try_element_at(names, F.regexp_extract(part, "^&(.*);$", 1))
    return (
        F.when(~F.startswith(part, F.lit("&")), part)
        .when(F.startswith(part, F.lit("&#")), F.when(valid, sign).otherwise(part))
        .otherwise(F.coalesce(named, part))
    )


def unescape(text: Column) -> Column:
    """Character references undone, each once: by number, and by the names HTML 4 knows."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), _referred)
    return F.when(F.contains(text, F.lit("&")), F.array_join(parts, "")).otherwise(text)


def _unquoted(href: Column) -> Column:
    return unescape(F.regexp_replace(href, r"^[\"']|[\"']$", ""))


def hrefs(html: Column) -> Column:
    """Every anchor's href in document order."""
    return F.transform(F.regexp_extract_all(visible(html), F.lit(ANCHOR_HREF), F.lit(1)), _unquoted)


def text_of(markup: Column) -> Column:
    return U.strip(unescape(F.regexp_replace(markup, TAG, "")))


def anchors(html: Column) -> Column:
    """Every anchor as ``(href, text)`` in document order."""
    return F.transform(
        F.regexp_extract_all(visible(html), F.lit(ANCHOR), F.lit(0)),
        lambda a: F.struct(
            _unquoted(F.regexp_extract(a, ANCHOR_HREF, 1)).alias("href"), text_of(a).alias("text")
        ),
    )


def block(html: Column, tag: str) -> Column:
    """What stands between every ``<tag>`` and its end, in a row; ``""`` without one."""
    found = F.regexp_extract_all(visible(html), F.lit(rf"(?is)<{tag}\b{_REST}>(.*?)</{tag}\s*>"), F.lit(1))
    return F.array_join(found, "\n")


def resolved_links(pages: DataFrame, base: str = "url", html: str = "html") -> DataFrame:
    """One row per anchor: ``pos`` from 1, ``href`` as written, ``link`` resolved, fragment kept."""
    with_base = pages.withColumn("_base", U.base_parts(F.col(base)))
    kept = [c for c in pages.columns if c != html]
    return (
        with_base.select(*kept, "_base", F.posexplode(hrefs(F.col(html))).alias("_at", "href"))
        .withColumn("pos", F.col("_at") + 1)
        .withColumn("link", U.resolve_from(F.col("_base"), F.col("href")))
        .drop("_at", "_base")
    )


def page_links(pages: DataFrame, base: str = "url", html: str = "html", within: str | None = None) -> DataFrame:
    """A page's links in page order, each once, fragments dropped, the page itself left out.

    ``within`` narrows to the blocks of that tag. ``pos`` counts the
    distinct links of the page from 1.
    """
    markup = F.col(html) if within is None else block(F.col(html), within)
    kept = [c for c in pages.columns if c != html]
    found = F.transform(F.col("_hrefs"), lambda h: U.drop_fragment(U.resolve_from(F.col("_base"), h)))
    distinct = F.filter(F.array_distinct(found), lambda link: link != F.col("_base.page"))
    return (
        pages.withColumn("_base", U.base_parts(F.col(base)))
        .withColumn("_hrefs", F.array_distinct(hrefs(markup)))
        .select(*kept, F.posexplode(distinct).alias("_at", "link"))
        .withColumn("pos", F.col("_at") + 1)
        .drop("_at")
    )


def downloadable_links(pages: DataFrame, rules: DataFrame, base: str = "url", html: str = "html") -> DataFrame:
    """The links of every page that some rule takes, with the rule and what the link names."""
    return routing.taken(page_links(pages, base, html), rules, "link")


def same_host_links(pages: DataFrame, within: str, path_regex: str, base: str = "url", html: str = "html") -> DataFrame:
    """Links of the blocks of one tag whose path has the given shape and whose host is the page's own."""
    links = page_links(pages, base, html, within)
    link = F.col("link")
    return links.where(U.path(link).rlike(path_regex) & (U.host(link) == U.host(F.col(base))))


def own_work_links(
    pages: DataFrame, within: str | None, path_regex: str, own: str = "^/([^/]+)", base: str = "url", html: str = "html"
) -> DataFrame:
    """Links that name the page's own work, whatever their host.

    The first group of ``path_regex`` over a link's path is the link's work, that
    of ``own`` over the page's path the page's; a link or page without one has none.
    """
    links = page_links(pages, base, html, within)
    return links.where(U.path_group(F.col("link"), path_regex) == U.path_group(F.col(base), own))


def shaped_links(
    pages: DataFrame, path_regex: str, base: str = "url", html: str = "html", within: str | None = None
) -> DataFrame:
    """Links whose path has the given shape, on any host, the page itself included.

    Query and fragment are cut before repeats are dropped; ``pos`` counts what
    is left from 1.
    """
    markup = F.col(html) if within is None else block(F.col(html), within)
    kept = [c for c in pages.columns if c != html]
    found = F.transform(F.col("_hrefs"), lambda h: U.drop_query(U.resolve_from(F.col("_base"), h)))
    shaped = F.filter(F.array_distinct(found), lambda link: U.path(link).rlike(path_regex))
    return (
        pages.withColumn("_base", U.base_parts(F.col(base)))
        .withColumn("_hrefs", F.array_distinct(hrefs(markup)))
        .select(*kept, F.posexplode(shaped).alias("_at", "link"))
        .withColumn("pos", F.col("_at") + 1)
        .drop("_at")
    )


#: Page numbers a range is cut into at first, and a stretch of pages that is expanded at once.
PAGES_AT_FIRST, PAGES_AT_ONCE = 100_000, 2_000
#: Ranges that share a stretch, about; stretches of a task at most, and rows that are worth one.
RANGES_AT_ONCE, STRETCHES_PER_TASK, ROWS_PER_TASK = 1_000, 10, 50_000


def _blocks(first: Column, upto: Column, size: int) -> Column:
    """The numbers of the blocks of ``size`` pages a range meets; none if it is the wrong way round."""
    # ``sequence`` counts down when asked to, so only ranges the right way round reach it.
    return F.when(first <= upto, F.transform(F.sequence(first - first % size, upto, F.lit(size).cast("bigint")), lambda n: F.greatest(n, first)))


def expand_pages(df: DataFrame, url: str, last: str) -> DataFrame:
    """One row per page of a numbered range in ``url``; rows without a range pass through.

    ``last`` bounds an open-ended range. Adds ``page_url``, ``page_no``,
    ``open_ended`` and ``ranged``. A range the wrong way round has no pages.
    A few rows may stand for very many pages, so ranges are cut into stretches;
    those that name the same pages share one, where each page is spelt once for
    all of them and comes before the next page. A task has so few pages that a
    file's dictionary holds them all: however often a page is named, its text
    takes room once. Stretches are written on the way, to be dealt by number.
    Columns of maps are not taken.
    """
    start, end, alike = F.col("_from"), F.col("_end"), ["_before", "_after", "_width"]
    plain = F.array(F.lit(None).cast("bigint"))

    def cut(rows: DataFrame, first: Column, to: Column, size: int) -> DataFrame:
        found = F.explode(F.when(F.col("_width") < 0, plain).otherwise(_blocks(first, to, size)))
        return rows.withColumn("_from", found).withColumn("_end", F.least(to, start - start % size + (size - 1)))

    parts = F.col("_range")
    ranged = df.select(F.struct("*").alias("_row"), F.col(last).cast("bigint").alias("_last"), U.page_range(F.col(url)).alias("_range"))
    ranged = ranged.select(
        F.struct("_row", (parts.isNotNull() & parts["stop"].isNull()).alias("_open")).alias("_row"),
        F.coalesce(parts["before"], F.lit("")).alias("_before"),
        F.coalesce(parts["after"], F.lit("")).alias("_after"),
        F.coalesce(parts["width"], F.lit(-1)).alias("_width"),
        parts["first"].alias("_first"),
        F.coalesce(parts["stop"], "_last").alias("_upto"),
    )
    lists = ranged.groupBy(*alike).agg(F.ceil(F.count("*") / RANGES_AT_ONCE).cast("bigint").alias("_lists"))
    dealt = ranged.join(lists, alike, "left").withColumn("_list", F.pmod(F.xxhash64("_row"), F.coalesce("_lists", F.lit(1))))
    dealt = cut(cut(dealt, F.col("_first"), F.col("_upto"), PAGES_AT_FIRST), start, end, PAGES_AT_ONCE)
    named = [*alike, "_from", "_end", "_list"]
    stretches = dealt.groupBy(*named).agg(F.collect_list("_row").alias("_rows"))
    rows = F.size("_rows") * F.coalesce(end - start + 1, F.lit(1))
    stretches, seen = measured(stretches, "stretches", pages=F.coalesce(F.sum(rows), F.lit(0)))
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(spread, min(seen["rows"] // STRETCHES_PER_TASK, seen["pages"] // ROWS_PER_TASK))
    placed = stretches.repartitionByRange(tasks, *named).sortWithinPartitions(*named)

    # spelt inside the array: a column of its own would be spelt again for each range
    shape = F.struct(*(F.col(c).alias(c[1:]) for c in alike))
    numbers = F.when(start.isNull(), plain).otherwise(F.sequence(start, end))
    pages = F.transform(numbers, lambda n: F.struct(n.alias("no"), U.numbered(shape, n).alias("url")))
    spelt = placed.select("_width", "_rows", F.explode(pages).alias("_page")).select("_width", "_page", F.explode("_rows").alias("_of"))
    return spelt.select(
        "_of._row.*",
        F.col("_page.no").alias("page_no"),
        (F.col("_width") >= 0).alias("ranged"),
        F.col("_of._open").alias("open_ended"),
        F.coalesce("_page.url", F.col("_of._row")[url]).alias("page_url"),
    )


def fresh_links(
    links: DataFrame, group: list[str], page_no: str, link: str = "link", pos: str = "pos", keep: Sequence[str] = ()
) -> DataFrame:
    """Links not seen on an earlier page of their group: one row per (group, link) at its first page and place.

    ``keep`` names further columns of that row.

    A map-side combined minimum per link; a hot group is spread by its links.
    """
    return ordered.first_of_each(links, [*group, link], page_no, [pos, *keep], ties=[pos])


def _stopped_before(pages: DataFrame, fresh: DataFrame, group: list[str], page_no: str, failed: str) -> DataFrame:
    counts = fresh.groupBy(*group, page_no).agg(F.count(F.lit(1)).alias("_fresh"))
    # Fold the counts into the page list first: one row per page, no window.
    empty = F.col(failed) | F.col("_fresh").isNull()
    return (
        pages.join(counts, [*group, page_no], "left")
        .groupBy(*group)
        .agg(F.min(F.when(empty, F.col(page_no))).alias("_stop"))
    )


def paginate(
    pages: DataFrame,
    links: DataFrame,
    group: list[str],
    page_no: str,
    failed: str,
    *,
    open_ended: bool | str,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Fresh links of a group's pages, page after page.

    ``pages`` has one row per page (group, ``page_no``, ``failed``), ``links``
    the links of each. A failed page contributes nothing. A closed range steps
    over failed and empty pages; an open-ended one stops at the first of them.
    ``open_ended`` may name a boolean column of ``pages`` that says which kind a
    group is.
    """
    readable = links.join(pages.where(~F.col(failed)).select(*group, page_no), [*group, page_no], "left_semi")
    fresh = fresh_links(readable, group, page_no, keep=keep)
    if open_ended is False:
        return fresh
    # Written once: both the stop and the links before it are read off them.
    fresh = written(fresh, "fresh")
    walked = pages if open_ended is True else pages.where(F.col(open_ended))
    stop = _stopped_before(walked, fresh, group, page_no, failed)
    return (
        fresh.join(stop, group, "left")
        .where(F.col("_stop").isNull() | (F.col(page_no) < F.col("_stop")))
        .drop("_stop")
    )


def listing_end(
    pages: DataFrame,
    group: list[str],
    page_no: str,
    count: str,
    *,
    page_size: int,
    total: str | None = None,
    last_page: str | None = None,
    max_pages: int | None = None,
    span: int | None = None,
) -> DataFrame:
    """The pages a listing is read up to, the stopping page included.

    A listing ends at a page shorter than ``page_size``, once ``total`` rows are
    reached, at the pager's ``last_page``, or after ``max_pages`` pages. Adds
    ``place`` (page counted from 1) and ``upto`` (rows read up to this page).
    """
    outputs = {"upto": ordered.running(count), "place": ordered.place()}
    # Written once: the stop is found from all pages before any is dropped.
    told = written(ordered.scan(pages, group, page_no, outputs, span=span), "listing")
    ends = F.col(count) < page_size
    if total is not None:
        ends = ends | ((F.col(total) > 0) & (F.col("upto") >= F.col(total)))
    if last_page is not None:
        ends = ends | (F.col("place") >= F.col(last_page))
    if max_pages is not None:
        ends = ends | (F.col("place") >= max_pages)
    stop = told.groupBy(*group).agg(F.min(F.when(ends, F.col("place"))).alias("_stop"))
    return (
        told.join(stop, group, "left")
        .where(F.col("_stop").isNull() | (F.col("place") <= F.col("_stop")))
        .drop("_stop")
    )


#: The class of images that are characters of the text.
EMOJI = "emoji"
#: The class of the block that holds the page of a one-block comic.
COMIC_BLOCK = "comic-image"
IMAGE = rf"(?is)<img\b{_REST}>"
#: A tag, or the text up to the next one.
PIECE = rf"(?s)<[/!?A-Za-z]{_REST}>|<[/!?A-Za-z][^>]*>|(?:[^<]++|<(?![/!?A-Za-z]))++|<"
#: Elements without an end.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")


def page_images(markup: Column) -> Column:
    """The sources of a block's images in order; emoji and images without a source are none."""
    tags = F.regexp_extract_all(markup, F.lit(IMAGE), F.lit(0))
    emoji = rf"(?is)\sclass\s*=\s*(?:\"(?:[^\"]*\s)?{EMOJI}(?:\s[^\"]*)?\"|'(?:[^']*\s)?{EMOJI}(?:\s[^']*)?'|{EMOJI}[\s>/])"
    own = F.filter(tags, lambda tag: ~tag.rlike(emoji))
    sources = F.transform(own, lambda tag: _unquoted(F.regexp_extract(tag, r"(?is)\ssrc\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)))
    return F.filter(sources, lambda source: source != "")


def _pieces(html: Column) -> Column:
    """A body's tags and texts in order: ``kind``, the tag's ``name``, ``prose`` characters or page ``image``, ``comic``."""
    wide = rf"(?is)\sclass\s*=\s*(?:\"(?:[^\"]*\s)?{COMIC_BLOCK}(?:\s[^\"]*)?\"|'(?:[^']*\s)?{COMIC_BLOCK}(?:\s[^']*)?'|{COMIC_BLOCK}[\s>/])"

    def read(piece: Column) -> Column:
        name = F.lower(F.regexp_extract(piece, r"^</?([A-Za-z][^\s/>]*)", 1))
        kind = (
            F.when(~piece.rlike("^<[/!?A-Za-z]"), "text")
            .when(name == "", "other")
            .when(F.startswith(piece, F.lit("</")), "close")
            .when(name.isin(*VOID) | F.endswith(piece, F.lit("/>")), "void")
            .otherwise("open")
        )
        text = F.when(kind == "text", F.length(U.strip(unescape(piece)))).otherwise(0)
        image = F.when(name == "img", F.size(page_images(piece))).otherwise(0)
        comic = (kind == "open") & (name == "div") & piece.rlike(wide)
        return F.struct(kind.alias("kind"), name.alias("name"), text.alias("prose"), image.alias("image"), comic.alias("comic"))

    return F.transform(F.regexp_extract_all(html, F.lit(PIECE), F.lit(0)), read)


def article_blocks(html: Column) -> Column:
    """A body's blocks as ``(image, prose)``: so many page images, or so many characters of prose.

    Blocks are the direct children of the body, elements whatever is nested in
    them and the text between them. A block with text is prose, whatever images
    stand in it; prose is counted text by text, without blanks at either end. A
    body with a ``comic-image`` block has that block alone, the first of them.

    One fold over the tags keeps the names of the open elements: an end closes
    the innermost element of its name and all inside it, one without a beginning
    counts for nothing, and elements left open end with the body.
    """
    zero = F.lit(0)
    none = F.array().cast("array<struct<image:int,prose:int>>")
    start = F.struct(
        F.array().cast("array<string>").alias("open"), zero.alias("prose"), zero.alias("image"), none.alias("blocks"), zero.alias("comic"), zero.alias("pages")
    )

    def block(image: Column, prose: Column) -> Column:
        return F.array(F.struct(F.when(prose > 0, zero).otherwise(image).alias("image"), prose.alias("prose")))

    def step(held: Column, piece: Column) -> Column:
        names, kind = held["open"], piece["kind"]
        depth = F.size(names)
        at = F.array_position(names, piece["name"]).cast("int")
        opens, closes = kind == "open", (kind == "close") & (at > 0)
        outside = depth == 0
        alone = outside & (piece["prose"] + piece["image"] > 0)
        ends = closes & (at == depth)
        return F.struct(
            F.when(opens, F.concat(F.array(piece["name"]), names)).when(closes, F.slice(names, at + 1, depth)).otherwise(names).alias("open"),
            F.when(outside, zero).otherwise(held["prose"] + piece["prose"]).alias("prose"),
            F.when(outside, zero).otherwise(held["image"] + piece["image"]).alias("image"),
            F.when(ends, F.concat(held["blocks"], block(held["image"], held["prose"])))
            .when(alone, F.concat(held["blocks"], block(piece["image"], piece["prose"])))
            .otherwise(held["blocks"])
            .alias("blocks"),
            # the depth of the open comic block, -1 once it is closed
            F.when(piece["comic"] & (held["comic"] == 0), depth + 1)
            .when(closes & (held["comic"] > depth - at), F.lit(-1))
            .otherwise(held["comic"])
            .alias("comic"),
            (held["pages"] + F.when(held["comic"] > 0, piece["image"]).otherwise(0)).alias("pages"),
        )

    def finish(held: Column) -> Column:
        left = F.when(F.size(held["open"]) > 0, F.concat(held["blocks"], block(held["image"], held["prose"]))).otherwise(held["blocks"])
        return F.when(held["comic"] != 0, block(held["pages"], zero)).otherwise(left)

    return F.aggregate(_pieces(F.regexp_replace(visible(html), NOSCRIPT, "")), start, step, finish)


def body_blocks(html: Column, is_image: Callable[[Column], Column]) -> Column:
    """A body's paragraphs as ``(image, prose)``: a page image, or so many characters of prose.

    ``is_image`` says of a block's markup whether it is a page image.
    """
    shown = F.regexp_replace(html, NOSCRIPT, "")
    parts = F.regexp_extract_all(shown, F.lit(r"(?is)<p\b[^>]*>(.*?)</p\s*>"), F.lit(1))

    def block_of(markup: Column) -> Column:
        image = is_image(markup)
        return F.struct(
            image.alias("image"), F.when(image, F.lit(0)).otherwise(F.length(text_of(markup))).alias("prose")
        )

    return F.transform(parts, block_of)


def own_pages(blocks: Column) -> Column:
    """``(images, prose)``: the page images, and the prose between the first and the last of them.

    ``image`` of a block is a count, or whether it is one image. One fold over the blocks: prose counts once an image stands before and
    another one after it.
    """
    start = F.struct(F.lit(0).alias("images"), F.lit(0).alias("prose"), F.lit(0).alias("pending"))

    def step(held: Column, b: Column) -> Column:
        images = b["image"].cast("int")
        image = images > 0
        return F.struct(
            (held["images"] + images).alias("images"),
            F.when(image, held["prose"] + held["pending"]).otherwise(held["prose"]).alias("prose"),
            F.when(image | (held["images"] == 0), F.lit(0)).otherwise(held["pending"] + b["prose"]).alias("pending"),
        )

    return F.aggregate(
        blocks, start, step, lambda h: F.struct(h["images"].alias("images"), h["prose"].alias("prose"))
    )


#: Characters of prose allowed per page image before an article counts as text.
PROSE_PER_PAGE = 30


def is_comic(images: Column, prose: Column, category: Column, tags: Column, comic_words: tuple[str, ...]) -> Column:
    """Whether an article is a comic: it has page images, and its category or tags and little prose say so."""
    tagged = F.exists(tags, lambda t: is_comic_tag(t, comic_words))
    return (images > 0) & (
        (category == "comic") | (F.coalesce(tagged, F.lit(False)) & (prose <= PROSE_PER_PAGE * images))
    )


def is_comic_tag(tag: Column, comic_words: tuple[str, ...]) -> Column:
    held = F.lit(False)
    for word in comic_words:
        held = held | F.contains(tag, F.lit(word))
    return held


def series_of_tags(tags: Column, writers: Column, site: str, comic_words: tuple[str, ...]) -> Column:
    """The first tag that is no genre word, else the first writer, else the site."""
    own = F.filter(tags, lambda t: ~is_comic_tag(t, comic_words))
    return F.coalesce(F.get(own, F.lit(0)), F.get(writers, F.lit(0)), F.lit(site))


def first_label(anchors: DataFrame, group: list[str], text: str, order: list[str], filler: tuple[str, ...]) -> DataFrame:
    """Per link the first label that says something, ``""`` when none does."""
    says = (F.col(text) != "") & ~F.col(text).isin(*filler)
    key = F.when(says, F.struct(*order))
    return anchors.groupBy(*group).agg(F.coalesce(F.min_by(text, key), F.lit("")).alias("label"))


def longest_label(anchors: DataFrame, group: list[str], text: str, order: list[str]) -> DataFrame:
    """Per link its longest label, the first of equally long ones."""
    key = F.struct((-F.length(text)).alias("_short"), *order)
    return anchors.groupBy(*group).agg(F.coalesce(F.min_by(text, key), F.lit("")).alias("label"))
