"""URL columns: parts, resolution, canonical forms, identifiers.

Splitting follows the generic-syntax pattern of RFC 3986, appendix B, so a URL
with characters ``java.net.URI`` refuses still yields its parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriatim.functions.bind import whole

#: RFC 3986 appendix B, one group per part of a URL.
URL_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?"

#: White space Python's ``str.strip`` removes and Spark's ``trim`` does not.
SPACE = r"[\s\u00a0\u3000]"


def strip(text: Column) -> Column:
    """Trim every kind of white space, the full-width space included."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URL_PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    """``host[:port]`` as written."""
    return _part(url, 2)


def host(url: Column) -> Column:
    """The lower-case host, without user information or port."""
    return F.lower(F.regexp_replace(authority(url), r"^.*@|:[0-9]*$", ""))


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def origin(url: Column) -> Column:
    """``scheme://authority``, the port kept."""
    return F.concat(scheme(url), F.lit("://"), authority(url))


def drop_fragment(url: Column) -> Column:
    return F.split_part(url, F.lit("#"), F.lit(1))


def drop_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#][\s\S]*$", "")


def query_value(url: Column, key: str) -> Column:
    """The first value of a query parameter; null when the URL does not carry the key."""
    found = F.regexp_extract(F.concat(F.lit("&"), query(url)), rf"&({key}=[^&]*)", 1)
    return F.when(found != "", F.substr(found, F.lit(len(key) + 2)))


def query_holds(held: Column, key: Column) -> Column:
    """Whether a query string carries ``key`` with a value; ``key`` may differ per row."""
    asked = F.concat(F.lit("&"), held, F.lit("&"))
    return F.contains(asked, F.concat(F.lit("&"), key, F.lit("="))) & ~F.contains(
        asked, F.concat(F.lit("&"), key, F.lit("=&"))
    )


def path_group(url: Column, pattern: str, group: int = 1) -> Column:
    """A group of ``pattern`` over the path; null when the path is shaped otherwise."""
    where = path(url)
    return F.when(where.rlike(pattern), F.regexp_extract(where, pattern, group))


def force_https(url: Column) -> Column:
    return F.regexp_replace(url, "^[hH][tT][tT][pP]:", "https:")


def drop_suffix(url: Column, suffix: str) -> Column:
    """A closing ``suffix`` such as ``.json`` cut once, and nothing else."""
    return F.when(F.endswith(url, F.lit(suffix)), F.left(url, F.length(url) - len(suffix))).otherwise(url)


def drop_slashes(url: Column) -> Column:
    """Closing slashes cut, and nothing else."""
    return F.rtrim(url, F.lit("/"))


def canonical(url: Column) -> Column:
    """All cuts in one: query, fragment, ``.json`` or ``.html`` and closing slash, scheme forced to https.

    For sites known to spell one page in all these ways. Elsewhere the rules
    stand alone: ``drop_suffix``, ``force_https``, ``drop_slashes``,
    ``drop_query``; ``.html`` then stays.
    """
    return force_https(F.regexp_replace(url, r"(\.json|\.html)?/?([?#][\s\S]*)?$", ""))


def same_page(left: Column, right: Column) -> Column:
    """Whether two URLs differ in closing slashes only."""
    return F.rtrim(left, F.lit("/")) == F.rtrim(right, F.lit("/"))


def _without_dot_segments(raw: Column) -> Column:
    """Apply ``.`` and ``..`` segments of an absolute path, RFC 3986 section 5.2.4.

    One fold over the segments; ``..`` never climbs above the root.
    """
    segments = F.slice(F.split(raw, "/"), 2, F.greatest(F.size(F.split(raw, "/")) - 1, F.lit(0)))
    last = F.element_at(F.split(raw, "/"), -1)
    nothing = F.array().cast("array<string>")
    kept = F.aggregate(
        segments,
        nothing,
        lambda held, seg: F.when(seg == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))))
        .when(seg == ".", held)
        .otherwise(F.concat(held, F.array(seg))),
    )
    # A path ending in a dot segment names a directory.
    tail = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    dotted = F.concat(F.lit("/"), F.array_join(kept, "/"), tail)
    return F.when(raw.rlike(r"(^|/)\.\.?(/|$)"), dotted).otherwise(raw)


def base_parts(url: Column) -> Column:
    """What resolving against a page needs of its URL, worked out once per page."""
    folder = F.regexp_replace(path(url), r"[^/]*$", "")
    return F.struct(
        url.alias("url"),
        scheme(url).alias("scheme"),
        origin(url).alias("origin"),
        F.when(folder == "", F.lit("/")).otherwise(folder).alias("folder"),
        drop_query(url).alias("bare"),
        drop_fragment(url).alias("page"),
    )


def resolve_from(parts: Column, href: Column) -> Column:
    """A link as seen from a page (``base_parts``), like a browser would follow it.

    A reference with its own scheme is left as it is, so ``mailto:`` and the
    like pass through and are refused by routing later.
    """
    ref = strip(href)
    ref_path = F.regexp_extract(ref, r"^[^?#]*", 0)
    rest = F.substr(ref, F.length(ref_path) + 1)
    full = F.when(F.startswith(ref_path, F.lit("/")), ref_path).otherwise(F.concat(parts["folder"], ref_path))
    return (
        F.when(ref == "", parts["url"])
        .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(parts["scheme"], F.lit(":"), ref))
        .when(F.startswith(ref, F.lit("#")), F.concat(parts["page"], ref))
        .when(F.startswith(ref, F.lit("?")), F.concat(parts["bare"], ref))
        .otherwise(F.concat(parts["origin"], _without_dot_segments(full), rest))
    )


def resolve(base: Column, href: Column) -> Column:
    return resolve_from(base_parts(base), href)


#: How image paths name a scaled rendition, a size, and the rendition on a content network.
SCALED = r"-scaled(\.\w+)$"
SIZE_PREFIX = r"/mode[0-9]+_w[0-9]+-([^/]*)$"
RENDITION = r"^([^?#]*/mwimgs/[0-9a-f]/[0-9a-f]/)[^/?#]+/(img_[^/?#]+).*$"


def unscaled(url: Column) -> Column:
    """The upload a ``-scaled`` rendition was made from; null for any other URL."""
    return F.when(url.rlike(SCALED), F.regexp_replace(url, SCALED, "$1"))


def without_size_prefix(url: Column) -> Column:
    """A URL without the ``mode<n>_w<width>-`` prefix of its file name, else unchanged."""
    return F.regexp_replace(url, SIZE_PREFIX, "/$1")


def full_rendition(url: Column) -> Column:
    """The size segment of a CDN image path replaced by ``-``, else unchanged."""
    return F.when(url.rlike(RENDITION), F.regexp_replace(url, RENDITION, "$1-/$2")).otherwise(url)


def _padded(number: Column, width: int) -> Column:
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def content_id(title: Column, volume: Column) -> Column:
    """``1``, the title on ten digits, the volume on four: one join key for both."""
    return F.concat(F.lit("1"), _padded(title, 10), _padded(volume, 4))


def content_title(code: Column) -> Column:
    return whole(F.regexp_extract(code, "^[0-9]([0-9]{10})[0-9]{4}$", 1))


def content_volume(code: Column) -> Column:
    return whole(F.regexp_extract(code, "^[0-9][0-9]{10}([0-9]{4})$", 1), "int")


def work_of_product(product: Column) -> Column:
    """The work a product id belongs to: its first four digits, then ``0001``."""
    return F.concat(F.substring(product, 1, 4), F.lit("0001"))


def percent_decode(text: Column) -> Column:
    """Undo percent-encoding; a ``+`` stays one, malformed text stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def percent_encode(text: Column) -> Column:
    """Percent-encode everything but unreserved characters (the built-in encodes forms)."""
    form = F.url_encode(text)
    form = F.replace(form, F.lit("+"), F.lit("%20"))
    form = F.replace(form, F.lit("*"), F.lit("%2A"))
    return F.replace(form, F.lit("%7E"), F.lit("~"))


def percent_normal(text: Column) -> Column:
    """One spelling for every way of percent-encoding the same segment."""
    return percent_encode(percent_decode(text))


#: A numbered-page range inside a URL, closed or open-ended.
PAGE_RANGE = r"\[([0-9]+)-([0-9]*)\]"


def page_range(url: Column) -> Column:
    """A URL's page range taken apart: ``first``, ``stop`` (null when open-ended), ``width``, text before and after.

    Null when the URL has none. ``width`` is what a start with a leading zero pads to.
    """
    start = F.regexp_extract(url, PAGE_RANGE, 1)
    cut = F.instr(url, F.regexp_extract(url, PAGE_RANGE, 0))
    return F.when(
        url.rlike(PAGE_RANGE),
        F.struct(
            whole(start).alias("first"),
            whole(F.regexp_extract(url, PAGE_RANGE, 2)).alias("stop"),
            F.when(F.startswith(start, F.lit("0")), F.length(start)).otherwise(F.lit(0)).alias("width"),
            F.substr(url, F.lit(1), cut - 1).alias("before"),
            F.substr(url, cut + F.length(F.regexp_extract(url, PAGE_RANGE, 0))).alias("after"),
        ),
    )


def numbered(parts: Column, number: Column) -> Column:
    """A ``page_range`` with ``number`` in its place."""
    text = number.cast("string")
    shown = F.lpad(text, F.greatest(F.length(text), parts["width"]), F.lit("0"))
    return F.concat(parts["before"], shown, parts["after"])
