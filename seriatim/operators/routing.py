"""Which site rule takes a URL.

A rule table has one row per (rule, host, URL form): ``priority`` (registry
order), ``form`` (order inside the rule), ``rule``, ``host``, ``schemes``,
``kind`` (what the form names: an episode, a series, ...), ``path_regex``,
``query_key`` (a parameter the form needs, ``""`` for none), ``publisher`` (of
the rule), ``host_publisher`` (of this host, null for none). Adding a site is
adding rows.

Joins on the rules carry no broadcast hint: Spark broadcasts the rules while
their measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and
otherwise shuffles on host and segments, splitting a hot key at run time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriatim.functions import urls as U

RULE_SCHEMA = (
    "priority int, form int, rule string, host string, schemes array<string>, kind string, "
    "path_regex string, query_key string, publisher string, host_publisher string"
)


def register_rules(*tables: DataFrame) -> DataFrame:
    """One rule table of several, in ``RULE_SCHEMA``: how a user adds sites."""
    names = [field.split()[0] for field in RULE_SCHEMA.split(", ")]
    merged = tables[0].select(*names)
    for more in tables[1:]:
        merged = merged.unionByName(more.select(*names))
    return merged


def rules_of_forms(forms: DataFrame, schemes: tuple[str, ...] = ("http", "https")) -> DataFrame:
    """A rule table of URL forms as people write them down, in ``RULE_SCHEMA``.

    ``forms`` has ``priority``, ``form``, ``rule``, ``kind``, ``url_form``,
    ``publisher`` and ``host_publisher``. In the path of ``url_form`` a name in
    angle brackets stands for one segment or a part of one, as in
    ``https://a.example.com/w/<work>/<n>.html``; all else stands for itself and
    a closing slash may be there or not. A query ``?id=<id>`` asks for that
    parameter, the first where several are named. The rules take ``schemes``,
    whichever the form is written with.
    """
    form = F.col("url_form")
    literal = F.regexp_replace(U.path(form), r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    shape = F.rtrim(F.regexp_replace(literal, "<[^<>]*>", "[^/]+"), F.lit("/"))
    return forms.select(
        F.col("priority").cast("int"),
        F.col("form").cast("int"),
        "rule",
        U.host(form).alias("host"),
        F.array(*[F.lit(scheme) for scheme in schemes]).alias("schemes"),
        "kind",
        F.concat(F.lit("^"), shape, F.lit("/?$")).alias("path_regex"),
        F.regexp_extract(U.query(form), "^([^=&]+)=", 1).alias("query_key"),
        "publisher",
        "host_publisher",
    )


#: A character that stands for itself in a pattern, as it is or after a backslash.
_LITERAL = r"(?:[^\\.\[\]{}()*+?^$|/\x01]|\\[\\.\[\]{}()*+?^$|/-])"
#: The ways a pattern leaves a part of a segment free, and what such a part must be.
_FREE = {
    "\x01": "(?s)^.+$",
    "[0-9]+": "^[0-9]+$",
    "\\d+": "^[0-9]+$",
    "[a-z]+": "^[a-z]+$",
    "[a-z0-9]+": "^[a-z0-9]+$",
    "[A-Za-z0-9]+": "^[A-Za-z0-9]+$",
    "[0-9a-f]+": "^[0-9a-f]+$",
    "\\w+": "^[A-Za-z0-9_]+$",
}
_ONE_FREE = "|".join(re.escape(k) for k in _FREE)
#: A segment with at most one free part: what stands before it, the part, what stands after it.
_SEGMENT = rf"^({_LITERAL}*)(?:({_ONE_FREE})({_LITERAL}*))?$"


def _plain(literal: Column) -> Column:
    return F.regexp_replace(literal, r"\\(.)", "$1")


def segmented(rules: DataFrame) -> DataFrame:
    """Rules with their path patterns cut into segments.

    ``_segs`` has each segment's literal ``head``, the ``free`` part (``""`` for
    none) and the literal ``tail``; ``_slash`` is the closing slash: ``/`` must
    follow, ``/?`` may. Null segments mean a pattern of another shape, to be tried as it is.
    """
    whole = r"(?s)^\^/(.*?)(/\??)?\$$"
    marked = F.replace(F.regexp_extract("path_regex", whole, 1), F.lit("[^/]+"), F.lit("\x01"))
    marked = F.replace(marked, F.lit("[.]"), F.lit("\\."))
    parts = F.split(marked, "/")
    cut = F.transform(
        parts,
        lambda s: F.struct(
            _plain(F.regexp_extract(s, _SEGMENT, 1)).alias("head"),
            F.regexp_extract(s, _SEGMENT, 2).alias("free"),
            _plain(F.regexp_extract(s, _SEGMENT, 3)).alias("tail"),
        ),
    )
    told = F.col("path_regex").rlike(whole) & F.forall(parts, lambda s: s.rlike(_SEGMENT))
    return rules.withColumns({"_segs": F.when(told, cut), "_slash": F.regexp_extract("path_regex", whole, 2)})


def _forms(rules: DataFrame, by: list[Column], out: str) -> DataFrame:
    """One row per key with its forms; a key has as many as the registry has forms for it."""
    form = F.struct("priority", "form", "rule", "kind", "schemes", "query_key", "_segs", "_slash", "path_regex")
    return rules.groupBy(*by).agg(F.collect_list(form).alias(out))


def _with_parts(df: DataFrame, url: str) -> DataFrame:
    link = F.col(url)
    parts = df.withColumns(
        {"_host": U.host(link), "_scheme": U.scheme(link), "_path": U.path(link), "_query": U.query(link)}
    )
    rest = F.regexp_replace("_path", "^/", "")
    slashed = F.endswith(rest, F.lit("/"))
    segs = F.split(F.regexp_replace(rest, "/$", ""), "/")
    return parts.withColumns({"_slashed": slashed, "_parts": segs}).withColumns({"_n": F.size("_parts"), "_first": F.get("_parts", F.lit(0))})


def _fits(form: Column) -> Column:
    """Whether the path has the form's segments. All patterns are literals, so each is compiled once."""

    def one(seg: Column, part: Column) -> Column:
        middle = F.substr(part, F.length(seg["head"]) + 1, F.length(part) - F.length(seg["head"]) - F.length(seg["tail"]))
        free = F.lit(False)
        for name, shape in _FREE.items():
            free = F.when(seg["free"] == name, middle.rlike(shape)).otherwise(free)
        around = F.startswith(part, seg["head"]) & F.endswith(part, seg["tail"])
        long_enough = F.length(part) > F.length(seg["head"]) + F.length(seg["tail"])
        return F.when(seg["free"] == "", part == seg["head"]).otherwise(around & long_enough & free)

    pairs = F.zip_with(form["_segs"], F.col("_parts"), one)
    return F.startswith(F.col("_path"), F.lit("/")) & ((form["_slash"] == "/?") | ((form["_slash"] == "/") == F.col("_slashed"))) & F.forall(pairs, lambda fits: fits)


def _takes(form: Column) -> Column:
    return F.array_contains(form["schemes"], F.col("_scheme")) & (
        (form["query_key"] == "") | U.query_holds(F.col("_query"), form["query_key"])
    )


def dispatched(df: DataFrame, rules: DataFrame, url: str) -> DataFrame:
    """``df`` with the forms that take each URL as ``_taking``, in registry order; none where no rule does.

    A form is found by its host, number of segments and first segment, or by
    host and number where the first segment is free, so a URL meets few of a
    host's forms however many there are, and these are compared segment by
    segment. Only patterns of another shape are tried one by one on all URLs of
    their host. Three joins that add no rows, on keys of the rule table alone.
    """
    cut = segmented(rules).withColumn("_host", F.lower("host"))
    shaped = cut.where(F.col("_segs").isNotNull()).withColumn("_n", F.size("_segs"))
    named = shaped.where(F.get("_segs", F.lit(0))["free"] == "").withColumn("_first", F.get("_segs", F.lit(0))["head"])
    by_name = _forms(named, ["_host", "_n", "_first"], "_named")
    by_number = _forms(shaped.where(F.get("_segs", F.lit(0))["free"] != ""), ["_host", "_n"], "_numbered")
    by_host = _forms(cut.where(F.col("_segs").isNull()), ["_host"], "_other")
    met = (
        _with_parts(df, url)
        .join(by_name, ["_host", "_n", "_first"], "left")
        .join(by_number, ["_host", "_n"], "left")
        .join(by_host, "_host", "left")
    )
    none = F.array().cast(by_host.schema["_other"].dataType)
    shaped_forms = F.filter(F.concat(F.coalesce("_named", none), F.coalesce("_numbered", none)), lambda f: _takes(f) & _fits(f))
    other_forms = F.filter(F.coalesce("_other", none), lambda f: _takes(f) & F.rlike(F.col("_path"), f["path_regex"]))
    taking = F.array_sort(
        F.transform(F.concat(shaped_forms, other_forms), lambda f: F.struct(f["priority"].alias("priority"), f["form"].alias("form"), f["rule"].alias("rule"), f["kind"].alias("kind")))
    )
    return met.select(*df.columns, taking.alias("_taking"))


def suitable(df: DataFrame, rules: DataFrame, url: str = "url", out: str = "suitable") -> DataFrame:
    """Whether some rule names the URL's host exactly and takes its scheme."""
    hosts = rules.groupBy(F.lower("host").alias("_host")).agg(
        F.array_distinct(F.flatten(F.collect_set("schemes"))).alias("_schemes")
    )
    parts = df.withColumns({"_host": U.host(F.col(url)), "_scheme": U.scheme(F.col(url))})
    return (
        parts.join(hosts, "_host", "left")
        .withColumn(out, F.coalesce(F.array_contains("_schemes", F.col("_scheme")), F.lit(False)))
        .drop("_host", "_scheme", "_schemes")
    )


def matching_forms(df: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Every form that takes a URL: one row per (URL, rule, kind), as ``rule`` and ``kind``."""
    met = dispatched(df, rules, url).withColumn("_form", F.explode("_taking"))
    return met.select(*df.columns, F.col("_form.priority"), F.col("_form.form"), F.col("_form.rule"), F.col("_form.kind"))


def _routed(met: DataFrame, columns: list[str]) -> DataFrame:
    return met.select(*columns, F.col("_form.rule").alias("rule"), F.col("_form.kind").alias("kind"))


def route(df: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """The first rule in registry order that takes each URL, as ``rule`` and ``kind``; null when none does.

    The first match is read off the forms the URL met, so no second shuffle
    gathers the candidates of a URL.
    """
    return _routed(dispatched(df, rules, url).withColumn("_form", F.get("_taking", F.lit(0))), df.columns)


def taken(df: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Only the URLs some rule takes, routed; the forms of a host are tried once per URL."""
    return _routed(dispatched(df, rules, url).withColumn("_form", F.explode(F.slice("_taking", 1, 1))), df.columns)


def unrouted(df: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    return route(df, rules, url).where(F.col("rule").isNull()).drop("rule", "kind")


def route_forced(df: DataFrame, rules: DataFrame, forced: str, url: str = "url") -> DataFrame:
    """Route each row with the one rule it names; ``known`` says whether that rule exists."""
    known = rules.select(F.col("rule").alias(forced)).distinct().withColumn("known", F.lit(True))
    mine = F.filter("_taking", lambda f: f["rule"] == F.col(forced))
    routed = _routed(dispatched(df, rules, url).withColumn("_form", F.get(mine, F.lit(0))), df.columns)
    return routed.join(known, forced, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def publisher_of(df: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """The publisher of each URL's host: the host's own, else its first rule's, else ``""``."""
    order = F.struct("priority", "form")
    hosts = rules.groupBy(F.lower("host").alias("_host")).agg(
        F.min_by("host_publisher", F.when(F.col("host_publisher").isNotNull(), order)).alias("_own"),
        F.min_by("publisher", order).alias("_rule"),
    )
    return (
        df.withColumn("_host", U.host(F.col(url)))
        .join(hosts, "_host", "left")
        .withColumn("publisher", F.coalesce("_own", "_rule", F.lit("")))
        .drop("_host", "_own", "_rule")
    )
