"""What a rule table or a watch list holds that nothing would act on."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriatim.functions import urls as U
from seriatim.operators import routing


def unknown_keys(used: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys in use that nothing reads."""
    return used.select(key).distinct().join(known.select(key), key, "left_anti")


def listed_again(watchlist: DataFrame, url: str, pos: str) -> DataFrame:
    """Every entry whose url an earlier entry has."""
    first = watchlist.groupBy(url).agg(F.min(pos).alias("_first"))
    return watchlist.join(first, url).where(F.col(pos) > F.col("_first")).drop("_first")


def unroutable(watchlist: DataFrame, rules: DataFrame, url: str, search: str) -> DataFrame:
    """Entries that are no search page and that no rule takes."""
    return routing.unrouted(watchlist.where(~F.col(search)), rules, url)


def inventory(rules: DataFrame) -> DataFrame:
    """Rules in registry order with how many hosts and URL forms each has."""
    return rules.groupBy("priority", "rule").agg(
        F.count_distinct("host").alias("hosts"), F.count_distinct("form").alias("forms"), F.min("host").alias("first_host")
    )


def inventory_forms(rules: DataFrame) -> DataFrame:
    """What ``inventory`` counts: each host of a rule with every URL form it takes there."""
    return rules.select("priority", "rule", F.lower("host").alias("host"), "form", "kind").distinct()


def registry_gaps(rules: DataFrame, publishers: DataFrame, samples: DataFrame, url: str = "url") -> DataFrame:
    """What the registry lacks, as ``host`` and ``problem``.

    A host without a publisher, a host in the publisher table that no rule
    has, a host none of whose sample URLs is routed to a rule owning it.
    """
    hosts = rules.select("host", "rule").distinct()
    owned = hosts.select("host").distinct()
    named = publishers.where(F.coalesce("publisher", F.lit("")) != "").select("host")
    routed = routing.route(samples, rules, url).withColumn("host", U.host(F.col(url)))
    proven = routed.join(hosts, ["host", "rule"], "left_semi").select("host").distinct()
    found = [
        (owned.join(named, "host", "left_anti"), "no publisher"),
        (publishers.select("host").join(owned, "host", "left_anti"), "unknown host"),
        (owned.join(proven, "host", "left_anti"), "no sample routed"),
    ]
    rows = [df.select("host", F.lit(problem).alias("problem")) for df, problem in found]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def is_permutation(values: Column) -> Column:
    """Whether an array of whole numbers is 0..n-1 in some order."""
    size = F.size(values)
    return (size > 0) & (F.array_sort(values) == F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))))


