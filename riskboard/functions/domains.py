"""Registered domains by a table of public-suffix rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scale import lookup

_ADDRESS = r"^(\[.*\]|[0-9a-f]*:[0-9a-f:.]*|[0-9]{1,3}(\.[0-9]{1,3}){3})$"


def registered_domains(hosts: DataFrame, rules: DataFrame, column: str = "host") -> DataFrame:
    """``host, suffix, domain`` of each distinct host: its public suffix, and the suffix with
    one label more. ``rules`` has a column ``rule``, one public-suffix rule a row: plain
    (``co.id``), with a wildcard for one label (``*.ck``), or an exception to a wildcard
    (``!www.ck``). An exception wins, else the longest rule; without one the last label is
    the suffix. A host that is a suffix itself is its own domain; an address (IP) has no
    suffix and is its own domain. Case and a closing dot do not matter; labels in punycode
    match rules in punycode. Null and empty hosts are left out.

    Every host is split into its ends, which are joined to the rules by equality; a rule's
    end occurs once in a host, so no host meets more rules than it has labels.
    """
    own = hosts.select(F.regexp_replace(F.lower(column), r"\.+$", "").alias("host")).filter("host <> ''").distinct()
    labels = F.split("host", r"\.")
    address = F.col("host").rlike(_ADDRESS)
    each = (own.filter(~address).select("host", labels.alias("_labels"), F.posexplode(labels).alias("_at", "_label"))
            .select("host", "_labels", "_at", F.array_join(F.slice("_labels", F.col("_at") + 1, F.size("_labels")), ".").alias("_end")))
    text = F.lower(F.trim("rule"))
    told = rules.select(F.regexp_replace(text, r"^(!|\*\.)", "").alias("_end"), F.startswith(text, F.lit("!")).alias("_but"),
                        F.startswith(text, F.lit("*.")).alias("_any")).filter("_end <> ''").distinct()
    # first label of the suffix: an exception leaves one label out, a wildcard takes one in
    first = F.when(F.col("_but"), F.col("_at") + 1).when(F.col("_any"), F.col("_at") - 1).otherwise(F.col("_at"))
    met = lookup(each, told, ["_end"], ["host"], "inner").select("host", "_labels", "_but", first.alias("_first")).filter("_first >= 0")
    best = met.groupBy("host").agg(F.max_by("_first", F.struct("_but", -F.col("_first"))).alias("_first"))
    named = own.join(best, "host", "left")
    at = F.coalesce("_first", F.size(labels) - 1)
    end = lambda k: F.array_join(F.slice(labels, F.greatest(k, F.lit(0)) + 1, F.size(labels)), ".")
    return named.select("host", F.when(~address, end(at)).alias("suffix"),
                        F.when(address, F.col("host")).otherwise(end(at - 1)).alias("domain"))
