"""Chain from event to company to product."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scale import hot_keys, lookup, marked, replicated, salted
from ..session import dropped, kept, shared_folder

# bytes of names sent to all tasks at most
NAMES = 64 << 20


def _cents(lineitem: DataFrame) -> Column:
    """Net amount in hundredths of a cent: whole numbers add up the same in any order."""
    price = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return price * (100 - F.round(F.col("l_discount") * 100).cast("bigint"))


def company_products(orders: DataFrame, lineitem: DataFrame, companies: DataFrame) -> DataFrame:
    """Exposure of the given companies to every product they ordered. Orders of other
    companies drop out before the lines are joined."""
    bought = lookup(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("company_id")),
                    companies, ["company_id"], ["l_orderkey"], "left_semi")
    lines = lineitem.select("l_orderkey", F.col("l_partkey").alias("product_id"),
                            _cents(lineitem).alias("_c"))
    return (lines.join(bought, "l_orderkey").groupBy("company_id", "product_id")
            .agg(F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("n_lines")))


def exposure_chain(event: DataFrame, orders: DataFrame, lineitem: DataFrame, part: DataFrame
                   ) -> DataFrame:
    """Paths event kind → company → product. Both ends are folded per company before
    they meet, so a company with many events and many orders adds its (kind, product)
    paths, not its events times its orders."""
    kinds = event.groupBy("company_id", "event_type").agg(F.count(F.lit(1)).alias("n_events"))
    firms = event.select("company_id").distinct()
    paths = lookup(company_products(orders, lineitem, firms), kinds, ["company_id"], ["product_id"], "inner")
    products = part.select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"))
    return paths.join(products, "product_id", "left").select(
        "event_type", "company_id", "product_id", "brand", "n_events", "n_lines",
        (F.col("_c") / 10000).alias("amount"))


def event_exposure(event: DataFrame, orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Every event with its company's whole exposure: products, lines, amount."""
    firms = event.select("company_id").distinct()
    total = company_products(orders, lineitem, firms).groupBy("company_id").agg(
        F.count(F.lit(1)).alias("n_products"), F.sum("n_lines").alias("n_lines"),
        F.sum("_c").alias("_c"))
    events = event.select("event_id", "company_id")
    return lookup(events, total, ["company_id"], ["event_id"]).select(
        "event_id", "company_id", F.coalesce("n_products", F.lit(0)).alias("n_products"),
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce(F.col("_c") / 10000, F.lit(0.0)).alias("amount"))


def _ordered(names: DataFrame) -> tuple[DataFrame, bool]:
    """``name, _no``: the distinct names, numbered without gaps in their order; and whether all
    tasks can hold them."""
    rows = (names.distinct().orderBy("name").withColumn("_part", F.spark_partition_id())
            .withColumn("_k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).checkpoint())
    told = {r["_part"]: r for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("name") + 24).alias("bytes")).collect()}
    before = [0, *accumulate(told[k]["n"] if k in told else 0 for k in range(max(told, default=0)))]
    return (rows.select("name", (F.element_at(F.array(*[F.lit(n).cast("bigint") for n in before]), F.col("_part") + 1) + F.col("_k")).alias("_no")),
            sum(r["bytes"] for r in told.values()) <= NAMES)


def _links_of(links: DataFrame, layer: DataFrame, held: bool) -> DataFrame:
    """``node, target``: the different links out of the nodes of a layer, by the nodes' numbers."""
    names = layer.select(F.col("name").alias("source"), F.col("_no").alias("node"))
    if held:
        return links.join(F.broadcast(names), "source").select("node", "target").distinct()
    own = marked(links.withColumn("_hash", F.xxhash64("source")), "_hash", names.select(F.xxhash64("source"))).select("source", "target")
    hot = hot_keys(own, ["source"])
    # repeated links meet where they meet their node: one shuffle for both
    own = salted(own, ["source"], hot, ["target"]).repartition("source", "_salt").distinct()
    return own.join(replicated(names, ["source"], hot).hint("shuffle_hash"), ["source", "_salt"]).select("node", "target")


def _told(rows: DataFrame, column: str, layer: DataFrame, held: bool, by: str = "_no", to: str = "name") -> DataFrame:
    """The rows with names instead of numbers in a column, or numbers instead of names."""
    names = layer.select(F.col(by).alias(column), F.col(to).alias("_to"))
    spread = [c for c in rows.columns if c != column]
    met = rows.join(F.broadcast(names), column) if held else lookup(rows, names.hint("shuffle_hash"), [column], spread, "inner")
    return met.drop(column).withColumnRenamed("_to", column)


def reach(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """Where chains of one to ``hops`` links lead from each start: ``start, node, hop,
    n_paths, via``, one row for each start, node and number of links, with the number of
    different chains and the smallest node before the last.

    ``edges``: ``source, target``, repeated ones count once; ``starts``: ``start``. Each round
    joins the rows of the last one to the links of the nodes they reached and folds chains that
    meet, so a node that many chains pass is one row per start and goes on as one. The rounds
    know nodes by their numbers in the order of names, those of each round by themselves: so the
    smallest node before the last is folded by hashing, and what is shuffled and kept for the
    next round, in compressed files of the shared folder, is narrow. Names come back with the
    result, which is not written. Links of frequent nodes are salted; only links of nodes that
    were reached are told apart. Loops are followed as far as ``hops`` allows; null ends link
    nothing.
    """
    spark = edges.sparkSession
    shared_folder(spark)
    links, *passed = kept(edges.filter("source is not null and target is not null").select("source", "target"), "links")
    first = layer = _ordered(starts.filter("start is not null").select(F.col("start").alias("name")))
    front = layer[0].select(F.col("_no").alias("start"), F.col("_no").alias("node"), F.lit(1).cast("bigint").alias("n_paths"))
    found = None
    for hop in range(1, hops + 1):
        near, path = kept(_links_of(links, *layer), "near")
        passed.append(path)
        after = _ordered(near.select(F.col("target").alias("name")))
        met = lookup(front, _told(near, "target", *after, by="name", to="_no"), ["node"], ["start"], "inner")
        front, _ = kept(met.groupBy("start", "target").agg(F.sum("n_paths").alias("n_paths"), F.min("node").alias("via"))
                        .withColumnRenamed("target", "node"), "front")
        named = front.withColumn("hop", F.lit(hop))
        for column, names in (("via", layer), ("node", after), ("start", first)):
            named = _told(named, column, *names)
        named = named.select("start", "node", "hop", "n_paths", "via")
        found = named if found is None else found.unionByName(named)
        front, layer = front.select("start", "node", "n_paths"), after
    for path in passed:
        dropped(spark, path)
    return found
