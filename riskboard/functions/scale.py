"""Building blocks that keep their shape when one key holds a third of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import shared_folder

# A key with this share of the rows counts as hot.
HOT_SHARE = 0.001
# Hashes that tasks hold as they are, and bits (a power of two as an exponent) that mark more.
PLAIN = 1 << 20
MARKS = 28


def latest_by(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The ``values`` of the row that is last by ``order`` for each key.

    An aggregate, not a window: every map task sends one row per key, so a hot key
    never gathers its rows in one place.
    """
    best = F.max_by(F.struct(*values), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rn") -> DataFrame:
    """First ``k`` rows per key. Spark limits each map task to ``k`` rows per key
    before the shuffle, so the last sort sees at most k rows per key and task."""
    spot = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(spot)).filter(F.col(rank) <= k)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most ``rows`` rows; the check itself reads no more."""
    return df.limit(rows + 1).count() <= rows


def slice_sorted(df: DataFrame, order: list[Column], skip: int, take: int,
                 head: int = 100_000) -> DataFrame:
    """Rows ``skip .. skip+take`` of the sorted table.

    Near the top Spark keeps ``skip+take`` rows per task and merges them. Further
    down that merge would grow with the page number, so the rows are range-sorted
    once, written, counted per range, and only the ranges the slice touches are read.
    """
    if skip + take <= head:
        return df.orderBy(*order).offset(skip).limit(take)
    shared_folder(df.sparkSession)
    ranged = (df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
              .checkpoint())
    sizes = ranged.groupBy("_part").count()
    # one row per range, so this ordered sum stays as small as the partition count
    before = F.coalesce(F.sum("count").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    touched = (sizes.withColumn("_before", before)
               .filter((F.col("_before") < skip + take) & (F.col("_before") + F.col("count") > skip))
               .select("_part", "_before"))
    inside = Window.partitionBy("_part").orderBy(*order)
    place = F.col("_before") + F.row_number().over(inside)
    return (ranged.join(touched, "_part").withColumn("_place", place)
            .filter((F.col("_place") > skip) & (F.col("_place") <= skip + take))
            .orderBy(*order).drop("_part", "_before", "_place"))


def hot_keys(df: DataFrame, keys: list[str]) -> dict[int, int]:
    """Hash → number of salts, for all keys that hold at least ``HOT_SHARE`` of the rows:
    one pass over the key columns, one row returned.

    A key gets two salts for each shuffle partition's worth of rows it holds, so that no
    salted part is larger than half an average partition, whatever the key's share. The
    numbers are fixed before the join is planned, so both sides salt alike.
    """
    most = int(1 / HOT_SHARE)
    told = df.select(F.xxhash64(*keys).alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {most}, {16 * most})").alias("top")).first()
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = {r["item"]: -(-2 * partitions * r["count"] // max(1, told["n"])) for r in told["top"] or []
             if r["count"] >= HOT_SHARE * told["n"]}
    return {h: n for h, n in salts.items() if n > 1}


def _n_salts(hot: dict[int, int], keys: list[str]) -> Column:
    pairs = [x for kv in hot.items() for x in (F.lit(kv[0]).cast("bigint"), F.lit(kv[1]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.xxhash64(*keys)), F.lit(1)) if hot else F.lit(1)


def salted(df: DataFrame, keys: list[str], hot: dict[int, int], spread: list[str]) -> DataFrame:
    """Rows of hot keys get one of the key's salts by their ``spread`` columns."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(*spread), _n_salts(hot, keys)).cast("int") if hot else F.lit(0))


def replicated(df: DataFrame, keys: list[str], hot: dict[int, int]) -> DataFrame:
    """Rows of hot keys once per salt, all others once."""
    return df.withColumn("_salt", F.explode(
        F.sequence(F.lit(0), (_n_salts(hot, keys) - 1).cast("int"))) if hot else F.lit(0))


def lookup(fact: DataFrame, dim: DataFrame, on: list[str], spread: list[str], how: str = "left"
           ) -> DataFrame:
    """Join many rows to a table of keys when some keys may be very frequent.

    A frequent key is cut into parts by its share. The key table is often an aggregate on
    the same key; then Spark would reuse that aggregate's partitioning and could not split
    the hot partition at run time. A key table that Spark knows to be small enough for a
    broadcast needs no salts and no pass over the rows, nor do rows that make up one
    partition at most. Key columns must have the same type on both sides.
    """
    spark = fact.sparkSession
    if (_bytes(dim) <= _limit(spark, "spark.sql.autoBroadcastJoinThreshold")
            or _bytes(fact) <= _limit(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes")):
        return fact.join(dim, on, how)
    hot = hot_keys(fact, on)
    return (salted(fact, on, hot, spread).join(replicated(dim, on, hot), [*on, "_salt"], how)
            .drop("_salt"))


def marked(rows: DataFrame, value: str, known: DataFrame) -> DataFrame:
    """The rows whose hash ``value`` may be among the hashes ``known`` (one column). Every task
    holds these, or if they are many, at most ``2 ** MARKS`` bits, of which the low bits of each
    known hash set one."""
    known = known.toDF(value)
    number = known.agg(F.approx_count_distinct(value)).first()[0]
    if number <= PLAIN:
        return rows.join(F.broadcast(known.distinct()), value, "left_semi")
    low = F.col(value).bitwiseAND(F.lit((1 << min(MARKS, (64 * number).bit_length())) - 1).cast("bigint"))
    words = known.select(F.shiftright(low, 6).alias("_word"), low.bitwiseAND(F.lit(63)).cast("int").alias("_bit")).groupBy(
        "_word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bit"))).alias("_v"))
    # 64 words of 64 bits a row
    marks = words.groupBy(F.shiftright("_word", 6).alias("_row")).agg(F.map_from_entries(F.collect_list(
        F.struct(F.col("_word").bitwiseAND(F.lit(63)).cast("int"), "_v"))).alias("_m")).select("_row", F.transform(
            F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0).cast("bigint"))).alias("_words"))
    word = F.get("_words", F.shiftright(low, 6).bitwiseAND(F.lit(63)).cast("int"))
    bit = F.call_function("shiftright", word, low.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
    return (rows.withColumn("_row", F.shiftright(low, 12)).join(F.broadcast(marks), "_row")
            .filter(bit == 1).select(*rows.columns))


def as_of(left: DataFrame, right: DataFrame, on: list[str], time: str, since: str, values: list[str],
          order: list[str] | None = None) -> DataFrame:
    """Each row of ``left`` with the ``values`` of the last row of ``right`` that has the
    same keys and whose ``since`` is not after the row's ``time``; nulls without one. Of
    several right rows of one key and time the last by ``order`` counts.

    Both sides are laid into one timeline per key, and each row takes the value before it.
    The timeline of a frequent key is cut into slices of about equal numbers of rows; what
    held at the end of a slice, one row each, is carried to the slices after it.
    """
    spark = left.sparkSession
    known = right.filter(" and ".join(f"`{c}` is not null" for c in [*on, since]))
    best = F.max_by(F.struct(*values), F.struct(*(order or values))).alias("_v")
    told = known.groupBy(*on, F.col(since).alias("_t")).agg(best)
    own = F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row")
    whole = F.lit(True)
    for c in [*on, time]:
        whole = whole & F.col(c).isNotNull()
    rows = left.filter(whole).select(*on, F.col(time).alias("_t"), own)
    both = (rows.withColumn("_v", F.lit(None).cast(told.schema["_v"].dataType))
            .unionByName(told.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType))))
    asked = F.col("_row").isNotNull()
    hot = hot_keys(both, on)
    place = F.lit(0)
    if hot:
        cuts = [k / max(hot.values()) for k in range(1, max(hot.values()))]
        busy = F.xxhash64(*on).isin(list(hot))
        kind = both.schema["_t"].dataType
        at = both.filter(busy).agg(F.percentile_approx("_t", cuts, 10_000).cast("array<string>").alias("p")).first()["p"] or []
        cut = F.array(*[F.lit(x).cast(kind) for x in at]).cast(f"array<{kind.simpleString()}>")
        place = F.when(busy, F.size(F.filter(cut, lambda x: x <= F.col("_t")))).otherwise(0)
    both = both.withColumn("_slice", place)
    # at equal times what holds comes before what asks
    line = Window.partitionBy(*on, "_slice").orderBy("_t", asked).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_v", F.last("_v", ignorenulls=True).over(line)).filter(asked)
    if hot:
        ends = both.filter(busy).groupBy(*on, "_slice").agg(F.max_by("_v", F.when(~asked, F.col("_t"))).alias("_end"))
        earlier = Window.partitionBy(*on).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
        seen = seen.join(carried, [*on, "_slice"], "left").withColumn("_v", F.coalesce("_v", "_before"))
    out = seen.select("_row", "_v").unionByName(
        left.filter(~whole).select(own, F.lit(None).cast(told.schema["_v"].dataType).alias("_v")))
    return out.select("_row.*", *[F.col(f"_v.`{c}`").alias(c) for c in values])


def _bytes(df: DataFrame) -> float:
    """Spark's own estimate of a table's size; without statistics it errs upwards."""
    try:
        return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    except ValueError:  # joins multiply estimates: a number too long to read is not small
        return float("inf")


def _limit(spark: SparkSession, key: str) -> int:
    """A size setting in bytes."""
    value = spark.conf.get(key).strip().lower().removesuffix("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    return int(value[:-1]) * units[value[-1]] if value[-1:] in units else int(value)


def widen(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a table of few input splits over the cores before heavy row work. A table
    with splits enough for half the cores passes untouched."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if 2 * df.rdd.getNumPartitions() > cores:
        return df
    return df.repartition(cores, *keys)


def components(edges: DataFrame, left: str, right: str, keep_single: bool = True) -> DataFrame:
    """Connected components of a two-sided graph: ``left, component`` with the
    smallest ``left`` value of the component as its name.

    A ``right`` value with one edge links nothing, so only shared ones enter the
    rounds; without ``keep_single`` the unlinked ``left`` values are left out. Each
    round passes the smallest label left to right and back, then lets a label look up
    its own label (path halving), so long chains shrink quickly, until no label moves.
    All steps are min-aggregates and joins on unique keys, with frequent ``right`` values
    and the labels of large components salted; every round is checkpointed.
    """
    shared_folder(edges.sparkSession)
    edges = edges.select(left, right).distinct().checkpoint()
    # all edges in one partition: nothing to split (some 32 bytes an edge)
    one = 32 * edges.count() <= _limit(edges.sparkSession, "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    hot = {} if one else hot_keys(edges, [right])
    shared = edges.groupBy(right).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(right)
    parts = (salted(edges, [right], hot, [left])
             .join(replicated(shared, [right], hot), [right, "_salt"]).checkpoint())
    label = parts.groupBy(left).agg(F.min(left).alias("component")).checkpoint()
    moved = True
    while moved:
        carried = parts.join(label, left).groupBy(right).agg(F.min("component").alias("component"))
        back = (parts.join(replicated(carried, [right], hot), [right, "_salt"])
                .groupBy(left).agg(F.min("component").alias("_seen")))
        jump = label.select(F.col(left).alias("component"), F.col("component").alias("_far"))
        seen = label.join(back, left)
        nxt = ((seen.join(jump, "component", "left") if one else lookup(seen, jump, ["component"], [left]))
               .select(left, F.least("component", "_seen", "_far").alias("_new"), "component"))
        nxt = nxt.checkpoint()
        moved = not nxt.filter(F.col("_new") < F.col("component")).isEmpty()
        label = nxt.select(left, F.col("_new").alias("component"))
    if not keep_single:
        return label
    return edges.select(left).distinct().join(label, left, "left").withColumn(
        "component", F.coalesce("component", left))
