"""Keep-first, top-N, keyset pages, gates, shares and keyed merges: each takes and returns DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .lineage import written


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def keep_least(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is least in the named columns (nulls first), then in all others: a minimum that is combined before the shuffle."""
    rest = [*order, *[c for c in df.columns if c not in (*keys, *order)]]
    one = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_x"))
    return one.select(*[F.col(c) if c in keys else F.col(f"_x.{c}").alias(c) for c in df.columns])


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key, numbered from 1; Spark's group limit prunes before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def dealt_join(left: DataFrame, right: DataFrame, on: list[str], most: int = 2000) -> DataFrame:
    """An inner join on keys of which few have very many rows: pairs are made by as many tasks as there are, whatever the keys.

    The rows of a key on the right are dealt over shares of some `most` rows, and those on the left go to each share, so copies
    are one in `most` of the pairs. Nothing is broadcast, and the number of partitions is held, since the input says little about the pairs.
    """
    shares = right.groupBy(*on).agg(F.ceil(F.count("*") / most).alias("_shares"))
    dealt = right.join(shares, on).withColumn("_share", F.pmod(F.xxhash64(*right.columns), F.col("_shares"))).drop("_shares")
    copied = left.join(shares, on).withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1))).drop("_shares")
    n, keys = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*on, "_share"]
    return copied.repartition(n, *keys).join(dealt.repartition(n, *keys).hint("merge"), keys).drop("_share")


def dealt(df: DataFrame, *keys: str, most: int = 1 << 19) -> DataFrame:
    """A table dealt by the keys over so many partitions that each has some `most` rows; one of no more rows is left to Spark.

    Adaptive execution joins partitions by their compressed bytes, which say little about the memory that their rows take; a
    number named here stays, and a join on the keys follows it. The rows are counted first: df is a stored table or few columns of one.
    """
    rows = df.count()
    if rows <= most:
        return df
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // most)), *keys)


def shares(df: DataFrame, most: int = 1 << 19) -> int:
    """The number of partitions that `dealt` gives a table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // most))


def listed_pairs(left: DataFrame, right: DataFrame, on: str, key: str, value: str, most: int = 1000, pairs: int = 1 << 21) -> DataFrame:
    """left.join(right, on) without `on`, left(on, key, ...), right(on, value): all pairs of a left `key` come out of one partition, ungrouped.

    Values of a key of the right travel as sorted lists of some `most`, which compress well, and are unfolded after the shuffle,
    so that grouping by `key` and the value shuffles no pair. A partition has some `pairs` pairs. Both sides are read several times.
    """
    n = right.groupBy(on).agg(F.count("*").alias("_n"))
    total = left.groupBy(on).agg(F.count("*").alias("_k")).join(n, on).agg(F.sum(F.col("_n") * F.col("_k"))).first()[0] or 0
    lists = right.join(n, on).groupBy(on, F.pmod(F.xxhash64(value), F.ceil(F.col("_n") / most)).alias("_part")).agg(F.sort_array(F.collect_list(value)).alias("_list"))
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // pairs))
    met = left.join(lists, on).drop(on, "_part").repartition(parts, key)
    return met.select(*[c for c in met.columns if c != "_list"], F.explode("_list").alias(value))


def keyset_page(df: DataFrame, rank: str, key: str, after: tuple | None, size: int) -> DataFrame:
    """The page after (rank, key), highest first."""
    if after is not None:
        df = df.filter((F.col(rank) < after[0]) | ((F.col(rank) == after[0]) & (F.col(key) < after[1])))
    return df.orderBy(F.col(rank).desc_nulls_last(), F.col(key).desc()).limit(size)


def gate_fail_open(df: DataFrame, quality: DataFrame, key: str, bad: Column) -> DataFrame:
    """Rows without a verdict pass; rows with a bad one do not."""
    return df.join(quality.filter(bad).select(key), key, "left_anti")


def gate_fail_closed(df: DataFrame, quality: DataFrame, key: str, good: Column) -> DataFrame:
    """Only rows with a good verdict pass."""
    return df.join(quality.filter(good).select(key), key, "left_semi")


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], recency: str) -> DataFrame:
    """The most recent row of each key; the new one wins a tie."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in both.columns if c not in keys]
    # the largest (known, recency, new) of a key, combined before the shuffle
    best = F.max_by(F.struct(*rest), F.struct(F.col(recency).isNotNull(), F.col(recency), F.col("_new"))).alias("x")
    return both.groupBy(*keys).agg(best).select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest if c != "_new"])


def upsert_keep_if_null(old: DataFrame, new: DataFrame, keys: list[str], first_wins: bool) -> DataFrame:
    """Per column, the existing value (first wins) or the incoming one (last wins), the other where that is null."""
    values = [c for c in old.columns if c not in keys]
    a, b = old.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in values]), new.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in values])
    order = ("_a_", "_b_") if first_wins else ("_b_", "_a_")
    return a.join(b, keys, "full_outer").select(*keys, *[F.coalesce(order[0] + c, order[1] + c).alias(c) for c in values])


def counter_merge(tables: list[DataFrame], keys: list[str], counts: list[str]) -> DataFrame:
    """Counters of the same key add up."""
    return reduce(DataFrame.unionByName, tables).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])


def share_of_total(df: DataFrame, keys: list[str], value: str, total_keys: list[str], name: str, digits: int = 4) -> DataFrame:
    """Grouped sums with their share of the sum over total_keys."""
    g = df.groupBy(*keys).agg(F.sum(value).alias(value))
    share = F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*total_keys)))
    return g.withColumn(name, F.round(F.coalesce(share, F.lit(0.0)), digits))  # a total of zero has shares of zero


def any_ilike(text: Column, patterns: Column) -> Column:
    """The text matches one of an array's patterns, whatever its case."""
    return F.coalesce(F.exists(patterns, lambda p: F.ilike(text, p)), F.lit(False))


def write_back(df: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Values of the updates (one row a key) where they have one, else the old ones."""
    values = [c for c in updates.columns if c not in keys]
    new = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values])
    kept = [F.coalesce(f"_new_{c}", c).alias(c) if c in values else F.col(c) for c in df.columns]
    return df.join(new, keys, "left").select(*kept)


def named(rows: DataFrame, kinds: dict[str, DataFrame], kind: str, id_: str, name: str = "name") -> DataFrame:
    """A polymorphic reference resolved by one join: kinds maps a type to its DataFrame(id, name)."""
    table = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias(kind), F.col("id").alias(id_), F.col("name").alias(name)) for k, df in kinds.items()])
    return rows.join(table, [kind, id_], "left")


def modal(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key that is not null, the least one on a tie."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), value)).alias("_x")).select(*keys, F.col(f"_x.{value}").alias(value))


def guarded_upsert(old: DataFrame, new: DataFrame, keys: list[str], guard: Column) -> DataFrame:
    """Old rows where the guard does not hold stay whatever comes; the others are replaced, new keys are added."""
    held = old.filter(~F.coalesce(guard, F.lit(False)))
    free = new.join(held.select(*keys), keys, "left_anti")
    rest = old.filter(F.coalesce(guard, F.lit(False))).join(new.select(*keys), keys, "left_anti")
    return held.unionByName(free).unionByName(rest)


def page(df: DataFrame, order: list[Column], size: int, offset: int = 0) -> DataFrame:
    """One page with has_more, found by reading one row more than its size."""
    probe = df.orderBy(*order).offset(offset).limit(size + 1)
    w = Window.orderBy(*order)  # size + 1 rows at most
    marked = probe.withColumn("_rn", F.row_number().over(w)).withColumn("has_more", F.max("_rn").over(Window.partitionBy()) > size)
    return marked.filter(F.col("_rn") <= size).drop("_rn")


def sample_per_bucket(df: DataFrame, bucket: str, key: str, size: int, seed: int = 0) -> DataFrame:
    """`size` rows of each bucket in an order that a hash of the key and the seed draws: the same at every run."""
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return top_n(df.withColumn("_draw", drawn), [bucket], [F.asc("_draw"), F.asc(key)], size, "_rn").drop("_rn", "_draw")


def merge_order(edges: DataFrame) -> DataFrame:
    """edges(merge_id, keep_id, weight) -> merge_id, keep_id, final_id, level: one keep a merge (the heaviest, then the least id).

    level is the number of steps to final_id, which is merged into nothing: applied from the highest level down, no merge
    takes a row that a later one still needs. Each round doubles the steps that are followed, so the rounds grow with the
    logarithm of the rows. Rows that are left then lead into a cycle, which is an error that names its members.
    """
    best = F.min(F.struct((-F.col("weight")).alias("w"), "keep_id")).alias("x")
    one = edges.filter("merge_id <> keep_id").groupBy("merge_id").agg(best).select("merge_id", F.col("x.keep_id").alias("keep_id"))
    at = written(one.select("merge_id", "keep_id", F.col("keep_id").alias("final_id"), F.lit(1).cast("long").alias("level"), F.lit(True).alias("on")), "merges")
    for _ in range(at.count().bit_length() + 1):
        after = at.select(F.col("merge_id").alias("final_id"), F.col("final_id").alias("next"), F.col("level").alias("more"))
        on = F.col("next").isNotNull()
        step = at.join(after, "final_id", "left").select("merge_id", "keep_id", F.coalesce("next", "final_id").alias("final_id"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"), on.alias("on"))
        at = written(step, "merges")
        if at.filter("on").isEmpty():
            return at.drop("on")
    # by now every pointer that goes on lies on a cycle
    members = [r["final_id"] for r in at.filter("on").select("final_id").distinct().orderBy("final_id").limit(20).collect()]
    raise ValueError(f"the merge edges hold a cycle through {', '.join(map(str, members))}")


def merge_targets(edges: DataFrame) -> DataFrame:
    """merge_order's merge_id and final_id."""
    return merge_order(edges).select("merge_id", "final_id")
