"""Relational operators that Spark SQL lacks, as functions over DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaspan.operators.meta import cut


def qualify(df: DataFrame, window: dict[str, Column], condition: str, keep: bool = False) -> DataFrame:
    """QUALIFY: filter on window results, which are dropped again unless keep is set."""
    out = df.withColumns(window).filter(condition)
    return out if keep else out.drop(*window)


def star_replace(df: DataFrame, **new: Column) -> DataFrame:
    """`* REPLACE (expr AS col)`: same place, new expression; an unknown column is an error."""
    if missing := set(new) - set(df.columns):
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def star_rename(df: DataFrame, **names: str) -> DataFrame:
    """`* RENAME (a AS b)`."""
    return df.withColumnsRenamed(names)


def star_ilike(df: DataFrame, pattern: str) -> DataFrame:
    """`* ILIKE 'pattern'`: the columns whose names match, in order; % any run, _ one character, no escape."""
    like = re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern), re.I | re.S)
    return df.select(*[c for c in df.columns if like.fullmatch(c)])


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: Sequence[str], take: Sequence[str], inclusive: bool = True, how: str = "left") -> DataFrame:
    """As-of join: each left row with the latest right row of its `by` group at or before it (before it, if not inclusive).

    Both sides are merged and ordered once per group, and the last right row is carried forward; the cost is one shuffle
    whatever the number of matches. Groups are as large as the data has them: add a coarse time bucket to `by` and
    overlap it where one group holds a large part of the rows.
    """
    kept = [c for c in left.columns]
    packed = F.struct(*[F.col(c) for c in take])
    rank = F.lit(0 if inclusive else 1)
    r = right.select(*by, F.col(right_on).alias("_at"), rank.alias("_side"), packed.alias("_right"))
    lefts = left.select(*by, F.col(left_on).alias("_at"), F.lit(1 - (0 if inclusive else 1)).alias("_side"), F.struct(*kept).alias("_left"))
    w = Window.partitionBy(*by).orderBy(F.col("_at").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = lefts.unionByName(r, allowMissingColumns=True).withColumn("_hit", F.last("_right", ignorenulls=True).over(w))
    out = merged.filter("_left is not null").select("_left.*", *[F.col(f"_hit.{c}").alias(c if c not in kept else f"right_{c}") for c in take])
    return out if how == "left" else out.filter(F.col(take[0] if take[0] not in kept else f"right_{take[0]}").isNotNull())


def positional_join(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """POSITIONAL JOIN: rows paired by their number in a given order; the longer side's rest meets nulls.

    Rows are numbered by ranges: counts of sorted partitions are summed ahead, so no task holds a whole side.
    """
    a, b = numbered(left, left_order), numbered(right, right_order)
    clash = set(left.columns) & set(right.columns)
    b = b.withColumnsRenamed({c: f"right_{c}" for c in clash})
    return a.join(b, "_row", "full").drop("_row")


def numbered(df: DataFrame, order: Sequence[str], name: str = "_row") -> DataFrame:
    """A global row number from 0 in the given (unique) order without a one-task window.

    The ranged and sorted rows are written once, each with its place (partition, row in it); both the counts and the
    numbers come from that table, since a second run of the same range partitioning may cut the rows elsewhere.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(spread.withColumn("_at", F.monotonically_increasing_id()))  # partition << 33 | row
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row per partition
    ahead = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_ahead"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(ahead), part == F.col("_part")).withColumn(name, F.col("_ahead") + inside).drop("_part", "_at", "_ahead")


def union_by_name(*frames: DataFrame) -> DataFrame:
    """UNION ALL BY NAME: the left's columns, then the right's further ones; missing ones are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def top_with_ties(df: DataFrame, n: int, *order: str) -> DataFrame:
    """TOP n WITH TIES by columns (`-name` descends; nulls last). A distributed top-k finds the n-th row's keys; what ties
    with it is then read by an equality filter, so ties of any number stay and no task orders the whole input."""
    names = [o.lstrip("-") for o in order]
    keys = [F.col(c).desc_nulls_last() if o.startswith("-") else F.col(c).asc_nulls_last() for o, c in zip(order, names)]
    top = df.orderBy(*keys).limit(n)
    last = top.select(*names).tail(1)
    if not last:
        return df.limit(0)
    tied = F.lit(True)
    for c in names:
        tied = tied & F.col(c).eqNullSafe(F.lit(last[0][c]))
    return top.filter(~tied).unionByName(df.filter(tied))


def top_percent(df: DataFrame, percent: float, *order: str) -> DataFrame:
    """TOP n PERCENT: the first ceil(n / 100 * rows) rows in a unique order."""
    rows = numbered(df, order)
    total = df.agg(F.count("*").alias("_all"))
    return rows.join(F.broadcast(total)).filter(F.col("_row") < F.ceil(F.col("_all") * percent / 100)).drop("_row", "_all")


def slice_list(array: Column, low: int | None = None, high: int | None = None, step: int = 1) -> Column:
    """`l[low:high:step]` with 1-based, inclusive bounds; a step takes every step-th element."""
    size = F.size(array)
    lo = F.lit(1 if low is None else low)
    hi = size if high is None else F.least(F.lit(high), size)
    part = F.when(hi >= lo, F.slice(array, lo, hi - lo + 1)).otherwise(F.slice(array, 1, 0))
    return part if step == 1 else F.filter(part, lambda _, i: i % step == 0)


def assert_rows(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """`|> ASSERT`: rows pass; one that fails the condition (or leaves it null) ends the query."""
    return df.filter(F.when(F.coalesce(condition, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def fork(df: DataFrame, **branches: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """`|> FORK` and `|> TEE`: several continuations of one input."""
    return {k: f(df) for k, f in branches.items()}


def pipe_if(df: DataFrame, condition: bool, then: Callable[[DataFrame], DataFrame], otherwise: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """`|> IF`: the branch is chosen when the plan is made."""
    return then(df) if condition else otherwise(df)


def static_describe(df: DataFrame) -> DataFrame:
    """`|> STATIC DESCRIBE`: one row per column."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, name string, type string, nullable boolean")


def recursive_union(start: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int = 100) -> DataFrame:
    """UNION ALL of start and its repeated steps until a step gives nothing; more than `limit` steps are an error. Each
    step is checkpointed, so lineage stays short."""
    found, wave = start, start
    for _ in range(limit):
        wave = cut(step(wave))
        if wave.isEmpty():
            return found
        found = found.unionByName(wave)
    raise RuntimeError(f"recursion did not end within {limit} steps")


def connect_by(nodes: DataFrame, key: str, parent: str, root: str, limit: int = 100) -> DataFrame:
    """`START WITH root CONNECT BY PRIOR key = parent`: nodes below the roots with LEVEL from 1; a cycle is an error."""
    start = nodes.filter(root).withColumn("level", F.lit(1))

    def step(wave: DataFrame) -> DataFrame:
        up = wave.select(F.col(key).alias("_up"), (F.col("level") + 1).alias("level"))
        return nodes.join(up, nodes[parent] == up["_up"]).drop("_up")

    return recursive_union(start, step, limit)


def match_recognize(df: DataFrame, partition: Sequence[str], order: Sequence[str], define: dict[str, Column], pattern: str) -> DataFrame:
    """MATCH_RECOGNIZE, one row per match, skipping past it: `pattern` is a regular expression over the symbols.

    define: symbol (one letter) -> condition, which may use lag and lead columns; the first that holds names the row, a
    row without one is `_`. Output: the partition columns, match_number, first_<order>, last_<order>, match_rows.
    The symbols of a partition become one string; its size in rows bounds a task's memory (one byte and the order key).
    """
    symbol = F.coalesce(*[F.when(c, F.lit(s)) for s, c in define.items()], F.lit("_"))
    key = order[0]
    lines = df.withColumn("_s", symbol).groupBy(*partition).agg(F.sort_array(F.collect_list(F.struct(*[F.col(o) for o in order], F.col("_s")))).alias("_rows"))
    word = F.array_join(F.transform("_rows", lambda r: r["_s"]), "")
    # matches become spans: each match is marked, and lengths run ahead
    parts = F.regexp_extract_all(F.col("_word"), F.lit(f"(?s)({pattern})|."), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,size:int>>").alias("hits"))

    def put(acc: Column, part: Column) -> Column:
        hit = F.array(F.struct(acc["at"].alias("at"), F.length(part).alias("size")))
        return F.struct((acc["at"] + F.length(part)).alias("at"), F.when(part.rlike(f"^(?:{pattern})$"), F.concat(acc["hits"], hit)).otherwise(acc["hits"]).alias("hits"))

    hits = F.aggregate(parts, zero, put, lambda a: a["hits"])
    out = lines.withColumn("_word", word).withColumn("_hits", hits).select(*partition, "_rows", F.posexplode("_hits").alias("_n", "_hit"))
    first, last = F.element_at("_rows", F.col("_hit.at") + 1), F.element_at("_rows", F.col("_hit.at") + F.col("_hit.size"))
    return out.select(*partition, (F.col("_n") + 1).alias("match_number"), first[key].alias(f"first_{key}"), last[key].alias(f"last_{key}"), F.col("_hit.size").alias("match_rows"))


def change_event(value: Column, window) -> Column:
    """CONDITIONAL_CHANGE_EVENT: from 0, one more at every change of value; a null is no change."""
    before = F.lag(value).over(window)
    return F.sum(F.when(value != before, 1).otherwise(0)).over(window)


def true_event(condition: Column, window) -> Column:
    """CONDITIONAL_TRUE_EVENT: running number of rows where the condition holds."""
    return F.sum(F.when(condition, 1).otherwise(0)).over(window)


def count_min_estimate(sketch: Column, item: Column) -> Column:
    """The count of a whole number in a sketch that count_min_sketch made: never too low, too high by the sketch's error.

    The sketch's bytes are its version, total, depth and width, then a multiplier per row, then the rows (big-endian).
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("long")
    def estimate(sketches, items):
        import numpy as np
        import pandas as pd

        out, held = [], {}
        for raw, x in zip(sketches, items):
            if raw is None or x is None or x != x:
                out.append(None)
                continue
            if raw not in held:
                depth, width = np.frombuffer(raw, ">i4", 2, 12)
                held = {raw: (np.frombuffer(raw, ">i8", depth, 20).astype(np.int64), np.frombuffer(raw, ">i8", depth * width, 20 + 8 * depth).reshape(depth, width))}
            factors, table = held[raw]
            h = factors * np.int64(x)
            h = (h + (h >> 32)) & ((1 << 31) - 1)
            out.append(int(table[np.arange(len(h)), h % table.shape[1]].min()))
        return pd.Series(out, dtype="Int64")

    return estimate(sketch, item.cast("long"))
