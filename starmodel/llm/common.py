"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmodel.sources.shared import discard, materialize, shared_dir  # noqa: F401

#: The white space and the letters that the contracts name.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: For bytes of UTF-8 text in Python tasks.
LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())


def words(text: str | None) -> list[bytes]:
    """The lower-cased (A-Z only) words of a text as UTF-8; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split()


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else left; pure ASCII takes the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that none can clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def unpacked(docs: DataFrame, row: str = "_doc", but: Sequence[str] = ()) -> list[Column]:
    """The columns of `docs` out of its struct, without those named in `but`."""
    return [F.col(row).getField(c).alias(c) for c in docs.columns if c not in but]


#: Bits that `sift` sends to all tasks at most: 2^20 rows of 64 bits, 8 MB whatever the input.
SIFT = 1 << 26


def sift(df: DataFrame, column: str, used: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of `df` whose `column` may be in that of `used`: all that are, and
    few others, which a join has to leave out yet. With `left_anti` the rest of the
    rows, none of which is. Only a bit for the hash of each used value is
    broadcast, so rows that are large, or many, need not be shuffled to find a few."""
    at = lambda c: F.xxhash64(c).bitwiseAND(F.lit(SIFT - 1))
    word, bit = F.shiftright("_at", 6), F.expr("shiftleft(1L, cast(_at & 63 as int))")
    there = used.select(at(column).alias("_at")).groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    hit = (word == F.col("_word")) & (F.col("_bits").bitwiseAND(bit) != 0)
    return df.withColumn("_at", at(column)).join(F.broadcast(there), hit, how).drop("_at")


#: Rows of numbers and digests that are broadcast at most; more are joined by a shuffle.
SMALL = 500_000


def small(df: DataFrame) -> DataFrame:
    """`df`, which is cheap to read, to be broadcast if it has at most SMALL rows."""
    return F.broadcast(df) if df.count() <= SMALL else df


def hash_sample(df: DataFrame, column: str, most: int) -> DataFrame:
    """At most `most` rows: those whose `column` has the smallest hashes. Rows
    that cannot be among them are left out before the few others are sorted."""
    n = df.count()
    if n <= most:
        return df
    h = F.xxhash64(column).bitwiseAND(F.lit((1 << 63) - 1))
    likely = df.where(h <= F.lit(int(((1 << 63) - 1) * min(1.0, 1.2 * most / n + 1e-4))))
    return likely.orderBy(h, column).limit(most)


def numbered(df: DataFrame, order: Sequence[str], weight: str | None = None, start: str = "start", within: str | None = None) -> DataFrame:
    """Adds `start`: the sum of `weight` (1 each if None) over the rows before
    this one in the order of `order` (unique together), from 0 in each value of
    `within`. Rows are dealt by range, each task counts on within its own rows,
    and only one total per task and group is summed up again (these are the
    totals that are broadcast: at most tasks + groups rows), so neither all rows
    nor a whole group meet in one task. Pass a table that is cheap to read, as
    dealing by range reads it twice."""
    keys = [*([within] if within else []), *order]
    given = df.withColumn("_w", F.lit(1).cast("long") if weight is None else F.col(weight).cast("long"))
    given = given.withColumn("_g", F.col(within) if within else F.lit(0))
    dealt = given.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*dealt.schema.fields, T.StructField("_inside", T.LongType())])

    def count_on(batches):
        last, carried = None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            w, g = pdf["_w"], pdf["_g"]
            run = g.ne(g.shift()) & ~(g.isna() & g.shift().isna())
            run.iloc[0] = False
            part = run.cumsum()
            inside = w.groupby(part).cumsum() - w
            first = g.iloc[0]
            if last is not None and (first == last or (pd.isna(first) and pd.isna(last))):
                inside = inside.where(part != 0, inside + carried)
            pdf["_inside"] = inside.astype("int64")
            last, carried = g.iloc[-1], int(inside.iloc[-1] + w.iloc[-1])
            yield pdf

    out = materialize(dealt.mapInPandas(count_on, schema), "numbered")
    totals = out.groupBy("_part", "_g").agg(F.max(F.col("_inside") + F.col("_w")).alias("_total"))
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("_part").alias("_bp"), F.col("_g").alias("_bg"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    out = out.join(F.broadcast(totals), (F.col("_part") == F.col("_bp")) & F.col("_g").eqNullSafe(F.col("_bg")), "left")
    return out.withColumn(start, (F.col("_before") + F.col("_inside")).cast("long")).drop("_w", "_g", "_part", "_inside", "_before", "_bp", "_bg")
