"""Changes that are dated inside versions which have already ended.

What a dimension knows of a key is a sequence of points in time, each with the
attributes from then on, or with none where the member was gone. A backdated change
is one more point: it cuts the version that it falls into, and its own version lasts
until the next point. Where it says what the following version says, that begins
earlier instead; where it says what was so already, nothing changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmodel.functions.clean import differs
from starmodel.operators import ordered
from starmodel.operators.scd import CURRENT, END, OPEN_END, START, UNKNOWN_KEY, DimensionSpec, assign_keys, stamp
from starmodel.sources.shared import keep, materialize

CREATED = "CreatedAt"


def _points(dim: DataFrame, spec: DimensionSpec) -> DataFrame:
    """Where versions begin, and where one ends without another to follow."""
    key = F.col(spec.business_key).alias("k")
    begin = dim.select(key, F.col(START).alias("t"), F.struct(*spec.attributes).alias("a"), F.col(spec.surrogate_key).alias("s"), F.col(CREATED).alias("created"))
    ends = dim.where(F.col(END) != stamp(OPEN_END)).select(key, F.col(END).alias("t"))
    ends = ends.join(begin.select("k", "t"), ["k", "t"], "left_anti")
    none = {"a": begin.schema["a"].dataType, "s": begin.schema["s"].dataType, "created": begin.schema["created"].dataType}
    return begin.unionByName(ends.select("k", "t", *[F.lit(None).cast(kind).alias(c) for c, kind in none.items()]))


def apply_backdated(dim: DataFrame, changes: DataFrame, spec: DimensionSpec, when: str, order: Sequence[str], operation: str | None = None) -> DataFrame:
    """The dimension after changes that hold from `when` on until the next change
    of their key that is known, whether that came before or after them.

    `changes` have the attributes of `spec`, `when`, `order` (which decides between
    changes of a key at the same time: the last counts, and counts for more than a
    version that begins then), and with `operation` a column of which "delete" ends
    the member from then on. Whether something changes is told by the hash. The
    same changes a second time change nothing. A change that changed nothing when it
    came is not in the dimension, so it does not come back when a later call cuts
    its version; changes that are to count whatever comes are applied again. Versions that stay keep their surrogate keys, also where they begin
    or end elsewhere now; of versions that become one the first key stays; new
    versions get new keys, by business key and start. Keys without a change, rows
    with a null key or time, and the unknown member are left as they are (changes
    without key or time are left out).

    Versions are not gathered by key: a key with a third of all changes is cut into
    range parts, as all rows are."""
    gone = (F.col(operation) == "delete") if operation else F.lit(False)
    given = changes.where(F.col(spec.business_key).isNotNull() & F.col(when).isNotNull())
    given = given.select(F.col(spec.business_key).alias("k"), F.col(when).cast("timestamp_ntz").alias("t"), F.struct(*order).alias("o"), F.when(~F.coalesce(gone, F.lit(False)), F.struct(*spec.attributes)).alias("a"))
    # one change for each key and time, found while rows are summed up
    latest = materialize(given.groupBy("k", "t").agg(F.max(F.struct("o", "a")).alias("x")).select("k", "t", "x.a"), "backdated")
    touched = latest.select(F.col("k").alias("_k")).distinct()
    mine = F.col(spec.business_key) == F.col("_k")
    versions = dim.where(F.col(spec.surrogate_key) != UNKNOWN_KEY)
    known = _points(versions.join(touched, mine, "left_semi"), spec).withColumnsRenamed({"k": "_kk", "t": "_tt", "a": "_old"})
    both = known.join(latest.withColumn("_new", F.lit(True)), (F.col("_kk") == F.col("k")) & (F.col("_tt") == F.col("t")), "full_outer")
    points = both.select(F.coalesce("k", "_kk").alias("k"), F.coalesce("t", "_tt").alias("t"), F.when(F.col("_new"), F.col("a")).otherwise(F.col("_old")).alias("a"), "s", "created").withColumn("h", F.col(f"a.{spec.hash}"))
    parts = ordered.with_neighbour(ordered.dealt(points, ["k"], ["t"]), ["k"], ["t"], ["h", F.col("a").isNull().alias("gone")], "before")
    here, before = F.col("a").isNull(), F.coalesce(F.col("before.gone"), F.lit(True))  # before the first there is none
    begins = (here != before) | (~here & ~before & differs(F.col("h"), F.col("before.h")))
    parts = materialize(parts.select("k", "t", "a", "s", "created", begins.alias("begins"), ordered.PART), "points")
    # points that change nothing belong to the one before that does; the first key among them is the version's
    marked = ordered.filled_forward(parts.withColumn("g", F.when(F.col("begins"), F.col("t"))), ["k"], ["t"], "g")
    keys = marked.where("s IS NOT NULL AND a IS NOT NULL").groupBy("k", "g").agg(F.min(F.struct("t", "s", "created")).alias("first")).select(F.col("k").alias("_k"), F.col("g").alias("_g"), "first.s", "first.created")
    ends = ordered.with_neighbour(parts.where("begins").select("k", "t", "a", ordered.PART), ["k"], ["t"], ["t"], "after", after=True)
    made = ends.where("a IS NOT NULL").join(keys, (F.col("k") == F.col("_k")) & (F.col("t") == F.col("_g")), "left")
    until = F.coalesce(F.col("after.t"), stamp(OPEN_END))
    made = made.select(F.col("s").alias(spec.surrogate_key), "a.*", F.col("t").alias(START), until.alias(END), F.col("after.t").isNull().alias(CURRENT), F.coalesce("created", "t").alias(CREATED))
    made = materialize(made.select(*spec.columns), "backdated")
    top = dim.agg(F.greatest(F.coalesce(F.max(spec.surrogate_key), F.lit(0)), F.lit(0))).first()[0]
    fresh = assign_keys(made.where(F.col(spec.surrogate_key).isNull()).drop(spec.surrogate_key), [spec.business_key, START], spec.surrogate_key, top + 1)
    rest = dim.join(touched, mine & (F.col(spec.surrogate_key) != UNKNOWN_KEY), "left_anti").select(*spec.columns)
    return keep(rest.unionByName(made.where(F.col(spec.surrogate_key).isNotNull())).unionByName(fresh.select(*spec.columns)), f"dim-{spec.name}")
