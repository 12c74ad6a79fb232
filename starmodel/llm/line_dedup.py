"""Line dedup: lines that many documents share are dropped everywhere.

Native: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmodel.llm.common import WHITE, ascii_lower, materialize, unpacked, whole_row


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(line: Column, min_chars: int) -> Column:
    """128 bits of the normalised line as text (which Spark keeps apart by
    hashing, as it does not structs), null for keys that are too short."""
    key = F.btrim(ascii_lower(line), F.lit(WHITE))
    return F.when(F.length(key) >= min_chars, F.md5(key))


def _kept_flags(drop: Column, n: Column) -> Column:
    """Of n lines, whether each stays, from the sorted positions (from 0) of
    those that go: for each of these, as many that stay as lie between."""
    before = F.concat(F.array(F.lit(-1)), F.slice(drop, 1, F.size(drop) - 1))
    parts = F.zip_with(drop, before, lambda d, b: F.concat(F.array_repeat(F.lit(True), d - b - 1), F.array(F.lit(False))))
    return F.concat(F.flatten(parts), F.array_repeat(F.lit(True), n - 1 - F.element_at(drop, -1)))


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Each row of `docs` (all its columns) with `_n_lines`, `_n_dropped` and
    `_kept`, the text without the lines whose key (stripped, A-Z lower-cased, at
    least `min_chars` code points) is in at least `min_docs` rows.

    Lines are hashed once; the hashes (no text) are written out, exploded and
    counted, each row counting a key once, with sums before the shuffle. Common
    keys are joined back to the rows' hashes, so that what returns to a row are
    positions to drop. A key in a third of the rows is a skewed join of 16-byte
    hashes, which adaptive execution splits. All work on a row is linear in its
    lines: positions become one flag a line, and lines and flags are gone
    through together.

    Null text: one empty line, and `_kept` is "". Rows with a null or repeated
    id are documents of their own: positions are joined by id and text, and
    rows with the same id and text drop the same positions. An empty table
    gives an empty result. Columns of `docs` with a result's name give way to it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = lambda: F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))
    hashed = materialize(
        docs.select(F.col(id_col).alias("_id"), mark().alias("_mark"), F.transform(_lines(F.col(text_col)), lambda x: _hash(x, min_chars)).alias("_keys")),
        "line-keys",
    )
    distinct = hashed.select(F.explode(F.array_distinct(F.array_compact("_keys"))).alias("_key"))
    # written, so that the join has a plain table on this side and splits a key that many rows have
    common = materialize(distinct.groupBy("_key").agg(F.count("*").alias("_docs")).where(F.col("_docs") >= min_docs).select("_key"), "common-lines")
    at = hashed.select("_id", "_mark", F.posexplode("_keys").alias("_pos", "_key")).where(F.col("_key").isNotNull())
    hit = at.join(common, "_key", "left_semi").groupBy("_id", "_mark").agg(F.array_sort(F.collect_set("_pos")).alias("_drop"))
    left = docs.select(whole_row(docs).alias("_doc"), F.col(id_col).alias("_id0"), mark().alias("_mark0"))
    joined = left.join(hit, F.col("_id0").eqNullSafe(F.col("_id")) & (F.col("_mark0") == F.col("_mark")), "left")
    body = F.coalesce(F.col("_doc").getField(text_col), F.lit(""))  # the text goes through the shuffle once
    lines = _lines(body)
    flagged = F.arrays_zip(lines.alias("line"), _kept_flags(F.col("_drop"), F.size(lines)).alias("stays"))
    kept = F.when(F.col("_drop").isNull(), body).otherwise(F.array_join(F.filter(flagged, lambda x: x["stays"])["line"], "\n"))
    out = joined.select("_doc", F.struct(F.size(lines).cast("long").alias("_n_lines"), F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long").alias("_n_dropped"), kept.alias("_kept")).alias("_out"))
    return out.select(*unpacked(docs, but=("_n_lines", "_n_dropped", "_kept")), "_out.*")
