"""A fingerprint of some of a row's values, to tell whether any has changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmodel.functions.clean import as_text

#: How the layout names fields and writes null.
BAR, NULL = "|", "<NULL>"


def hash_text(df: DataFrame, fields: Sequence[str], layout: str = "named", lead: bool = False) -> Column:
    """The text that is hashed: `Name=value` of each field with a bar between
    (and before, with `lead`). Layout "safe" escapes bars and backslashes in
    values, and tells null from the text that stands for it; in layout "named"
    values that hold a bar can collide."""
    if layout not in ("named", "safe"):
        raise ValueError(f"unknown layout {layout}")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts: list[Column] = []
    for i, name in enumerate(fields):
        value = as_text(F.col(name), kinds[name])
        if layout == "safe":
            value = F.regexp_replace(value, r"([\\|<])", r"\\$1")
        parts += [F.lit(("" if i == 0 and not lead else BAR) + name + "="), F.coalesce(value, F.lit(NULL))]
    return F.concat_ws("", *parts)


def row_hash(df: DataFrame, fields: Sequence[str], layout: str = "named", charset: str = "UTF-8", lead: bool = False) -> Column:
    """SHA-256 in lower-case hex; `charset` UTF-16LE gives what a database with
    two-byte characters would hash."""
    text = hash_text(df, fields, layout, lead)
    return F.sha2(text.cast(T.BinaryType()) if charset == "UTF-8" else F.encode(text, charset), 256)
