"""Small tables with the cases that every operator must handle."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string, size string, shard string, _drop string, _score string, `a.b` string"

BASE = "The quick brown fox jumps over the lazy dog near the old stone bridge at dawn while birds sing in tall green trees and water runs"

TEXTS = [
    BASE,
    BASE,
    BASE.upper(),
    BASE.replace("birds", "larks"),
    "  " + BASE.replace(" ", "  ") + "\n",
    None,
    "",
    " \n\t ",
    "one",
    "two words",
    "line a\nline b\nline a\n",
    "\n\n\n",
    "é ñ ü 漢字 ΣΑΣ İ <|endoftext|> it's 'll 12.5\r\n\x0b\x0c end\x1c!",
    ("word%d another " * 3000) % tuple(range(3000)),
    "x" * 5000,
    "shared line here\n" + BASE[:40],
]


def rows(texts=None):
    texts = TEXTS if texts is None else texts
    out = [(i, t, "en", f"s{i % 2}", len(t or ""), "a", "b", "c", "d", "e", "f") for i, t in enumerate(texts)]
    if texts is TEXTS:
        out += [(None, BASE, "en", None, None, None, None, None, None, None, None), out[0], (None, None, None, None, None, None, None, None, None, None, None)]
        out += [(100 + i, f"shared line here\nown {i}", "en", "s", 1, "a", "b", "c", "d", "e", "f") for i in range(12)]
    return out


def table(spark, texts=None, partitions=3):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(partitions)
