"""Files of token ids: written in id order by Spark, read back as rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmodel.llm.common import numbered
from starmodel.llm.range_coder import pack_group, unpack_group
from starmodel.llm.tokens import byte_encoder, default_path

#: Ids after which a group is closed; one document more may be in it.
GROUP = 7_500_000
#: Rows that are encoded, or go back to Spark, at once.
ROWS = 4096
#: The index of groups is broadcast up to this many rows (16 MB), joined beyond.
SMALL = 500_000

SCHEMA = "part int, seq int, n_docs long, n_ids long, data binary"


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, group: int = GROUP) -> None:
    """Encodes every row's whole text, appends `end_id`, and writes the ids in
    ascending order of `id_col` (nulls first; rows with the same id by text) to
    `path`: rows of Parquet files, each with one group of the coder's format,
    ordered by `part` and `seq`. Null texts are empty.

    Rows are dealt by range and sorted within their part, so files are written
    side by side, by tasks that Spark commits and may run again. A task holds one
    group of about `group` ids at a time.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(vocabulary or default_path("byte_bpe_50k.json"))
        part, seq, ids, docs, held = TaskContext.get().partitionId(), 0, [], [], 0

        def closed() -> pa.RecordBatch:
            lengths = np.array([len(i) // 4 for i in ids], np.int64)
            data = pack_group(np.array(docs, np.int64), lengths, np.frombuffer(b"".join(ids), "<u4"))
            values = ([part], [seq], [len(docs)], [int(lengths.sum())], [data])
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["part", "seq", "n_docs", "n_ids", "data"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                for doc, coded in zip(some.column(0).to_pylist(), encoder.encode_all(some.column(1).to_pylist())):
                    ids.append(coded + end)
                    docs.append(NULL_ID if doc is None else doc)
                    held += len(ids[-1]) // 4
                    if held >= group:
                        yield closed()
                        seq, ids, docs, held = seq + 1, [], [], 0
        if docs:
            yield closed()

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the beginning of the text parts rows without an id, or with the same one
    given.repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA).write.parquet(path)


#: Stands for a null id in the files.
NULL_ID = -(1 << 63)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files of `write_ids`: `doc_id`, `start` (the ids of
    all documents before it), `n_tokens`, `ids` (binary, little-endian unsigned
    32-bit integers). Each group is decoded by itself and checked against its
    sums; damage raises ValueError. Only the groups' sizes are summed up to find
    where each begins."""
    files = spark.read.schema(SCHEMA).parquet(path)
    index = numbered(files.select("part", "seq", "n_ids"), ["part", "seq"], "n_ids", "_base").select(F.col("part").alias("_p"), F.col("seq").alias("_s"), "_base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                docs, lengths, ids = unpack_group(data.as_buffer().to_pybytes())
                ends = np.cumsum(lengths.astype(np.int64))
                for at in range(0, len(docs), ROWS):
                    n = len(docs[at : at + ROWS])
                    begin = int(ends[at] - lengths[at])
                    values = ids[begin : int(ends[at + n - 1])].astype("<u4")
                    starts = ends[at : at + n] - lengths[at : at + n]
                    offsets = np.append(starts - begin, len(values)).astype(np.int32) * 4
                    column = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])
                    some = docs[at : at + n]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(some, pa.int64(), mask=some == NULL_ID), pa.array(starts), pa.array(lengths[at : at + n].astype(np.int64)), column],
                        ["part", "seq", "doc_id", "local", "n_tokens", "ids"],
                    )

    rows = files.select("part", "seq", "data").mapInArrow(run, "part int, seq int, doc_id long, local long, n_tokens long, ids binary")
    groups = index.count()
    index = F.broadcast(index) if groups <= SMALL else index
    out = rows.join(index, (F.col("part") == F.col("_p")) & (F.col("seq") == F.col("_s")))
    return out.select("doc_id", (F.col("_base") + F.col("local")).cast(T.LongType()).alias("start"), "n_tokens", "ids")
