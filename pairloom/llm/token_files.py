"""Token ids as flat binary files with 64-bit document offsets.

Documents are range-partitioned by doc_id, into parts of about PART_BYTES of
text. Each partition writes one set of
files into a shared folder: `.ids` (little-endian unsigned ids, of 16 bits if every id of
the vocabulary fits, else of 32),
`.offsets` (unsigned 64-bit, first id of each document inside the partition,
plus the end), `.docs` (signed 64-bit doc_ids; the smallest value stands for
null). Partition bases are prefix sums over the partitions' id counts, so
partition files in order are one flat file. Files get their final name by a
rename when they are whole, and every attempt writes names of its own: a retried
or speculative task cannot leave a torn file behind a recorded name.

Reading maps a file into memory where the folder is a mounted path, and reads
ranges of it through its file system's client otherwise.

Defined results: a null text is an empty document (only the end id); null doc_ids
come first; rows with equal doc_ids are ordered by text; an empty table writes
no files and gives an empty result; extra columns do not take part.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, written
from .tokens import MEMO, encoder

NULL_ID = -(1 << 63)
#: Bytes of text in a partition, about; there are `spark.sql.shuffle.partitions` at least.
PART_BYTES = 128 << 20
#: Documents that are read back at once.
AT_ONCE = 5000


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def kind_of(tokenizer, end_id: int) -> str:
    """The id type of the files."""
    return "<u2" if max(tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, folder: str, path: str, blanks_drop: bool, end_id: int, partitions: int | None = None) -> DataFrame:
    """Write the files; returns the manifest: part, name, n_docs, n_ids, kind, base."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    total = 0 if partitions else rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    end = struct.pack("<I", end_id)

    def run(batches):
        enc = encoder(path, blanks_drop, 2 * MEMO)
        store, root = _fs(folder)
        store.create_dir(root, recursive=True)
        name = f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        offsets, ids, total = [np.zeros(1, np.int64)], [], 0
        with store.open_output_stream(name + ".ids.tmp") as out:
            for b in batches:
                held = [enc.raw(t or "") + end for t in b.column(1).to_pylist()]
                offsets.append(total + np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) // 4))
                total = int(offsets[-1][-1]) if held else total
                out.write(np.frombuffer(b"".join(held), "<u4").astype(kind_of(enc.tokenizer, end_id)).tobytes())
                ids.append(b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False))
        if total:
            for kind, data in (("offsets", np.concatenate(offsets).astype("<u8")), ("docs", np.concatenate(ids).astype("<i8"))):
                with store.open_output_stream(f"{name}.{kind}.tmp") as out:
                    out.write(data.tobytes())
                store.move(f"{name}.{kind}.tmp", f"{name}.{kind}")
            store.move(name + ".ids.tmp", name + ".ids")
        else:
            store.delete_file(name + ".ids.tmp")
            return
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "name": [name], "n_docs": [sum(map(len, ids))], "n_ids": [total], "kind": [kind_of(enc.tokenizer, end_id)]}, pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("kind", pa.string())]))

    manifest = written(ordered.mapInArrow(run, "part int, name string, n_docs bigint, n_ids bigint, kind string"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _ranges(store, name: str, kind: str):
    """A function that gives elements i to j of a file."""
    if store.type_name == "local":
        whole = np.memmap(name, kind, "r")
        return lambda i, j: whole[i:j]
    file, width = store.open_input_file(name), np.dtype(kind).itemsize
    return lambda i, j: np.frombuffer(file.read_at((j - i) * width, i * width), kind)


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        store, _ = _fs(folder)
        for b in batches:
            for name, base, kind, n in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                ids, offsets, docs = (_ranges(store, f"{name}.{k}", t) for k, t in (("ids", kind), ("offsets", "<u8"), ("docs", "<i8")))
                for at in range(0, n, AT_ONCE):
                    end = min(n, at + AT_ONCE)
                    cut = np.asarray(offsets(at, end + 1), np.int64)
                    some, first = ids(int(cut[0]), int(cut[-1])), int(cut[0])
                    crc = [zlib.crc32(some[i - first : j - first].astype("<u4")) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    own = np.asarray(docs(at, end))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, mask=own == NULL_ID), pa.array(cut[:-1] + base), pa.array(np.diff(cut)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    parts = max(1, manifest.count())  # one row a file
    spread = manifest.select("name", "base", "kind", "n_docs", "part").repartition(parts, "part")
    return spread.select("name", "base", "kind", "n_docs").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, path: str, blanks_drop: bool, end_id: int) -> DataFrame:
    folder = fresh_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, path, blanks_drop, end_id), folder)
