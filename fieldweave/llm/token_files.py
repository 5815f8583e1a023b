"""Token ids in files: frequency-ranked ids, variable-length bytes, control bytes apart.

Ids are renumbered by falling corpus frequency, so common ids take one byte.  Each id
takes 1 to 4 bytes; its length less one stands as two bits in a separate control
stream, four ids a control byte.  A reader finds all lengths of a block by looking its
control bytes up in a table of 256 rows, then gathers the data bytes with numpy.

A file is a sequence of blocks in ascending key order.  Block: magic ``FWT1``; five
little-endian uint32: documents, ids, control bytes, data bytes, 0; document keys
(int64); ids of each document (uint32); control; data; a final newline.  Files are
written by Spark's own text writer (see ``storage``); the rank table is a Parquet file
beside them.

Defined results: a null text is an empty one (its end id alone); a null key is kept as
the smallest int64 in files and comes back null; repeated keys stay separate documents,
ordered by their ids' checksum.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import columnar as C
from . import tokens as T
from .storage import discard, fresh_path, read_files, schema_with, write_blobs, written

MAGIC = b"FWT1"
END_ID = 2
#: Documents of a block at most, and ids after which a block ends.
BLOCK_ROWS, BLOCK_IDS = 4096, 1 << 18
#: Documents of a file at most.
FILE_ROWS = 8192
_NULL = -(2**63)

_LENGTHS = np.array([[(b >> (2 * k) & 3) + 1 for k in range(4)] for b in range(256)], dtype=np.int64)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of an array of ranks."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    length = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    code[: len(ranks)] = length - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ranks, by table lookup of the control bytes."""
    length = _LENGTHS[control].ravel()[:n]
    at = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(length, out=at[1:])
    out = np.zeros(n, dtype=np.uint32)
    for k in range(4):
        has = length > k
        out[has] |= data[at[:-1][has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block(keys: np.ndarray, counts: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    return b"".join([MAGIC, struct.pack("<5I", len(keys), len(ranks), len(control), len(data), 0), keys.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), control, data])


def read_blocks(content: bytes):
    """(keys, counts, ranks) of each block of a file."""
    at = 0
    while at < len(content):
        if content[at : at + 4] != MAGIC:
            raise ValueError(f"no block at byte {at}")
        docs, ids, n_control, n_data, _ = struct.unpack_from("<5I", content, at + 4)
        at += 24
        keys = np.frombuffer(content, "<i8", docs, at)
        counts = np.frombuffer(content, "<u4", docs, at + 8 * docs)
        at += 12 * docs
        control = np.frombuffer(content, np.uint8, n_control, at)
        data = np.frombuffer(content, np.uint8, n_data, at + n_control)
        at += n_control + n_data
        if content[at : at + 1] != b"\n":
            raise ValueError("a block without its end")
        at += 1
        yield keys, counts, unpack(control, data, ids)


def tokenized(docs: DataFrame, *, key: str, text: str, end_id: int, path: str, carry: list[str] | None = None) -> DataFrame:
    """key and carried columns, ids (binary, little-endian uint16), n_tokens with the end id."""
    kept = [f for f in docs.schema.fields if f.name in [key, *(carry or [])]]

    def run(batches):
        encoder = T.encoder(path)
        if max(len(encoder.ends), end_id + 1) > 1 << 16:
            raise ValueError("ids of this vocabulary take more than 16 bits")
        for batch in C.slices(batches, text):
            data, offsets = C.text_buffer(batch.column(batch.schema.get_field_index(text)))
            ids, at = encoder.encode(data, offsets)
            rows = batch.num_rows
            out = np.full(len(ids) + rows, end_id, dtype="<u2")
            out[np.arange(len(ids)) + np.repeat(np.arange(rows), np.diff(at))] = ids
            at = at + np.arange(rows + 1)
            values = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((2 * at).astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f.name)) for f in kept], values, pa.array(np.diff(at))], names=[*[f.name for f in kept], "ids", "n_tokens"])

    names = [f.name for f in kept]
    return docs.select(*names, *([] if text in names else [text])).mapInArrow(run, schema_with(kept, "ids binary, n_tokens long"))


def _ranks(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """Rank of each id by falling count, ties by id.  At most ``vocabulary`` counts reach the driver."""

    def run(batches):
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            data, _ = C.text_buffer(batch.column(0))
            total += np.bincount(data.view("<u2"), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    counts = np.zeros(vocabulary, dtype=np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    rank = np.empty(vocabulary, dtype=np.int64)
    rank[np.lexsort((np.arange(vocabulary), -counts))] = np.arange(vocabulary)
    return rank


def write_token_files(docs: DataFrame, out: str, *, key: str = "doc_id", text: str = "text", end_id: int = END_ID, tokenizer: str = T.TOKENIZER) -> None:
    """Tokenise, rank ids over the corpus and write ``out``/data (files in ascending key order) and ``out``/ranks."""
    spark = docs.sparkSession
    path = T.tokenizer_path(tokenizer)
    tokens = written(tokenized(docs, key=key, text=text, end_id=end_id, path=path), "tokens")
    vocabulary = max(T.encoder(path).tokenizer.get_vocab_size(), end_id + 1)
    rank = _ranks(tokens, vocabulary)
    spark.createDataFrame([(int(i), int(r)) for i, r in enumerate(rank)], "id int, rank int").coalesce(1).write.parquet(f"{out}/ranks")
    shared = spark.sparkContext.broadcast(rank)

    def run(batches):
        rank = shared.value
        keys, counts, ranks, total = [], [], [], 0

        def flush():
            blob = block(np.concatenate(keys), np.concatenate(counts), np.concatenate(ranks))
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["blob"])

        for whole in batches:
            for batch in C.slices([whole], "ids", 2 * BLOCK_IDS):
                data, offsets = C.text_buffer(batch.column(1))
                for low in range(0, batch.num_rows, BLOCK_ROWS):
                    high = min(low + BLOCK_ROWS, batch.num_rows)
                    a, b = offsets[low], offsets[high]
                    keys.append(np.array(batch.column(0).slice(low, high - low).fill_null(_NULL), dtype=np.int64))
                    counts.append(np.diff(offsets[low : high + 1]) // 2)
                    ranks.append(rank[data[a:b].view("<u2")])
                    total += int(b - a) // 2
                    if total >= BLOCK_IDS or sum(map(len, keys)) >= BLOCK_ROWS:
                        yield flush()
                        keys, counts, ranks, total = [], [], [], 0
        if keys:
            yield flush()

    n = max(1, -(-tokens.count() // FILE_ROWS))
    tag = F.crc32("ids")
    ordered = tokens.select(key, "ids").repartitionByRange(n, F.col(key).asc_nulls_first(), tag).sortWithinPartitions(F.col(key).asc_nulls_first(), tag)
    write_blobs(ordered.mapInArrow(run, "blob binary"), "blob", f"{out}/data")
    discard(tokens)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """file, at (place in the file), key, n_tokens, ids (binary, little-endian uint32), read back from the files."""
    rows = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    shared = spark.sparkContext.broadcast(np.array([r["id"] for r in rows], dtype="<u4"))

    def run(batches):
        by_rank = shared.value
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen = 0
                for keys, counts, ranks in read_blocks(content.as_py()):
                    ids = by_rank[ranks]
                    at = np.zeros(len(keys) + 1, dtype=np.int64)
                    np.cumsum(counts, out=at[1:])
                    values = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer((4 * at).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(np.arange(seen, seen + len(keys))), pa.array(keys, mask=keys == _NULL), pa.array(counts.astype(np.int64)), values], names=["file", "at", "key", "n_tokens", "ids"])
                    seen += len(keys)

    return read_files(spark, f"{path}/data").mapInArrow(run, "file string, at long, key long, n_tokens long, ids binary")


def with_starts(read: DataFrame) -> DataFrame:
    """Adds start: the ids of all documents before each one, in the order of the files."""
    sums = read.groupBy("file").agg(F.sum("n_tokens").alias("tokens"), F.struct(F.min(F.coalesce("key", F.lit(_NULL))), F.min("file")).alias("low"))
    before = sums.select("file", (F.sum("tokens").over(Window.orderBy("low")) - F.col("tokens")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return read.withColumn("inside", inside).join(before, "file").withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


def digests(docs: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str = T.TOKENIZER) -> DataFrame:
    """key, start, n_tokens, ids_crc32 of every document, from files written and read back."""
    spark = docs.sparkSession
    out = fresh_path(spark, "token-files")
    write_token_files(docs, out, key=key, text=text, tokenizer=tokenizer)
    light = written(read_token_files(spark, out).select("file", "at", "key", "n_tokens", F.crc32("ids").alias("ids_crc32")), "token-digests")
    discard(out)
    return with_starts(light).select(F.col("key").alias(key), "start", "n_tokens", "ids_crc32")
