"""Removal of long repeated byte strings, found with run-length indexes.

A byte goes if a string of ``WIDTH`` bytes that covers it starts at two places or more
of the corpus, overlaps and the same document included.

1. Every window of ``WIDTH`` bytes is named by the smallest hash of its ``GRAMS[0]``-byte
   grams; equal windows have equal names.  Consecutive windows of one name make a
   fragment, so each window lies in exactly one fragment.
2. Fragments with equal bytes (a 64-bit identity under a 64-bit name) are one, with a count
   and their places: in each task first, so that a passage of many documents is few rows
   where they meet.  One of each goes on, where it occurs again, its name has other fragments or its own
   windows can be equal.
3. Fragments are dealt by name into blocks of about ``BLOCK_BYTES``, those that occur again
   with a twin.  A run-length index of each block (see ``run_index``) is streamed for
   matching statistics, and windows with a match of ``WIDTH`` or more are marked; marks
   are joined back to all places of a fragment.  Every mark comes from an index.
4. The fragments of a name with over ``HOT`` of them, too many for a block, are named and
   cut anew by their longer grams (``GRAMS[1]``, at last ``WIDTH`` itself, when equal names
   are equal windows) and go through the same steps.  They are cut where the documents are:
   their places are broadcast, ``CUT_BLOCK`` at once, so no text is shuffled for them.
5. The marked windows' bytes are cut from the documents.

Defined results: null and empty texts, and texts under ``WIDTH`` bytes, lose nothing;
documents are told apart by key and text, so equal rows are repeats of each other; a
null key is allowed; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import columnar as C
from .run_index import RunIndex
from .storage import prepared, schema_with, written

WIDTH = 200
#: Bytes of the grams that name a window, and of those that name it anew where a name is too frequent.
GRAMS = (48, 128)
#: Windows of a fragment at most.
LONGEST = 512
BLOCK_BYTES = 1 << 20
#: Fragments of a task that are looked through for equal ones at once.
GATHER = 1 << 17
#: Different fragments of a name in one block at most.
HOT = 4096
#: Places of too frequent fragments that are broadcast at once, about.
CUT_BLOCK = 500_000


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    have = 1  # values that each minimum covers so far
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have :][:n])


def fragments(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, name, identity, first window, windows, inner) of the fragments of each text.

    inner: the gram that names the fragment stands in it twice or more, without which no
    two of its own windows can be equal.
    """
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    if len(data) < width:
        return none
    grams = C.RollingHash.of_bytes(data).windows(gram)
    reach = width - gram + 1
    names = sliding_minimum(grams, reach)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), np.maximum(sizes - width + 1, 0))
    if not len(row):
        return none
    first = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(np.maximum(sizes - width + 1, 0), out=first[1:])
    inside = np.arange(len(row)) - first[row]
    name = names[offsets[row] + inside]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
    began = np.maximum.accumulate(np.where(fresh, np.arange(len(row)), 0))
    fresh |= (np.arange(len(row)) - began) % LONGEST == 0
    at = np.flatnonzero(fresh)
    count = np.diff(at, append=len(row))
    start = offsets[row[at]] + inside[at]
    identity = C.RollingHash.of_bytes(data, 1).spans(start, start + count + width - 1)
    # A gram is the smallest of a window if it equals the largest name of the windows around it.
    around = np.concatenate([np.zeros(reach - 1, np.uint64), names, np.zeros(reach - 1, np.uint64)])
    smallest = np.flatnonzero(~sliding_minimum(~around, reach) == grams)
    low, high = np.searchsorted(smallest, start), np.searchsorted(smallest, start + count + reach - 1)
    size = high - low
    which = np.repeat(np.arange(len(at)), size)
    places = smallest[np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + low[which]]
    inner = np.bincount(which[grams[places] == name[at][which]], minlength=len(at)) > 1
    return row[at], name[at], identity, inside[at], count, inner


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs with k and c, which tell documents apart: 64 bits of the text beside the key, or 128 where there is none."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.withColumn("k", F.coalesce(F.col(key).cast("long"), F.xxhash64(F.lit(1), raw))).withColumn("c", F.xxhash64(raw))


_PLACE = pa.struct([("k", pa.int64()), ("c", pa.int64()), ("lo", pa.int32())])


def _collapsed(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Equal fragments as one row: the place of the first, ``more`` places, and the sum of times."""
    k, c, times, lo, n, name, identity, inner = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((identity, name))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (name[order][1:] != name[order][:-1]) | (identity[order][1:] != identity[order][:-1])
    at = np.flatnonzero(fresh)
    first, rest = order[at], order[~fresh]
    size = np.diff(at, append=len(order)) - 1
    ends = np.zeros(len(at) + 1, dtype=np.int32)
    np.cumsum(size, out=ends[1:])
    places = pa.StructArray.from_arrays([pa.array(k[rest]), pa.array(c[rest]), pa.array(lo[rest])], fields=list(_PLACE))
    more = pa.ListArray.from_arrays(pa.array(ends), places, mask=pa.array(size == 0))
    total = np.add.reduceat(times[order].astype(np.int64), at) if len(at) else np.zeros(0, dtype=np.int64)
    columns = [pa.array(x[first]) for x in (k, c, lo, n, name.view(np.int64), identity.view(np.int64), inner)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(total), more], names=["k", "c", "lo", "n", "h", "f", "inner", "times", "more"])


def _repeats(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """Fragments of rows (k, c, text, times) whose windows may repeat: k, c, lo, more (further places), n, h (name), f (identity), twice (occurs again), indexed (one of each), kinds (different fragments of the name).

    Equal fragments of about ``GATHER`` ones are one row before anything is shuffled.
    """

    def run(batches):
        parts, held = [], 0
        for batch in C.slices(batches, "text"):
            data, offsets = C.text_buffer(batch.column(2))
            row, name, identity, lo, n, inner = fragments(data, offsets, width, gram)
            k, c, times = (batch.column(i).to_numpy()[row] for i in (0, 1, 3))
            parts.append((k, c, times, lo.astype(np.int32), n.astype(np.int32), name, identity, inner))
            held += len(row)
            if held >= GATHER:
                yield _collapsed(parts)
                parts, held = [], 0
        if parts:
            yield _collapsed(parts)

    places = "more array<struct<k:long,c:long,lo:int>>"
    found = rows.select("k", "c", "text", "times").mapInArrow(run, f"k long, c long, lo int, n int, h long, f long, inner boolean, times long, {places}").repartition("h")
    same = Window.partitionBy("h", "f")
    found = found.withColumn("rn", F.row_number().over(same.orderBy("k", "c", "lo"))).withColumn("copies", F.sum("times").over(same))
    named = Window.partitionBy("h")
    found = found.withColumn("kinds", F.sum((F.col("rn") == 1).cast("int")).over(named))
    return found.where("copies > 1 or kinds > 1 or inner").select("k", "c", "lo", "more", "n", "h", "f", (F.col("copies") > 1).alias("twice"), (F.col("rn") == 1).alias("indexed"), "kinds")


def _cut_out(rows: DataFrame, wanted: DataFrame, width: int, hint: str = "shuffle_hash") -> DataFrame:
    """h, f, twice and the bytes of the wanted fragments (one of each; by broadcast, one for each task that has the text)."""
    parts = wanted.groupBy("k", "c").agg(F.collect_list(F.struct("lo", "n", "h", "f", "twice")).alias("parts"))
    joined = rows.select("k", "c", "text").join(parts.hint(hint), ["k", "c"]).select("k", "c", "text", "parts")

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in C.slices(batches, "text"):
            fresh = []
            for i, name in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if name not in seen:
                    seen.add(name)
                    fresh.append(i)
            batch = batch.take(pa.array(fresh, pa.int64()))  # equal rows are one here
            data, offsets = C.text_buffer(batch.column(2))
            parts = batch.column(3)
            flat, counts = parts.flatten(), np.diff(parts.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), counts)
            start = offsets[row] + flat.field(0).to_numpy()
            size = flat.field(1).to_numpy() + (width - 1)
            at = np.zeros(len(row) + 1, dtype=np.int64)
            np.cumsum(size, out=at[1:])
            raw = data[np.arange(at[-1]) + np.repeat(start - at[:-1], size)] if len(row) else data[:0]
            values = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
            yield pa.RecordBatch.from_arrays([flat.field(2), flat.field(3), flat.field(4), values], names=["h", "f", "twice", "fragment"])

    return joined.mapInArrow(run, "h long, f long, twice boolean, fragment binary")


def _runs(long: np.ndarray, begin: int, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, after last) of the maximal runs of marked windows."""
    edge = np.diff(long[begin : begin + windows].astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _indexed(cut: DataFrame, width: int, shards: int) -> DataFrame:
    """h, f, start, end of the marked spans of each fragment, by a run-length index of each block."""

    def run(table: pa.Table) -> pa.Table:
        pieces = table.column("fragment").to_pylist()
        index = RunIndex(pieces, width, np.asarray(table.column("twice").to_numpy(zero_copy_only=False), dtype=bool))
        long = index.long_matches()
        rows, starts, ends = [], [], []
        for i in range(len(pieces)):
            a, b = _runs(long, int(index.begin[i]), len(pieces[i]) - width + 1)
            rows.append(np.full(len(a), i))
            starts.append(a)
            ends.append(b + width - 1)
        take = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
        both = [pa.array((np.concatenate(x) if x else np.zeros(0)).astype(np.int32)) for x in (starts, ends)]
        return pa.table({"h": table.column("h").take(take), "f": table.column("f").take(take), "start": both[0], "end": both[1]})

    dealt = cut.withColumn("shard", F.pmod("h", F.lit(shards)))
    return dealt.select("shard", "h", "f", "twice", "fragment").groupBy("shard").applyInArrow(run, "h long, f long, start int, end int")


def _hot_pieces(rows: DataFrame, wanted: DataFrame, number: int, width: int) -> DataFrame:
    """The wanted fragments (so many) as rows k (name), c (identity), text, times; a scan of the texts for each block of CUT_BLOCK."""
    blocks = -(-number // CUT_BLOCK)
    block = F.pmod(F.xxhash64("k", "c"), F.lit(blocks))
    out = []
    for i in range(blocks):
        cut = _cut_out(rows, wanted.where(block == i), width, "broadcast").dropDuplicates(["h", "f"])
        cut = cut.select(F.col("h").alias("k"), F.col("f").alias("c"), F.col("fragment").alias("text"), F.when(F.col("twice"), 2).otherwise(1).alias("times"))
        out.append(written(cut, "hot-fragments"))
    return functools.reduce(DataFrame.unionByName, out)


def _spans(rows: DataFrame, width: int, grams: tuple[int, ...], hot: int, block_bytes: int) -> DataFrame:
    """k, c, start, end (any order, overlapping) of the repeated bytes of rows (k, c, text, times)."""
    repeats = written(_repeats(rows, width, grams[0]), "repeats")
    wanted = repeats.where("indexed")
    fits = F.col("kinds") <= hot if len(grams) > 1 else F.lit(True)
    size = wanted.agg(F.sum(F.when(fits, F.col("n") + (width - 1))).alias("bytes"), F.count(F.when(~fits, 1)).alias("hot")).first()
    marked = _indexed(_cut_out(rows, wanted.where(fits), width), width, max(1, -(-int(size["bytes"] or 0) // block_bytes)))
    if size["hot"]:
        finer = _spans(_hot_pieces(rows, wanted.where(~fits), size["hot"], width), width, grams[1:], hot, block_bytes)
        marked = marked.unionByName(finer.withColumnsRenamed({"k": "h", "c": "f"}))
    found = repeats.select("k", "c", "lo", "more", "h", "f").join(marked, ["h", "f"])
    places = F.concat(F.array(F.struct("k", "c", "lo")), F.coalesce("more", F.array().cast(repeats.schema["more"].dataType)))
    found = found.select("start", "end", F.inline(places))
    return found.select("k", "c", (F.col("lo") + F.col("start")).alias("start"), (F.col("lo") + F.col("end")).alias("end"))


def repeated_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH, grams: tuple[int, ...] = GRAMS, hot: int = HOT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """k, c and the marked spans (start, end; any order, overlapping) of each document that has some."""
    prepared(docs.sparkSession)
    rows = _keyed(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), "id", "text").withColumn("times", F.lit(1))
    return _spans(rows, width, (*grams, width), hot, block_bytes).groupBy("k", "c").agg(F.collect_set(F.struct("start", "end")).alias("marked"))


def _with_spans(docs: DataFrame, key: str, text: str, options: dict) -> DataFrame:
    """The columns of docs as c0, c1, ..., whatever they are called, and marked."""
    spans = repeated_spans(docs, key=key, text=text, **options)
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {n: f"c{i}" for i, n in enumerate(docs.columns)}
    return _keyed(rows, at[key], at[text]).join(spans.hint("shuffle_hash"), ["k", "c"], "left").select(*rows.columns, "marked")


def _merged(batch: pa.RecordBatch, text: str):
    """Yield (row, text bytes, merged spans) for each row of a batch."""
    data, offsets = C.text_buffer(batch.column(batch.schema.get_field_index(text)))
    marked = batch.column(batch.num_columns - 1)
    at, flat = marked.offsets.to_numpy(), marked.values
    starts, ends = (flat.field(i).to_numpy() for i in (0, 1))
    has = marked.is_valid().to_numpy(zero_copy_only=False)
    for i in range(batch.num_rows):
        raw = data[offsets[i] : offsets[i + 1]]
        spans: list[tuple[int, int]] = []
        if has[i] and at[i + 1] > at[i]:
            edge = np.zeros(len(raw) + 1, dtype=np.int32)
            np.add.at(edge, starts[at[i] : at[i + 1]], 1)
            np.add.at(edge, ends[at[i] : at[i + 1]], -1)
            step = np.diff((np.cumsum(edge[:-1]) > 0).astype(np.int8), prepend=0, append=0)
            spans = list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))
        yield i, raw, spans


def _kept(raw: np.ndarray, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return raw.tobytes()
    keep = np.ones(len(raw), dtype=bool)
    for a, b in spans:
        keep[a:b] = False
    return raw[keep].tobytes()


def digests(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    joined = _with_spans(docs.select(key, text), key, text, options)
    kind = dict(docs.dtypes)[key]

    def run(batches):
        for batch in C.slices(batches, "c1"):
            size, gone, number, sha = [], [], [], []
            for _, raw, spans in _merged(batch, "c1"):
                size.append(len(raw))
                gone.append(sum(b - a for a, b in spans))
                number.append(len(spans))
                sha.append(hashlib.sha256(_kept(raw, spans)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(number, pa.int64()), pa.array(sha, pa.string())], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with the repeated bytes cut from the text; all rows and columns stay.

    Where a cut splits a character its rest goes too, so texts stay valid.  ``n_chars``,
    where present, is set anew for cut texts.
    """
    names, types = docs.columns, [f.dataType for f in docs.schema.fields]
    at, body = names.index(text), f"c{names.index(text)}"
    joined = _with_spans(docs, key, text, options)

    def run(batches):
        for batch in C.slices(batches, body):
            out = batch.column(at)
            changed = {i: _kept(raw, spans).decode("utf-8", "ignore") for i, raw, spans in _merged(batch, body) if spans}
            if changed:
                out = pa.array([changed.get(i, t) for i, t in enumerate(out.to_pylist())], pa.string())
            flags = np.zeros(batch.num_rows, dtype=bool)
            flags[list(changed)] = True
            yield pa.RecordBatch.from_arrays([*[out if i == at else batch.column(i) for i in range(len(names))], pa.array(flags)], names=[*batch.schema.names[:-1], "cut"])

    cut = joined.mapInArrow(run, schema_with(list(joined.drop("marked").schema.fields), "cut boolean"))
    columns = []
    for i, n in enumerate(names):
        value = F.col(f"c{i}")
        if n == "n_chars":
            value = F.when(F.col("cut"), F.length(body).cast(types[i])).otherwise(value)
        columns.append(value.alias(n))
    return cut.select(*columns)
