"""Benchmark decontamination by a broadcast set of normalised word windows.

The benchmark's windows (13 consecutive words, or the whole item if it is shorter) are
made by Spark and dealt by their hash into blocks of at most ``BLOCK_WINDOWS`` windows and
``BLOCK_BYTES`` bytes, counted before anything is collected.  A block is broadcast as
arrays: sorted 64-bit hashes, and the windows' words and items.  Documents' windows are
looked up, and every hit is verified on its words before it counts.  One block needs one
scan.  Several are scanned one after the other, each dropped before the next; what they
hit is kept by a digest of the text and joined back, so no text is shuffled for it.

Defined results: null and empty texts have no words and are never hit; items with
null id or without words have no windows; equal items each count; repeated item ids
count once; repeated documents are judged row by row.  Words: see ``ALNUM``.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columnar as C
from .storage import discard, schema_with, spare, written

#: Words of a window.
WINDOW = 13
#: Windows, and bytes of their words, in one broadcast block at most (a window takes its bytes and about 24 more).
BLOCK_WINDOWS, BLOCK_BYTES = 400_000, 40 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _windows(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """item, n (words), h (hash), w (the words, lower-cased and joined by blanks) of the distinct windows of every item."""

    def run(batches):
        for batch in C.slices(batches, "text"):
            words = C.Words(*C.text_buffer(batch.column(1)), C.ALNUM)
            hashes = words.hashes(lower=True)
            size = words.ends - words.starts + 1
            at = np.zeros(len(words) + 1, dtype=np.int64)
            np.cumsum(size, out=at[1:])
            normal = C.ASCII_LOWER[words.data[np.minimum(np.arange(at[-1]) + np.repeat(words.starts - at[:-1], size), max(len(words.data) - 1, 0))]]
            normal[at[1:] - 1] = 0x20
            for n in range(1, window + 1):
                first, h = words.windows(hashes, n)
                if n < window:
                    own = words.counts[words.row[first]] == n
                    first, h = first[own], h[own]
                for low in range(0, len(first), 10_000):
                    f, end = first[low : low + 10_000], at[first[low : low + 10_000] + n] - 1
                    raw = [normal[a:b].tobytes() for a, b in zip(at[f].tolist(), end.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(words.row[f])), pa.array(np.full(len(f), n)), pa.array(h[low : low + 10_000].view(np.int64)), pa.array(raw, pa.binary())], names=["item", "n", "h", "w"])

    items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    return items.mapInArrow(run, "item string, n long, h long, w binary").distinct()


class WindowSet:
    """A block of windows: by length in words, sorted hashes with the places of each one's words and item."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.items = rows.column("item").unique().sort()
        item = np.asarray(pa.compute.index_in(rows.column("item"), self.items)).astype(np.int32)
        n, h = rows.column("n").to_numpy(), rows.column("h").to_numpy().view(np.uint64)
        data, offsets = C.text_buffer(rows.column("w").combine_chunks())
        self.words = data.tobytes()
        self.tables = {}
        for k in np.unique(n).tolist():
            at = np.flatnonzero(n == k)
            at = at[np.argsort(h[at], kind="stable")]
            self.tables[k] = (h[at], offsets[at].astype(np.int32), offsets[at + 1].astype(np.int32), item[at])

    def __len__(self) -> int:
        return sum(len(t[0]) for t in self.tables.values())

    def nbytes(self) -> int:
        return len(self.words) + sum(x.nbytes for t in self.tables.values() for x in t) + self.items.nbytes

    def filters(self) -> dict[int, np.ndarray]:
        """A table of flags over the low bits of the hashes, by length; made once a worker."""
        if not hasattr(self, "_filters"):
            self._filters = {}
            for n, (hashes, *_) in self.tables.items():
                flags = np.zeros(1 << max(12, min(22, (8 * len(hashes)).bit_length())), dtype=bool)
                flags[hashes & np.uint64(len(flags) - 1)] = True
                self._filters[n] = flags
        return self._filters

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_filters"}

    def hits(self, words: C.Words) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
        """(first words, lengths) of the verified hits, and the item ids by text."""
        hashes = words.hashes(lower=True)
        places, lengths, items = [], [], {}
        for n, (table, begin, end, item) in self.tables.items():
            flags = self.filters()[n]
            at, h = words.windows(hashes, n)
            maybe = flags[h & np.uint64(len(flags) - 1)]
            at, h = at[maybe], h[maybe]
            low, high = np.searchsorted(table, h), np.searchsorted(table, h, side="right")
            for j in np.flatnonzero(high > low).tolist():
                i = int(at[j])
                said = b" ".join(_WORD.findall(words.data[words.starts[i] : words.ends[i + n - 1]].tobytes().lower()))
                found = [int(item[e]) for e in range(low[j], high[j]) if self.words[begin[e] : end[e]] == said]
                if found:
                    places.append(i)
                    lengths.append(n)
                    items.setdefault(int(words.row[i]), set()).update(found)
        names = {i: self.items[i].as_py() for i in set().union(*items.values())} if items else {}
        return np.array(places, dtype=np.int64), np.array(lengths, dtype=np.int64), {r: {names[i] for i in s} for r, s in items.items()}


_SCAN_SCHEMA = "n_words long, hits array<struct<first:int,last:int,start:int,end:int>>, items array<string>"
_HITS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def _found(data: np.ndarray, offsets: np.ndarray, windows) -> tuple[C.Words, list[list[dict]], list[list[str]]]:
    """(words, hits, items) of the texts in a buffer; hits are merged runs of hit words: first and last word, byte span."""
    words = C.Words(data, offsets, C.ALNUM)
    rows = len(offsets) - 1
    places, lengths, items = windows.value.hits(words) if windows else ([], [], {})
    hits: list[list[dict]] = [[] for _ in range(rows)]
    if len(places):
        hit = C.covered(places, lengths, len(words))
        begins = hit.copy()
        begins[1:] &= ~hit[:-1] | (words.row[1:] != words.row[:-1])
        stops = hit.copy()
        stops[:-1] &= ~hit[1:] | (words.row[1:] != words.row[:-1])
        for a, b in zip(np.flatnonzero(begins).tolist(), np.flatnonzero(stops).tolist(), strict=True):
            row = int(words.row[a])
            base, low = int(words.first[row]), int(offsets[row])
            hits[row].append({"first": a - base, "last": b - base, "start": int(words.starts[a]) - low, "end": int(words.ends[b]) - low})
    return words, hits, [sorted(items.get(i, ())) for i in range(rows)]


def _scan(docs: DataFrame, text: str, windows, keep: list[str]) -> DataFrame:
    """The kept columns with n_words, hits and items; windows: a broadcast WindowSet or None."""
    kept = [f for f in docs.schema.fields if f.name in keep]
    names = [f.name for f in kept]

    def run(batches):
        for batch in C.slices(batches, text):
            words, hits, items = _found(*C.text_buffer(batch.column(batch.schema.get_field_index(text))), windows)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(n)) for n in names], pa.array(words.counts, pa.int64()), pa.array(hits, _HITS), pa.array(items, pa.list_(pa.string()))],
                names=[*names, "n_words", "hits", "items"],
            )

    rows = docs.select(*names, *([] if text in names else [text]))
    return rows.mapInArrow(run, schema_with(kept, _SCAN_SCHEMA))


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_windows: int, block_bytes: int) -> tuple[DataFrame, int]:
    """(the benchmark's windows, number of blocks)."""
    windows = written(_windows(benchmark, item_id, text, window), "benchmark-windows")
    size = windows.agg(F.count("*").alias("n"), F.sum(F.octet_length("w")).alias("b")).first()
    return windows, max(1, math.ceil(size["n"] / block_windows), math.ceil((size["b"] or 0) / block_bytes))


def find_hits(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: list[str], item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The kept columns (none of them n_words, hits or items) of every document with n_words, hits and items."""
    spark = docs.sparkSession
    windows, n = _blocks(benchmark, item_id, item_text, window, block_windows, block_bytes)
    if n == 1:
        return _scan(docs, text, spark.sparkContext.broadcast(WindowSet(windows.toArrow())), keep)
    digest, same = spare([*docs.columns, "n_words", "hits", "items"], "digest", "same")
    named = docs.withColumn(digest, F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    parts = []
    for b in range(n):
        block = spark.sparkContext.broadcast(WindowSet(windows.where(F.pmod(F.xxhash64("h", "n"), F.lit(n)) == b).toArrow()))
        parts.append(written(_scan(named, text, block, [digest]).where(F.size("items") > 0).dropDuplicates([digest]), "benchmark-hits"))
        block.destroy()
    discard(windows)
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    found = found.groupBy(F.col(digest).alias(same)).agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    counts = _scan(named, text, None, [*keep, digest]).drop("hits", "items")
    merged = counts.join(found, F.col(digest) == F.col(same), "left")
    none = F.array()
    return merged.select(*keep, "n_words", F.coalesce("hits", none.cast(found.schema["hits"].dataType)).alias("hits"), F.coalesce("items", none.cast("array<string>")).alias("items"))


def n_hit() -> F.Column:
    """Words in the union of the hit runs (runs of several blocks may overlap)."""
    step = F.aggregate(
        F.array_sort("hits"),
        F.struct(F.lit(-1).cast("long").alias("reach"), F.lit(0).cast("long").alias("n")),
        lambda a, h: F.struct(F.greatest(a["reach"], h["last"].cast("long")).alias("reach"), (a["n"] + F.greatest(F.lit(0).cast("long"), h["last"] - F.greatest(a["reach"], h["first"].cast("long") - 1))).alias("n")),
        lambda a: a["n"],
    )
    return step


def judged(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated (a hit, and hit words are a twentieth of all or more)."""
    return (
        found.withColumn("n_hit", n_hit())
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join(F.array_sort("items"), ","), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def _without(text: str, hits: list[dict]) -> str:
    raw, at, parts = text.encode(), 0, []
    for h in sorted(hits, key=lambda h: h["start"]):
        if h["start"] > at:
            parts.append(raw[at : h["start"]])
        at = max(at, h["end"])
    return (b"".join(parts) + raw[at:]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Drop contaminated documents and cut the hit spans from the others; all columns stay.

    A null text stays null.  ``n_chars``, where present, is set anew for cut texts.
    """
    names, types = docs.columns, [f.dataType for f in docs.schema.fields]
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at, last, numbered = names.index(text), len(names), rows.columns
    windows, n = _blocks(benchmark, item_id, item_text, window, block_windows, block_bytes)
    if n == 1:
        shared, found = docs.sparkSession.sparkContext.broadcast(WindowSet(windows.toArrow())), rows
    else:
        shared = None
        hits = find_hits(rows, benchmark, text=f"c{at}", keep=rows.columns, item_id=item_id, item_text=item_text, window=window, block_windows=block_windows, block_bytes=block_bytes)
        found = judged(hits).where(~F.col("contaminated")).select(*rows.columns, "hits")

    def run(batches):
        for batch in C.slices(batches, f"c{at}"):
            if shared is None:
                hits = batch.column(last).to_pylist()
            else:
                words, hits, _ = _found(*C.text_buffer(batch.column(at)), shared)
                n_hit = [sum(h["last"] - h["first"] + 1 for h in hs) for hs in hits]
                clean = [not n or 20 * n < total for n, total in zip(n_hit, words.counts.tolist(), strict=True)]
                batch, hits = batch.filter(pa.array(clean, pa.bool_())), [hs for hs, ok in zip(hits, clean, strict=True) if ok]
            out, cut = batch.column(at), [bool(hs) for hs in hits]
            if any(cut):
                out = pa.array([_without(t, hs) if hs else t for t, hs in zip(out.to_pylist(), hits, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*[out if i == at else batch.column(i) for i in range(last)], pa.array(cut, pa.bool_())], names=[*numbered, "cut"])

    cut = found.mapInArrow(run, schema_with(list(rows.schema.fields), "cut boolean"))
    columns = []
    for i, name in enumerate(names):
        value = F.col(f"c{i}")
        if name == "n_chars":
            value = F.when(F.col("cut"), F.length(f"c{at}").cast(types[i])).otherwise(value)
        columns.append(value.alias(name))
    return cut.select(*columns)
