"""Mixture-controlled packing into fixed windows by deficit round-robin.

Documents are dealt into blocks of about ``BLOCK_TOKENS`` tokens so that each block holds
every source by the target shares for as long as the source lasts: a document's hash says
how far down its source's queue it stands, the shares say when the mixture gets there.
Within a block every source has a queue.  Each window of 2048 tokens credits every source
that still has tokens its share; the source with the largest deficit is served next, for
its whole deficit or at least ``QUANTUM`` tokens, until the window is full.  Deficits carry
from window to window, and into a block from all blocks before it (their token counts by
source are known beforehand, so blocks run in parallel).  A queue that empties has no claim
left.  Only a block's last window is short.

Sources without a share in a given mixture come after all others, in the corpus' own
proportions, which are also the target where no mixture is given.

Defined results: a null text is an empty one (its end id alone is packed); a null source
is a queue of its own (None in a mixture); repeated rows are packed each; an empty table
gives no pieces; the same table is packed the same way each time.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokens as T
from .storage import written
from .token_files import tokenized

WIDTH = 2048
END_ID = 1
BLOCK_TOKENS = 1 << 21
QUANTUM = 256

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(lengths: list[np.ndarray], shares: np.ndarray, deficits: np.ndarray, width: int = WIDTH, quantum: int = QUANTUM, last: np.ndarray | None = None):
    """Yield (window, offset, queue, document, start, length) until every queue is empty.

    lengths: tokens of each document, by queue; shares and deficits by queue; queues marked
    ``last`` are served only when the others are empty.
    """
    left = np.array([int(x.sum()) for x in lengths], dtype=np.int64)
    doc, start = [0] * len(lengths), [0] * len(lengths)
    lengths = [x.tolist() for x in lengths]
    last = np.zeros(len(lengths), dtype=bool) if last is None else last
    deficits = np.where(left > 0, deficits, 0.0).astype(float)
    window = 0
    total = int(left.sum())
    while total:
        due = (left > 0) & ~last
        now = due if due.any() else left > 0
        credit = np.where(now, shares, 0.0)
        deficits += credit / credit.sum() * width if credit.sum() > 0 else 0.0
        room = width
        while room and total:
            if not now.any():
                now = left > 0
            q = int(np.argmax(np.where(now, deficits, -np.inf)))
            turn = min(room, max(quantum, int(deficits[q])), int(left[q]))
            while turn:
                n = min(turn, lengths[q][doc[q]] - start[q])
                yield window, width - room, q, doc[q], start[q], n
                room, turn, total = room - n, turn - n, total - n
                left[q] -= n
                deficits[q] -= n
                start[q] += n
                if start[q] == lengths[q][doc[q]]:
                    doc[q], start[q] = doc[q] + 1, 0
            if not left[q]:
                deficits[q] = 0.0
                now = now & (left > 0)
        window += 1


class Schedule:
    """When each token of the mixture comes: sources with a target share side by side until each is used up, then the rest."""

    def __init__(self, tokens: dict[str, int], shares: dict[str, float], total: int):
        self.total = total
        self.first = {s: (n, shares[s] / sum(shares[x] for x in tokens)) for s, n in tokens.items()}
        self.before_rest = sum(tokens.values())
        self.rest = total - self.before_rest
        # Total tokens out at the time when a source is used up; in between the total grows linearly.
        ends = np.array([0.0, *sorted(n / share for n, share in self.first.values())])
        self.ends, self.totals = ends, np.array([sum(min(n, share * t) for n, share in self.first.values()) for t in ends])

    def place(self, source: Column, u: Column) -> Column:
        """The place in the whole output of a document that stands at u (0 to 1) of its source's queue."""
        place = self.before_rest + u * self.rest
        if not self.first:
            return place
        time = F.create_map(*[F.lit(x) for s, (n, share) in self.first.items() for x in (s, n / share)])
        sizes = F.array(*[F.struct(F.lit(float(n)).alias("n"), F.lit(share).alias("share")) for n, share in self.first.values()])
        at = u * F.try_element_at(time, source)
        return F.coalesce(F.aggregate(sizes, F.lit(0.0), lambda s, x: s + F.least(x["n"], x["share"] * at)), place)

    def due(self, source: str, tokens: int, place: float) -> float:
        """Tokens of a source that are due before a place of the output."""
        if source in self.first:
            n, share = self.first[source]
            return min(n, share * float(np.interp(place, self.totals, self.ends)))
        return tokens * min(1.0, max(0.0, (place - self.before_rest) / max(self.rest, 1)))

    def share(self, source: str, tokens: int) -> float:
        return self.first[source][1] if source in self.first else tokens / max(self.rest, 1)


def _label(source: str) -> Column:
    """A source's name, null set apart from any text."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))


def _plan(tokens: DataFrame, schedule: Schedule, blocks: int, width: int) -> DataFrame:
    """block, label, share, deficit on entry, last (comes after the mixture) and the block's first sequence."""
    by = tokens.groupBy("block", "label").agg(F.sum("n_tokens").alias("n"))
    whole = by.groupBy("block").agg(F.sum("n").alias("block_n"))
    order = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("block", F.coalesce(F.sum(F.ceil(F.col("block_n") / width)).over(order), F.lit(0)).alias("first_sequence"))
    own = Window.partitionBy("label").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0)))
    totals = by.groupBy("label").agg(F.sum("n").alias("source_n"))
    joined = by.join(totals, "label").join(whole, "block").select("block", "label", "before", "source_n", "first_sequence")

    def run(batches):
        for batch in batches:
            rows = list(zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True))
            place = [schedule.total * b / blocks for b, *_ in rows]
            share = [schedule.share(s, n) for _, s, _, n in rows]
            deficit = [schedule.due(s, n, p) - before for (_, s, before, n), p in zip(rows, place, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share, pa.float64()), pa.array(deficit, pa.float64()), pa.array([s not in schedule.first for _, s, _, _ in rows]), batch.column(4)], names=["block", "label", "share", "deficit", "last", "first_sequence"])

    return joined.mapInArrow(run, "block long, label string, share double, deficit double, last boolean, first_sequence long")


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", mixture: dict[str | None, float] | None = None, width: int = WIDTH, end_id: int = END_ID, tokenizer: str = T.TOKENIZER, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, source and the piece's ids (binary uint16)."""
    rows = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    tokens = written(tokenized(rows, key="key", text="text", end_id=end_id, path=T.tokenizer_path(tokenizer), carry=["source"]), "packing")
    total = tokens.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_tokens))
    tokens = tokens.withColumns({"label": _label("source"), "crc": F.crc32("ids")})
    shares = {("null" if s is None else f"={s}"): float(x) for s, x in (mixture or {}).items() if x > 0}
    sizes = {r["label"]: r["n"] for r in tokens.where(F.col("label").isin(list(shares))).groupBy("label").agg(F.sum("n_tokens").alias("n")).collect()} if shares else {}
    schedule = Schedule(sizes, shares, total)
    # Rows that are equal would fall into one block; any of them may take another's place.
    again = tokens.groupBy("key", "crc").count().where("count > 1").select(F.col("key").alias("key2"), F.col("crc").alias("crc2"))
    if again.isEmpty():
        mark = F.xxhash64("key", "crc")
    else:
        tokens = tokens.join(again, F.col("key").eqNullSafe(F.col("key2")) & (F.col("crc") == F.col("crc2")), "left").drop("key2")
        tokens = written(tokens.withColumn("number", F.when(F.col("crc2").isNotNull(), F.monotonically_increasing_id())).drop("crc2"), "packing-numbered")
        mark = F.xxhash64("key", "crc", "number")
    u = F.shiftrightunsigned(mark, 11) / float(1 << 53)
    tokens = tokens.withColumn("block", F.least(F.floor(schedule.place(F.col("label"), u) * blocks / max(total, 1)), F.lit(blocks - 1)).cast("long"))
    plan = written(_plan(tokens, schedule, blocks, width), "packing-plan")
    key_type = pa.int64() if dict(rows.dtypes)["key"] == "bigint" else None

    def run(docs: pa.Table, plan: pa.Table) -> pa.Table:
        plan = plan.sort_by("label")
        names = plan.column("label").to_pylist()
        place = {s: i for i, s in enumerate(names)}
        ids, own = docs.column("ids").to_pylist(), docs.column("key").to_pylist()
        order = sorted(range(docs.num_rows), key=lambda i: (zlib.crc32(ids[i][:64]), own[i] is None, own[i] or 0, ids[i]))
        sources, labels = docs.column("source").to_pylist(), docs.column("label").to_pylist()
        queues: list[list[int]] = [[] for _ in names]
        for i in order:
            queues[place[labels[i]]].append(i)
        n = np.array(docs.column("n_tokens"), dtype=np.int64)
        first = plan.column("first_sequence")[0].as_py()
        got = list(fill([n[q] for q in queues], np.array(plan.column("share")), np.array(plan.column("deficit")), width, last=np.array(plan.column("last").to_pylist(), dtype=bool)))
        rows = [queues[q][d] for _, _, q, d, _, _ in got]
        pieces = [ids[r][2 * s : 2 * (s + k)] for r, (_, _, _, _, s, k) in zip(rows, got, strict=True)]
        keys = docs.column("key").combine_chunks()
        at = pa.array(rows, pa.int64())
        return pa.table(
            {
                "key": keys.take(at) if key_type is None else keys.take(at).cast(key_type),
                "start": pa.array([g[4] for g in got], pa.int64()),
                "length": pa.array([g[5] for g in got], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(np.frombuffer(p, "<u2").astype("<u4").tobytes()) for p in pieces], pa.int64()),
                "doc_tokens": pa.array(n[rows] if rows else [], pa.int64()),
                "sequence_id": pa.array([first + g[0] for g in got], pa.int64()),
                "offset": pa.array([g[1] for g in got], pa.int64()),
                "source": pa.array([sources[r] for r in rows], pa.string()),
                "ids": pa.array(pieces, pa.binary()),
            }
        )

    schema = f"key {dict(rows.dtypes)['key']}, {PIECES}, source string, ids binary"
    return tokens.groupBy("block").cogroup(plan.groupBy("block")).applyInArrow(run, schema).withColumnRenamed("key", key)
