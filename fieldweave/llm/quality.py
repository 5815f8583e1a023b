"""Quality rules and a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams fall into ``BUCKETS`` hash buckets.  Two multinomials are
counted over them: the trusted target (labelled rows of quality 1 that are not
toxic) and the raw corpus (every document).  A document's score is the mean over its
n-grams of log p(target) - log p(raw).  The threshold is fixed by the trusted rows
held out of the target counts: at most ``HELD_OUT_LOSS`` of them score below it.
Every document is then kept or rejected by comparison, nothing is drawn at random.

Counts cover all documents and all trusted rows.  Trusted ids are broadcast in blocks of
``TRUSTED_BLOCK``, counted beforehand; each block takes one scan of the documents, and the
blocks' counts are added up, so the result doesn't depend on them.

Defined results: null and empty texts have no words and fail the base rules; without
trusted rows there is no threshold and the base rules alone decide; repeated rows are
judged alike; a label's repeated rows count as their lowest quality and highest toxicity.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columnar as C
from .storage import discard, prepared, schema_with, written

BUCKETS = 1 << 16
#: Trusted ids that are broadcast at once, about.
TRUSTED_BLOCK = 1_000_000
#: Share of held-out trusted rows that the threshold may reject.
HELD_OUT_LOSS = 0.005
#: Added to every bucket's count.
SMOOTHING = 0.5
#: Cells of the held-out scores' histogram, and the scores it spans.
CELLS, LOW, HIGH = 8192, -8.0, 8.0

MIN_WORDS = 50
REPEAT_WINDOW = 3
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_NOT_NEWLINE = np.ones(256, dtype=bool)
_NOT_NEWLINE[0x0A] = False


def _repeated(key: np.ndarray, check: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(any: has an equal one in its row, later: an equal one stands before it), by place."""
    n = len(key)
    has, later = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    if n < 2:
        return has, later
    tagged = C.mixed(key + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(tagged, kind="stable")
    same = (tagged[order[1:]] == tagged[order[:-1]]) & (check[order[1:]] == check[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    has[order[1:][same]] = True
    later[order[1:][same]] = True
    has[order[:-1][same]] = True
    return has, later


def base_counts(data: np.ndarray, offsets: np.ndarray, words: C.Words, hashes: np.ndarray, second: np.ndarray) -> dict[str, np.ndarray]:
    """The base figures of each text: word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    rows = len(offsets) - 1
    visible = C.VISIBLE[data] & ((data & 0xC0) != 0x80)
    lines = C.Words(data, offsets, _NOT_NEWLINE)
    started = np.zeros(len(data) + 1, dtype=np.int64)
    started[1:][words.starts] = 1
    np.cumsum(started, out=started)
    spoken = started[lines.ends] > started[lines.starts]
    line_hash = [C.RollingHash.of_bytes(data, w).spans(lines.starts, lines.ends)[spoken] for w in (0, 1)]
    line_row = lines.row[spoken]
    at, h = words.windows(hashes, REPEAT_WINDOW)
    _, h2 = words.windows(second, REPEAT_WINDOW, 1)
    again, _ = _repeated(h, h2, words.row[at])
    hit = C.covered(at[again], REPEAT_WINDOW, len(words))
    return {
        "word_chars": C.per_row_sum(visible, offsets),
        "n_symbols": C.per_row_sum(_SYMBOLS[data], offsets),
        "n_dup_lines": np.bincount(line_row[_repeated(*line_hash, line_row)[1]], minlength=rows),
        "n_repeat_words": C.per_row_sum(hit, words.first),
    }


def _grams(words: C.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every unigram and bigram."""
    at, pairs = words.windows(hashes, 2)
    return np.concatenate([words.row, words.row[at]]), (np.concatenate([hashes, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def _trusted(labels: DataFrame, key: str) -> DataFrame:
    """key, held_out of all trusted rows."""
    good = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0")
    return good.select(key, (F.pmod(F.xxhash64(key), F.lit(2)) == 1).alias("held_out"))


def _blocks(rows: DataFrame, ids: DataFrame, key: str) -> list[DataFrame]:
    """The rows of the given ids, a table for each block of about TRUSTED_BLOCK ids; they are broadcast."""
    parts = max(1, -(-ids.count() // TRUSTED_BLOCK))
    block = F.pmod(F.shiftright(F.xxhash64(key), 1), F.lit(parts))
    return [rows.join(F.broadcast(ids.where(block == i).select(key)), key, "left_semi") for i in range(parts)]


def _count(tables: list[DataFrame], text: str) -> np.ndarray:
    """Counts by bucket over all the tables.  BUCKETS rows of each reach the driver."""

    def run(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in C.slices(batches, text):
            data, offsets = C.text_buffer(batch.column(0))
            words = C.Words(data, offsets, C.VISIBLE)
            total += np.bincount(_grams(words, words.hashes())[1], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, dtype=np.int64)
    for docs in tables:
        for r in docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            out[r["bucket"]] += r["n"]
    return out


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p(target) - log p(raw) of each bucket; 0 where nothing was trusted."""
    if not target.sum():
        return np.zeros(BUCKETS)
    p = [np.log(x + SMOOTHING) - math.log(x.sum() + SMOOTHING * BUCKETS) for x in (target, raw)]
    return p[0] - p[1]


FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def _scores(batch: pa.RecordBatch, text: int, ratio: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, the base figures and the score (0 for a text without words) of each row."""
    data, offsets = C.text_buffer(batch.column(text))
    words = C.Words(data, offsets, C.VISIBLE)
    hashes, second = words.hashes(), words.hashes(1)
    base = base_counts(data, offsets, words, hashes, second)
    row, bucket = _grams(words, hashes)
    n = np.bincount(row, minlength=batch.num_rows)
    return {"n_words": words.counts, **base, "score": np.bincount(row, weights=ratio[bucket], minlength=batch.num_rows) / np.maximum(n, 1)}


def _failed(found: dict[str, np.ndarray]) -> np.ndarray:
    return (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > 50 * found["n_words"])


def _threshold(held: list[DataFrame], text: str, ratio: np.ndarray) -> float:
    """The highest cell edge below which at most HELD_OUT_LOSS of the held-out rows of all tables lie; CELLS rows of each reach the driver."""
    shared = held[0].sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        for batch in C.slices(batches, text):
            score = _scores(batch, 0, shared.value)["score"]
            cell = np.clip(np.floor((score - LOW) / (HIGH - LOW) * CELLS), 0, CELLS - 1).astype(np.int64)
            at, n = np.unique(cell, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["cell", "n"])

    counts = np.zeros(CELLS, dtype=np.int64)
    for docs in held:
        for r in docs.select(text).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            counts[r["cell"]] += r["n"]
    if not counts.sum():
        return -math.inf
    below = np.concatenate([[0], np.cumsum(counts)])
    edge = int(np.flatnonzero(below <= HELD_OUT_LOSS * counts.sum())[-1])
    return LOW + (HIGH - LOW) * edge / CELLS if edge else -math.inf


def fitted(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float]:
    """(log ratio of each bucket, threshold), from counts over all documents and all trusted rows."""
    prepared(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    trusted = written(_trusted(labels.select(F.col(key).alias("key"), "quality", "toxic"), "key"), "trusted")
    ratio = log_ratio(_count([rows], "text"), _count(_blocks(rows, trusted.where("not held_out"), "key"), "text"))
    threshold = _threshold(_blocks(rows, trusted.where("held_out"), "key"), "text", ratio)
    discard(trusted)
    return ratio, threshold


FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, threshold double, base_failed boolean, kept boolean"


def quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the base figures, score, threshold, base_failed and kept of every row."""
    ratio, threshold = fitted(docs, labels, key=key, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    kept = [docs.schema[key]]

    def run(batches):
        for batch in C.slices(batches, "text"):
            found = _scores(batch, 1, shared.value)
            failed = _failed(found)
            columns = [*[pa.array(v if n == "score" else v.astype(np.int64)) for n, v in found.items()], pa.array(np.full(len(failed), threshold)), pa.array(failed), pa.array(~failed & (found["score"] >= threshold))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *found, "threshold", "base_failed", "kept"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema_with(kept, FEATURES))


def keep_good(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    ratio, threshold = fitted(docs, labels, key=key, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    at = docs.columns.index(text)
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # whatever the columns are called

    def run(batches):
        for batch in C.slices(batches, f"c{at}"):
            found = _scores(batch, at, shared.value)
            yield batch.filter(pa.array(~_failed(found) & (found["score"] >= threshold)))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
