"""MinHash near-duplicate groups with sequential Bayesian verification.

1. A document's set: hashes of its distinct shingles of ``shingle`` words.  Documents with
   equal sets collapse to one class.
2. ``HASHES`` minima make a signature; ``BANDS`` bands of ``ROWS`` minima are the LSH keys.
   A pair of similarity 0.8 misses every band with probability (1 - 0.8**5)**40 < 2e-7.
3. Every member of a band key is compared with the key's smallest member.  Signatures are
   compared in batches of ``BATCH`` minima; after each, a pair is dropped once the
   posterior probability (uniform prior) of similarity 0.8 falls below ``MISS``.
4. Where a key has members that its smallest member isn't like, those are compared with
   all members of that key in the same way, inside tasks that hold at most ``MEMBERS`` of
   a key a side.  The members that are like it need not meet each other.
5. Survivors link classes into clusters.  Inside a cluster candidate pairs are verified
   exactly on the full sets, best estimate first, skipping pairs already connected.  A
   cluster over ``MEMBERS`` is first verified in blocks that all hold its smallest node;
   only nodes that this leaves unconnected to it then meet all others.
6. Connected components of the exact links give the groups.

What may be lost: a pair of similarity 0.8 misses every band with probability under 2e-7.
``MISS`` is the posterior (uniform prior) at which a batch drops a pair; the chance that a
pair of exactly 0.8 agrees in too few minima for some batch is the sum of the binomial tails
below the counts of ``needed_matches``: 6e-6 (tested).

Defined results: null and empty texts have an empty set, link with nothing and are their
own group; a text of fewer words than a shingle is one shingle; equal documents share a
group; a null key takes part as the smallest integer and comes back null.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import columnar as C
from .storage import discard, spare, written

#: Words of a shingle unless given.
SHINGLE = 5
THRESHOLD = (80, 100)
ROWS, BANDS = 5, 40
HASHES = ROWS * BANDS
BATCH = 40
#: Posterior probability of reaching the threshold below which a batch drops a pair.
MISS = 1e-6
#: Members of a key, or of a cluster, that meet in one task.
MEMBERS = 1024
#: Rows of small keys that share a task.
TOGETHER = 2048
#: Links of what is left of the components that one task joins.
LAST_LINKS = 20_000
_NULL = -(2**63)
_PRIME = np.uint32(0x9E3779B1)

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def needed_matches(threshold: float = THRESHOLD[0] / THRESHOLD[1], miss: float = MISS) -> list[tuple[int, int]]:
    """(minima compared, fewest matches that still give similarity >= threshold a posterior of ``miss``) after each batch."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        low = 0
        for m in range(n + 1):
            logs = m * np.log(grid) + (n - m) * np.log1p(-grid)
            weight = np.exp(logs - logs.max())
            if weight[grid >= threshold].sum() >= miss * weight.sum():
                low = m
                break
        out.append((n, low))
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, offsets) of each text."""
    words = C.Words(data, offsets, C.VISIBLE)
    hashes = words.hashes(lower=True)
    at, h = words.windows(hashes, width)
    row = words.row[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        whole = C.RollingHash(hashes).spans(words.first[short], words.first[short + 1])
        row, h = np.concatenate([row, short]), np.concatenate([h, whole])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    out = np.zeros(len(offsets), dtype=np.int64)
    np.cumsum(np.bincount(row[fresh], minlength=len(offsets) - 1), out=out[1:])
    return h[fresh], out


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minima by text (rows) and hash function (columns); empty sets have the largest value."""
    rows = len(offsets) - 1
    out = np.full((rows, HASHES), np.iinfo(np.uint32).max, dtype=np.uint32)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if not len(full):
        return out
    x = (sets >> np.uint64(32)).astype(np.uint32)
    starts = offsets[full]
    for j in range(HASHES):
        y = x * _MULTIPLY[j]
        y += _ADD[j]
        y ^= y >> np.uint32(15)
        out[full, j] = np.minimum.reduceat(y, starts)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key by text and band."""
    keys = np.empty((len(sig), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        k = np.full(len(sig), b + 1, dtype=np.uint64)
        for j in range(ROWS):
            k = C.mixed(k * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * ROWS + j].astype(np.uint64))
        keys[:, b] = k
    return keys


def survive(a: np.ndarray, b: np.ndarray, needed: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(places, matches) of the row pairs of two signature arrays that no batch drops."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), dtype=np.int64)
    done = 0
    for n, low in needed:
        matches[alive] += (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
        alive = alive[matches[alive] >= low]
        done = n
        if not len(alive):
            break
    return alive, matches[alive]


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """k, c, n (set size), digest of the set, sig (binary, 16 bits a minimum) of rows (k, c, text)."""

    def run(batches):
        step = 2 * HASHES
        for batch in C.slices(batches, "text"):
            sets, at = shingle_sets(*C.text_buffer(batch.column(2)), shingle)
            raw = sets.tobytes()
            digest = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            small = signatures(sets, at).astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at)), pa.array(digest, pa.binary()), pa.array([small[i * step : (i + 1) * step] for i in range(batch.num_rows)], pa.binary())], names=["k", "c", "n", "digest", "sig"])

    return docs.mapInArrow(run, "k long, c long, n long, digest binary, sig binary")


def _band_rows(sigs: DataFrame) -> DataFrame:
    """key, x: the LSH keys of each class."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys = band_keys(_matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], names=["key", "x"])

    return sigs.select("node", "sig").mapInArrow(run, "key long, x long")


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures of a binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, _ = C.text_buffer(column)
    return data.view("<u2").reshape(-1, HASHES)


def _dealt(df: DataFrame, key: str, member: str, members: int, rows: int, together: int = TOGETHER) -> DataFrame:
    """Rows (key, member, size, n_loose, loose, ...) dealt to groups, with i, j, side and task.

    Loose rows are to meet every row of their key, the others have met each other already.
    A key of up to ``members`` rows is one group (side 2).  In a larger one the loose rows are
    cut into blocks i and all rows into blocks j; a group is one of either (sides 0 and 1), so
    work grows with loose x size, not with size x size.  About ``together`` of the ``rows``
    rows share a task.
    """
    number = lambda n: F.ceil(F.col(n) / members).cast("int")
    own = lambda n: F.pmod(F.xxhash64(member), number(n)).cast("int")
    place = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    upto = lambda n: F.sequence(F.lit(0), number(n) - 1)
    left = F.transform(upto("size"), lambda j: place(own("n_loose"), j, 0))
    right = F.transform(upto("n_loose"), lambda i: place(i, own("size"), 1))
    groups = F.when(F.col("size") <= members, F.array(place(F.lit(0), F.lit(0), 2))).when(F.col("loose"), F.concat(left, right)).otherwise(right)
    tasks = max(1, -(-rows // together))
    spread = F.when(F.col("size") <= members, F.pmod(F.xxhash64(key), F.lit(tasks))).otherwise(F.xxhash64(key, "i", "j"))
    return df.select("*", F.inline(groups)).withColumn("task", spread)


def _groups(table: pa.Table, key: str, member: str):
    """Yield for each (key, i, j) of a task's table: one row of every member, and whether it stands left and right."""
    columns = [table.column(c).to_numpy() for c in (key, "i", "j")]
    names, side = table.column(member).to_numpy(), table.column("side").to_numpy()
    loose = np.asarray(table.column("loose").to_numpy(zero_copy_only=False), dtype=bool)
    order = np.lexsort(columns[::-1])
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    at = np.append(np.flatnonzero(fresh), len(order))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        rows = order[a:b]
        _, one, back = np.unique(names[rows], return_index=True, return_inverse=True)
        left, right = np.zeros(len(one), dtype=bool), np.zeros(len(one), dtype=bool)
        left[back[(side[rows] != 1) & loose[rows]]] = True
        right[back[side[rows] != 0]] = True
        yield rows[one], left, right


def _linked(sig: np.ndarray, left: np.ndarray, right: np.ndarray, label: np.ndarray, needed: list[tuple[int, int]], same=None):
    """Yield links (i, j) of left rows with right ones that join what isn't joined yet.

    label: rows of one label are joined already (changed in place).  Candidates that no batch
    of minima drops are tried best estimate first, and verified by ``same`` where given.
    """
    for i in np.flatnonzero(left).tolist():
        others = np.flatnonzero(right & (label != label[i]))
        if right[i]:  # both ways are one pair
            others = others[~left[others] | (others > i)]
        others = others[(sig[others, : needed[0][0]] == sig[i, : needed[0][0]]).sum(axis=1) >= needed[0][1]]
        if not len(others):
            continue
        alive, matches = survive(np.broadcast_to(sig[i], (len(others), HASHES)), sig[others], needed)
        for j in others[alive][np.argsort(-matches, kind="stable")].tolist():
            if label[i] != label[j] and (same is None or same(i, j)):
                label[label == label[j]] = label[i]
                yield i, j


def _star(pairs: DataFrame, sigs: DataFrame, needed: list[tuple[int, int]]) -> DataFrame:
    """(x, lead) with like: whether the pair survives."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            alive, _ = survive(_matrix(batch.column(2)), _matrix(batch.column(3)), needed)
            like = np.zeros(batch.num_rows, dtype=bool)
            like[alive] = True
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(like)], names=["x", "lead", "like"])

    both = pairs.join(sigs.select(F.col("node").alias("x"), F.col("sig").alias("sx")), "x").join(sigs.select(F.col("node").alias("lead"), F.col("sig").alias("sl")), "lead")
    return both.select("x", "lead", "sx", "sl").mapInArrow(run, "x long, lead long, like boolean")


def _pairs(found: list[tuple[int, int]], names: np.ndarray) -> pa.Table:
    at = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(names[at[:, 0]], pa.int64()), "b": pa.array(names[at[:, 1]], pa.int64())})


def _rest(stars: DataFrame, sigs: DataFrame, needed: list[tuple[int, int]], members: int) -> DataFrame:
    """Links (a, b) among the members of keys whose smallest member isn't like all the others.

    The smallest member itself has met all of them.  Those like it are joined to begin with.
    """
    mixed = written(stars.groupBy("key").agg(F.count("*").alias("size"), F.sum((~F.col("like")).cast("int")).alias("n_loose")).where("size > 1 and n_loose > 0"), "mixed-keys")
    total = mixed.agg(F.sum("size").alias("n")).first()["n"] or 0
    rows = stars.join(mixed, "key").select("key", "size", "n_loose", "x", (~F.col("like")).alias("loose")).join(sigs.select(F.col("node").alias("x"), "sig"), "x")

    def run(table: pa.Table) -> pa.Table:
        sig, x, loose = _matrix(table.column("sig")), table.column("x").to_numpy(), np.asarray(table.column("loose").to_numpy(zero_copy_only=False), dtype=bool)
        found = []
        for at, left, right in _groups(table, "key", "x"):
            label = np.where(loose[at], np.arange(len(at)), -1)
            found += [(at[i], at[j]) for i, j in _linked(sig[at], left, right, label, needed)]
        return _pairs(found, x)

    dealt = _dealt(rows, "key", "x", members, total)
    return dealt.select("task", "key", "i", "j", "side", "x", "loose", "sig").groupBy("task").applyInArrow(run, "a long, b long")


def _joined(batches):
    """node, to: the smallest node that each node of links (a, b) reaches."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "to"])


def components(links: DataFrame, *, name: str = "components") -> DataFrame:
    """node, component (smallest node reachable) of every node in links (a, b).

    Each round every node moves to the least of its neighbours and itself, and once more from
    there, by an order drawn anew each round; links between nodes that moved to one place go.
    So the links shrink in every round, and a chain or a star takes few of them.  The last
    ``LAST_LINKS`` are joined in one task.
    """
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    links = written(links.where("a <> b").select(*ends).distinct(), name)
    moves: list[DataFrame] = []
    while not links.isEmpty():
        if links.limit(LAST_LINKS + 1).count() <= LAST_LINKS:
            moves.append(written(links.coalesce(1).mapInArrow(_joined, "node long, to long"), name))
            break
        order = lambda c, seed=len(moves): F.struct(F.xxhash64(F.lit(seed), c).alias("h"), F.col(c).alias("to"))
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("m"))
        step = written(least.select("node", F.least("m", order("node"))["to"].alias("to")), name)
        move = written(step.join(step.select(F.col("node").alias("to"), F.col("to").alias("further")), "to").select("node", F.col("further").alias("to")), name)
        moves.append(move)
        shown = links
        for end in ("a", "b"):
            shown = shown.join(move.withColumnsRenamed({"node": end, "to": f"to_{end}"}), end)
        before, links = links, written(shown.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).where("a <> b").select(*ends).distinct(), name)
        discard(before, step)
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    place = moves[-1]
    for move in moves[-2::-1]:
        place = move.join(place.select(F.col("node").alias("to"), F.col("to").alias("end")), "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    place = written(place, name)
    discard(links, *moves)
    return place.join(place.groupBy("to").agg(F.min("node").alias("component")), "to").select("node", "component")


def _verified(clusters: DataFrame, rows: DataFrame, needed: list[tuple[int, int]], members: int, shingle: int) -> DataFrame:
    """Exact links (a, b) inside clusters (node, component, k, c); rows: k, c, text of the documents, each once.

    A cluster of up to ``members`` nodes is verified in one task.  A larger one first in
    blocks, each with the cluster's smallest node; nodes that this leaves unconnected to it
    then meet all others.
    """
    up, down = THRESHOLD

    def run(table: pa.Table) -> pa.Table:
        texts, nodes, found = table.column("text").combine_chunks(), table.column("node").to_numpy(), []
        labels = table.column("label").to_numpy()
        for at, left, right in _groups(table, "key", "node"):
            sets, ends = shingle_sets(*C.text_buffer(texts.take(pa.array(at))), shingle)

            def same(i: int, j: int, sets=sets, ends=ends) -> bool:
                one, two = sets[ends[i] : ends[i + 1]], sets[ends[j] : ends[j + 1]]
                if down * min(len(one), len(two)) < up * max(len(one), len(two)):
                    return False  # sizes alone rule it out
                both = int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum())
                return down * both >= up * (len(one) + len(two) - both)

            found += [(at[i], at[j]) for i, j in _linked(signatures(sets, ends).astype("<u2"), left, right, labels[at].copy(), needed, same)]
        return _pairs(found, nodes)

    def links(dealt: DataFrame) -> DataFrame:
        return dealt.select("task", "key", "i", "j", "side", "node", "loose", "label", "text").groupBy("task").applyInArrow(run, "a long, b long")

    sizes = written(clusters.groupBy("component").agg(F.count("*").alias("size")), "cluster-sizes")
    total = sizes.agg(F.sum("size").alias("n")).first()["n"] or 0
    texts = rows.join(clusters.join(sizes, "component").hint("shuffle_hash"), ["k", "c"]).select("component", "size", "node", "text")
    large = not sizes.where(F.col("size") > members).isEmpty()
    if large:
        texts = written(texts, "cluster-texts")
    # The smallest node goes to every block of its cluster.
    blocks = F.ceil(F.col("size") / members).cast("int")
    block = F.when(F.col("node") == F.col("component"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), blocks).cast("int")))
    tasks = max(1, -(-total // TOGETHER))
    first = texts.select("*", F.explode(block).alias("i")).withColumns({"key": F.col("component"), "j": F.lit(0), "side": F.lit(2), "loose": F.lit(True), "label": F.col("node")})
    spread = F.when(F.col("size") <= members, F.pmod(F.xxhash64("key"), F.lit(tasks))).otherwise(F.xxhash64("key", "i"))
    found = links(first.withColumn("task", spread))
    if not large:
        return found
    found = written(found, "cluster-links")
    inside = components(found, name="cluster-groups").withColumnRenamed("component", "label")
    left = texts.where(F.col("size") > members).join(inside, "node", "left").withColumn("label", F.coalesce("label", "node"))
    left = left.withColumn("loose", F.col("label") != F.col("component")).withColumn("key", F.col("component"))
    loose = left.where("loose").groupBy("key").agg(F.count("*").alias("n_loose"))
    return found.unionByName(links(_dealt(left.join(loose, "key"), "key", "node", members, total)))


def _document(key: str, text: str) -> list:
    """k and c, which name a document: its key (a null one as the smallest integer) and a digest of its text."""
    return [F.coalesce(F.col(key).cast("long"), F.lit(_NULL)).alias("k"), F.xxhash64(F.coalesce(F.col(text).cast("binary"), F.lit(b""))).alias("c")]


def _once(df: DataFrame, k: str, c: str, exempt: str | None = None) -> DataFrame:
    """The first row of each document in a task; rows marked ``exempt`` all stay.

    Before a shuffle by document this leaves no more rows of one than there are tasks.
    """
    names = [n for n in (k, c, exempt) if n]

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
            keep = []
            for i, (name, free) in enumerate(zip(zip(*columns[:2], strict=True), columns[2] if exempt else [False] * batch.num_rows, strict=True)):
                if free or name not in seen:
                    keep.append(i)
                    if not free:
                        seen.add(name)
            yield batch.take(pa.array(keep, pa.int64()))

    return df.mapInArrow(run, df.schema)


def _grouped(docs: DataFrame, key: str, text: str, members: int, shingle: int) -> tuple[DataFrame, DataFrame, bool]:
    """(k, c, n, digest of every row; digest, k, c, component of every class, k and c being its smallest document; whether a document has several rows)."""
    rows = docs.select(*_document(key, text), F.col(text).alias("text"))
    needed = needed_matches()
    signed = written(_signed(rows, shingle), "signatures")
    again = not signed.groupBy("k", "c").count().where("count > 1").isEmpty()
    classes = signed.where("n > 0").groupBy("digest").agg(F.min(F.struct("k", "c")).alias("rep"), F.first("sig").alias("sig"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("rep.k").alias("k"), F.col("rep.c").alias("c"), "sig"), "classes")
    sigs = classes.select("node", "sig")
    keys = _band_rows(sigs)
    leads = keys.groupBy("key").agg(F.min("x").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead")
    stars = written(keys.join(leads, "key").where("x <> lead"), "band-stars")
    like = written(_star(stars.select("x", "lead").distinct(), sigs, needed), "star-pairs")
    links = like.where("like").select(F.col("x").alias("a"), F.col("lead").alias("b")).unionByName(_rest(stars.join(like, ["x", "lead"]), sigs, needed, members))
    clusters = written(components(links, name="clusters").join(classes.select("node", "k", "c"), "node"), "cluster-members")
    single = _once(rows, "k", "c") if again else rows
    groups = components(_verified(clusters, single, needed, members, shingle), name="groups")
    discard(stars, like, clusters)
    # A class without links is a group of its own.
    named = classes.select("node", "digest", "k", "c").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return signed.select("k", "c", "n", "digest"), named, again


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", members: int = MEMBERS, shingle: int = SHINGLE) -> DataFrame:
    """key, n_shingles, component_id, kept of every row; a group goes by its smallest key, which kept compares with the row's."""
    kind = dict(docs.dtypes)[key]
    signed, named, _ = _grouped(docs, key, text, members, shingle)
    names = named.groupBy("component").agg(F.min("k").alias("component_id"))
    by_digest = named.join(names, "component").select("digest", "component_id")
    out = signed.select("k", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(by_digest, "digest", "left")
    out = out.select("k", F.col("n").alias("n_shingles"), F.coalesce("component_id", "k").alias("component_id"))
    return out.select(F.when(F.col("k") != _NULL, F.col("k")).cast(kind).alias(key), "n_shingles", F.when(F.col("component_id") != _NULL, F.col("component_id")).alias("component_id"), (F.col("k") == F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text", members: int = MEMBERS, shingle: int = SHINGLE) -> DataFrame:
    """One document of each group, with all its columns: the one of the smallest key and, under that key, the smallest text digest.

    Rows count by key and text: unlike texts under one key or none are documents of their own, rows equal
    in both are one.  A text without words is kept once for each key, and in every row without a key.
    """
    signed, named, again = _grouped(docs, key, text, members, shingle)
    first = named.groupBy("component").agg(F.min(F.struct("k", "c")).alias("rep")).select("rep.k", "rep.c")
    k, c, free, row = spare(docs.columns, "k", "c", "free", "row")
    kept = first.unionByName(signed.where("n = 0").select("k", "c").distinct()).withColumnsRenamed({"k": k, "c": c})
    rows = docs.select("*", *[d.alias(n) for d, n in zip(_document(key, text), (k, c), strict=True)])
    if not again:
        return rows.join(kept.hint("shuffle_hash"), [k, c], "left_semi").select(*docs.columns)
    loose = F.col(key).isNull() & (F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")) == "")
    rows = _once(rows.withColumn(free, loose), k, c, free).join(kept.hint("shuffle_hash"), [k, c], "left_semi")
    return rows.withColumn(row, F.when(F.col(free), F.monotonically_increasing_id())).dropDuplicates([k, c, row]).select(*docs.columns)
