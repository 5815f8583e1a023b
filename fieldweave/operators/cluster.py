"""Clustering of vectors: centroids, silhouettes, average linkage and density clusters.

Linkage and density clustering look at all pairs of their points.  Up to ``MOST_POINTS``
points one task does that.  Of more, tasks search the nearest ``NEAR`` others of every point,
a block of rows against the broadcast points; no pair is kept but those.  The driver holds
the points and these lists (a few hundred bytes a point) and merges as far as a list is
known to hold what is asked: all that it lacks is farther than its last entry.  Points
whose list is used up are searched again.  Results are those of all pairs.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Points up to which one task takes all pairs.
MOST_POINTS = 2_000
#: Nearest others that are kept of a point.
NEAR = 16
#: Rows and columns of a block of distances.
ROWS, COLUMNS = 512, 8192
#: Distances up to which the driver searches by itself.
AT_DRIVER = 20_000_000


def centroids(df: DataFrame, *, cls: str, vec: str) -> DataFrame:
    """class, size, centroid: mean of unit vectors, normalised again."""
    rows = df.where(F.col(cls).isNotNull()).select(F.col(cls).alias("class"), F.posexplode(V.unit(F.col(vec))).alias("i", "x"))
    means = rows.groupBy("class", "i").agg(F.avg("x").alias("m"), F.count("*").alias("size"))
    gathered = means.groupBy("class").agg(F.max("size").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    return gathered.select("class", "size", V.unit(F.col("mean")).alias("centroid"))


def representatives(df: DataFrame, *, cls: str, vec: str, key: str) -> DataFrame:
    """class, key, score: the member closest to its class's centroid, ties to the smallest key."""
    c = centroids(df, cls=cls, vec=vec).select("class", "centroid")
    scored = df.select(F.col(cls).alias("class"), F.col(key).alias("key"), V.unit(F.col(vec)).alias("u")).join(c, "class").select("class", "key", V.dot(F.col("u"), F.col("centroid")).alias("score"))
    best = scored.groupBy("class").agg(F.min(F.struct((-F.col("score")).alias("s"), "key")).alias("b"))
    return best.select("class", F.col("b.key").alias("key"), (-F.col("b.s")).alias("score"))


def silhouette(df: DataFrame, *, cls: str, vec: str, key: str) -> DataFrame:
    """One row with the mean cosine silhouette.

    The mean cosine distance from a point to a class is one minus the dot product with the
    class's mean unit vector, so sums per class replace all pairs.
    """
    unit = df.where(F.col(cls).isNotNull()).select(F.col(key).alias("key"), F.col(cls).alias("class"), V.unit(F.col(vec)).alias("u"))
    sums = unit.select("class", F.posexplode("u").alias("i", "x")).groupBy("class", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    sums = sums.groupBy("class").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda s: s["s"]).alias("sum"))
    other = sums.select(F.col("class").alias("other"), "n", "sum")
    pairs = unit.crossJoin(F.broadcast(other)).select("key", "class", "other", "n", V.dot(F.col("u"), F.col("sum")).alias("d"), V.dot(F.col("u"), F.col("u")).alias("self"))
    own = F.max(F.when((F.col("other") == F.col("class")) & (F.col("n") > 1), (F.col("n") - 1 - (F.col("d") - F.col("self"))) / (F.col("n") - 1)))
    near = F.min(F.when(F.col("other") != F.col("class"), 1 - F.col("d") / F.col("n")))
    ab = pairs.groupBy("key").agg(own.alias("a"), near.alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return ab.agg(F.avg(s).alias("silhouette"))


# ---- numpy, for one bounded set ----


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + V.EPSILON)


def average_linkage(x: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, distance) of average linkage under cosine distance, by rising distance; clusters go by their smallest point.

    Nearest-neighbour chains: O(n**2) time after the distances.
    """
    n = len(x)
    d = 1 - unit_rows(x) @ unit_rows(x).T
    np.fill_diagonal(d, np.inf)
    size, alive, chain, merges = np.ones(n), np.ones(n, dtype=bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        a = chain[-1]
        row = np.where(alive, d[a], np.inf)
        b = int(np.argmin(row))
        if len(chain) > 1 and row[chain[-2]] <= row[b]:
            b = chain[-2]
            chain = chain[:-2]
            keep, gone = min(a, b), max(a, b)
            merges.append((keep, gone, float(row[b])))
            mean = (size[keep] * d[keep] + size[gone] * d[gone]) / (size[keep] + size[gone])
            d[keep], d[:, keep] = mean, mean
            d[keep, keep] = np.inf
            size[keep] += size[gone]
            alive[gone] = False
        else:
            chain.append(b)
    return sorted(merges, key=lambda m: m[2])


def cut(merges: list[tuple[int, int, float]], n: int, k: int) -> np.ndarray:
    """Labels 0..k-1 (by first member) after the first n - k merges."""
    up = list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b, _ in merges[: max(n - k, 0)]:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    roots = [root(i) for i in range(n)]
    number = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    return np.array([number[r] for r in roots])


def silhouette_of(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean cosine silhouette of labelled points."""
    u = unit_rows(x)
    k = labels.max() + 1
    sums, n = np.zeros((k, u.shape[1])), np.bincount(labels, minlength=k)
    np.add.at(sums, labels, u)
    d = u @ sums.T
    own, rows = n[labels], np.arange(len(u))
    a = (own - 1 - (d[rows, labels] - (u * u).sum(1))) / np.maximum(own - 1, 1)
    far = 1 - d / np.maximum(n, 1)
    far[rows, labels] = np.inf
    b = far.min(axis=1)
    return float(np.where(own > 1, (b - a) / np.maximum(a, b), 0.0).mean())


def choose_k(x: np.ndarray, k: int = 0, kmin: int = 25, kmax: int = 60, merges: list[tuple[int, int, float]] | None = None) -> tuple[int, np.ndarray]:
    """(K, labels): a given K over 1, else the first of the best silhouette; one dendrogram serves every K."""
    merges, n = average_linkage(x) if merges is None else merges, len(x)
    if k > 1:
        return k, cut(merges, n, min(k, n))
    best = (-np.inf, 1, np.zeros(n, dtype=int))
    for trial in range(max(2, kmin), min(kmax, n - 1) + 1):
        labels = cut(merges, n, trial)
        score = silhouette_of(x, labels)
        if score > best[0]:
            best = (score, trial, labels)
    return best[1], best[2]


def density_labels(x: np.ndarray, min_cluster_size: int = 20, min_samples: int | None = None) -> np.ndarray:
    """Hierarchical density clusters (excess of mass), -1 for outliers.

    Mutual reachability distances, their minimum spanning tree, the condensed tree, and
    the set of clusters of largest total stability (Campello, Moulavi and Sander, 2013).
    """
    x = np.asarray(x, dtype=np.float64)
    n, m = len(x), min_cluster_size
    if n < 2 or n < m:
        return np.full(n, -1)
    square = (x * x).sum(1)
    d = np.sqrt(np.maximum(square[:, None] + square - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    core = np.partition(d, min((min_samples or m), n) - 1, axis=1)[:, min((min_samples or m), n) - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core))
    left, near, to, edges = np.ones(n, dtype=bool), np.full(n, np.inf), np.zeros(n, dtype=int), []
    at = 0
    for _ in range(n - 1):
        left[at] = False
        closer = left & (reach[at] < near)
        near[closer], to[closer] = reach[at][closer], at
        nxt = int(np.argmin(np.where(left, near, np.inf)))
        edges.append((float(near[nxt]), int(to[nxt]), nxt))
        at = nxt
    return condensed(edges, n, m)


def condensed(edges: list[tuple[float, int, int]], n: int, m: int) -> np.ndarray:
    """Labels of the n points of a minimum spanning tree: clusters of m points or more of largest total stability, -1 for outliers."""
    edges = sorted(edges)
    up, node, children, weight, count = list(range(n)), list(range(n)), {}, {}, dict.fromkeys(range(n), 1)

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    # Edges of one weight join at once: which of several such trees it is makes no difference.
    new = n
    for w, group in groupby(edges, lambda e: e[0]):
        joined: dict[int, list[int]] = {}
        for _, a, b in group:
            a, b = root(a), root(b)
            parts = sorted((joined.pop(a, [node[a]]), joined.pop(b, [node[b]])), key=len, reverse=True)
            parts[0].extend(parts[1])
            up[b], joined[a] = a, parts[0]
        for a, parts in joined.items():
            children[new], weight[new], count[new] = parts, w, sum(count[j] for j in parts)
            node[a] = new
            new += 1

    def leaves(i: int) -> list[int]:
        out, todo = [], [i]
        while todo:
            j = todo.pop()
            if j < n:
                out.append(j)
            else:
                todo += children[j]
        return out

    top = max(children)
    born, stability, kids, members = {0: 0.0}, {0: 0.0}, {0: []}, {0: []}
    todo = [(top, 0)]
    while todo:
        i, c = todo.pop()
        if i < n:
            continue
        lam = 1 / weight[i] if weight[i] > 0 else 1e12
        big = [j for j in children[i] if count[j] >= m]
        for j in children[i]:
            if count[j] < m:
                points = leaves(j)
                stability[c] += len(points) * (lam - born[c])
                members[c] += points
        if len(big) > 1:
            for j in big:
                stability[c] += count[j] * (lam - born[c])
                new = len(born)
                born[new], stability[new], kids[new], members[new] = lam, 0.0, [], []
                kids[c].append(new)
                todo.append((j, new))
        elif big:
            todo.append((big[0], c))
    chosen: dict[int, bool] = {}
    value = dict(stability)
    for c in sorted(born, reverse=True):
        below = sum(value[k] for k in kids[c])
        chosen[c] = c != 0 and value[c] >= below
        value[c] = max(value[c], below)
    labels = np.full(n, -1)
    number, todo2 = 0, [0]
    picked = []
    while todo2:
        c = todo2.pop(0)
        if chosen[c]:
            picked.append(c)
        else:
            todo2 += kids[c]
    for c in picked:
        under = [c]
        while under:
            k = under.pop()
            labels[members[k]] = number
            under += kids[k]
        number += 1
    # Called by their first points: a tree's edges may come from either end.
    names, first = np.unique(labels[labels >= 0], return_index=True)
    named = np.empty(len(names), dtype=int)
    named[np.argsort(first)] = np.arange(len(names))
    labels[labels >= 0] = named[labels[labels >= 0]]
    return labels


# ---- more points than one task takes ----


def _spread(spark, rows: np.ndarray, wide: int, run) -> list:
    """What run gives for blocks of rows, in order: in tasks, or here where there is little to do."""
    blocks = np.array_split(rows, max(1, -(-len(rows) // ROWS)))
    if len(rows) * wide <= AT_DRIVER:
        return [run(b) for b in blocks]
    sc = spark.sparkContext
    return sc.parallelize(blocks, min(len(blocks), 4 * sc.defaultParallelism)).map(run).collect()


def _nearest(spark, x: np.ndarray, rows: np.ndarray, most: int, cosine: bool) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances from the nearest on) of the ``most`` nearest other points of some rows: one minus the dot product, or Euclidean."""
    most = min(most, len(x) - 1)
    shared = spark.sparkContext.broadcast(x)

    def run(block):
        points = shared.value
        q = points[block]
        place, dist = np.zeros((len(block), most), dtype=np.int64), np.full((len(block), most), np.inf)
        for s in range(0, len(points), COLUMNS):
            part = points[s : s + COLUMNS]
            d = q @ part.T
            d = 1 - d if cosine else (q * q).sum(1)[:, None] + (part * part).sum(1) - 2 * d
            own = np.flatnonzero((block >= s) & (block < s + len(part)))
            d[own, block[own] - s] = np.inf
            d, at = np.concatenate([dist, d], axis=1), np.concatenate([place, np.broadcast_to(np.arange(s, s + len(part)), d.shape)], axis=1)
            first = np.argpartition(d, most - 1, axis=1)[:, :most]
            dist, place = np.take_along_axis(d, first, axis=1), np.take_along_axis(at, first, axis=1)
        # Distances of few pairs, each by itself: the same from both ends.
        pairs = np.einsum("ijk,ik->ij", points[place], q) if cosine else ((points[place] - q[:, None]) ** 2).sum(2)
        dist = 1 - pairs if cosine else np.sqrt(pairs)
        order = np.lexsort((place, dist), axis=1)
        return np.take_along_axis(place, order, axis=1), np.take_along_axis(dist, order, axis=1)

    found = _spread(spark, rows, len(x), run)
    shared.destroy()
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def linkage_of_many(spark, x: np.ndarray) -> list[tuple[int, int, float]]:
    """``average_linkage`` without the distances of all pairs.

    The distance of two clusters is one minus the dot product of their mean unit vectors.
    Clusters that are each other's nearest are merged, many at once: under average linkage
    no merge brings a cluster nearer to others than its parts were, so a list's last
    distance stays a bound for all that it lacks.
    """
    u = unit_rows(x)
    _, first, copy = np.unique(u, axis=0, return_index=True, return_inverse=True)
    copy, first = copy.ravel(), first
    order = np.argsort(first)  # equal points are one cluster from the start, called by the first of them
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.arange(len(order))
    ids, of = first[order], number[copy]
    merges = [(int(ids[c]), i, 0.0) for i, c in enumerate(of.tolist()) if ids[c] != i]
    size, mean = np.bincount(of).astype(np.float64), u[ids]
    n = len(ids)
    if n < 2:
        return merges
    near, dist = np.full((n, NEAR), -1), np.full((n, NEAR), np.inf)
    bound, alive, now = np.full(n, -np.inf), np.arange(n), np.arange(n)  # now: the cluster that a cluster has become part of

    def searched(rows: np.ndarray) -> None:
        place, d = _nearest(spark, mean[alive], np.searchsorted(alive, rows), NEAR, True)
        k = d.shape[1]
        near[rows], dist[rows] = -1, np.inf
        near[rows, :k], dist[rows, :k] = alive[place], d
        bound[rows] = d[:, -1] if len(alive) - 1 > k else np.inf

    searched(alive)
    while len(alive) > 1:
        part_d, part_n = dist[alive], near[alive]
        low = part_d.min(axis=1)
        best = np.where(part_d == low[:, None], part_n, n).min(axis=1)  # ties to the first
        sure = (low <= bound[alive]) & (low < np.inf)
        to = np.full(n, -1)
        to[alive[sure]] = best[sure]
        a = alive[sure]
        a = a[(to[to[a]] == a) & (a < to[a])]
        if not len(a):
            searched(alive[~sure])
            continue
        b = to[a]
        d = dist[a].min(axis=1)
        merges += list(zip(ids[a].tolist(), ids[b].tolist(), d.tolist(), strict=True))
        mean[a] = (size[a, None] * mean[a] + size[b, None] * mean[b]) / (size[a] + size[b])[:, None]
        size[a] += size[b]
        now[b] = a
        gone = np.zeros(n, dtype=bool)
        gone[b] = True
        alive = alive[~gone[alive]]
        changed = gone
        changed[a] = True
        # A new cluster's list: both lists, the nearest first; what goes from it lowers its bound.
        both = np.concatenate([near[a], near[b]], axis=1)
        both[both >= 0] = now[both[both >= 0]]
        both[both == a[:, None]] = -1
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        far = np.where(both >= 0, 1 - np.einsum("ijk,ik->ij", mean[both], mean[a]), np.inf)
        at = np.argsort(far, axis=1, kind="stable")
        both, far = np.take_along_axis(both, at, axis=1), np.take_along_axis(far, at, axis=1)
        bound[a] = np.minimum(np.minimum(bound[a], bound[b]), far[:, NEAR])
        near[a], dist[a] = both[:, :NEAR], far[:, :NEAR]
        # Other lists: entries that became part of a new cluster.
        held = near[alive]
        r, c = np.nonzero((held >= 0) & changed[held])
        rows, new = alive[r], now[held[r, c]]
        near[rows, c] = new
        dist[rows, c] = np.where(new == rows, np.inf, 1 - np.einsum("ij,ij->i", mean[new], mean[rows]))
    return sorted(merges, key=lambda m: m[2])


def tree_of_many(spark, x: np.ndarray, samples: int) -> list[tuple[float, int, int]]:
    """Edges (weight, a, b) of a minimum spanning tree of mutual reachability distances, by Boruvka's rounds over lists of nearest points.

    A component's shortest way out is known once no point of it can have a shorter one
    outside its list; else those points are searched, those of the largest component last.
    """
    x = np.ascontiguousarray(x, dtype=np.float64)
    n, everyone = len(x), np.arange(len(x))
    near, dist = _nearest(spark, x, everyone, max(samples - 1, 0) + NEAR, False)
    core = dist[:, samples - 2] if samples > 1 else np.zeros(n)
    weight = np.maximum(np.maximum(core[:, None], core[near]), dist)
    bound = np.maximum(core, dist[:, -1]) if near.shape[1] < n - 1 else np.full(n, np.inf)
    near, weight = np.concatenate([near, np.full((n, 1), -1)], axis=1), np.concatenate([weight, np.full((n, 1), np.inf)], axis=1)  # the last: what a search found
    part, edges = everyone.copy(), []

    def searched(rows: np.ndarray) -> None:
        shared = spark.sparkContext.broadcast((x, core, part))

        def run(block):
            points, c, p = shared.value
            q = points[block]
            to, low = np.zeros(len(block), dtype=np.int64), np.full(len(block), np.inf)
            for s in range(0, n, COLUMNS):
                cut = slice(s, s + COLUMNS)
                d = (q * q).sum(1)[:, None] + (points[cut] * points[cut]).sum(1) - 2 * q @ points[cut].T
                d = np.maximum(np.maximum(np.sqrt(np.maximum(d, 0)), c[block][:, None]), c[cut])
                d[p[block][:, None] == p[cut]] = np.inf
                at = d.argmin(axis=1)
                better = d[np.arange(len(block)), at] < low
                to[better], low[better] = at[better] + s, d[np.arange(len(block)), at][better]
            true = np.maximum(np.maximum(np.sqrt(((points[to] - q) ** 2).sum(1)), c[block]), c[to])
            return to, true

        found = _spread(spark, rows, n, run)
        shared.destroy()
        near[rows, -1], weight[rows, -1] = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        bound[rows] = np.maximum(bound[rows], weight[rows, -1])

    while True:
        names, part = np.unique(part, return_inverse=True)
        k = len(names)
        if k == 1:
            return edges
        out = np.where((near >= 0) & (part[near] != part[:, None]), weight, np.inf)
        low = out.min(axis=1)
        short = np.full(k, np.inf)
        np.minimum.at(short, part, low)
        open_ = bound < short[part]
        unsure = np.bincount(part[open_], minlength=k)
        ready = np.flatnonzero((unsure == 0) & (short < np.inf))
        if not len(ready):
            left = np.flatnonzero(open_)
            searched(left[part[left] != np.argmax(unsure)] if k > 1 else left)
            continue
        at = np.flatnonzero(low == short[part])
        _, one = np.unique(part[at], return_index=True)
        one = at[one]
        one = one[np.isin(part[one], ready)]
        up = list(range(k))
        for i in one.tolist():
            j = int(near[i, out[i].argmin()])
            a, b = int(part[i]), int(part[j])
            while up[a] != a:
                up[a] = up[up[a]]
                a = up[a]
            while up[b] != b:
                up[b] = up[up[b]]
                b = up[b]
            if a != b:
                up[max(a, b)] = min(a, b)
                edges.append((float(low[i]), i, j))
        up = np.array(up)
        while (up != up[up]).any():
            up = up[up]
        part = up[part]


def _labelled(df: DataFrame, key: str, vec: str, most: int, columns: str, one, many) -> DataFrame:
    """key and columns: ``one`` makes them of a matrix in one task up to ``most`` points, ``many`` at the driver of more."""
    rows = df.select(F.col(key).alias("key"), F.col(vec).alias("vec"))
    schema = f"key {dict(df.dtypes)[key]}, {columns}"
    if rows.limit(most + 1).count() > most:
        import pyarrow as pa

        whole = rows.select("key", F.col("vec").cast("array<double>").alias("vec")).orderBy("key").toArrow().combine_chunks()
        keys, vectors = whole["key"], whole["vec"].combine_chunks()
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)
        made = many(x)
        names = [c.split()[0] for c in columns.split(", ")]
        return df.sparkSession.createDataFrame(pa.table({"key": keys, **dict(zip(names, map(pa.array, made), strict=True))})).selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in ["key " + dict(df.dtypes)[key], *columns.split(", ")]])

    def run(pdf):
        pdf = pdf.sort_values("key").reset_index(drop=True)
        for c, values in zip(columns.split(", "), one(np.stack(pdf["vec"].to_numpy())), strict=True):
            pdf[c.split()[0]] = values
        return pdf[["key", *[c.split()[0] for c in columns.split(", ")]]]

    return rows.withColumn("_all", F.lit(True)).groupBy("_all").applyInPandas(run, schema)


def super_anchors(anchors: DataFrame, *, key: str, vec: str, k: int = 0, kmin: int = 25, kmax: int = 60, most: int = MOST_POINTS) -> DataFrame:
    """key, super_id: average-linkage clusters of anchors."""
    spark = anchors.sparkSession

    def named(labels: np.ndarray) -> list:
        return [[f"S{c:04d}" for c in labels]]

    def one(x: np.ndarray) -> list:
        return named(choose_k(x, k, kmin, kmax)[1])

    return _labelled(anchors, key, vec, most, "super_id string", one, lambda x: named(choose_k(x, k, kmin, kmax, linkage_of_many(spark, x))[1]))


def density_clusters(df: DataFrame, *, key: str, vec: str, min_cluster_size: int = 20, most: int = MOST_POINTS) -> DataFrame:
    """key, cluster_id, is_outlier."""
    spark, m = df.sparkSession, min_cluster_size

    def shown(labels: np.ndarray) -> list:
        return [labels.astype("int32"), labels == -1]

    def many(x: np.ndarray) -> list:
        return shown(condensed(tree_of_many(spark, x, m), len(x), m) if len(x) >= m else np.full(len(x), -1))

    return _labelled(df, key, vec, most, "cluster_id int, is_outlier boolean", lambda x: shown(density_labels(x, m)), many)


def super_table(mapping: DataFrame, anchors: DataFrame, *, key: str, label: str, vec: str) -> DataFrame:
    """super_id, size, repr_key, repr_label, member_keys, member_labels (joined by ";") of each super anchor."""
    rows = anchors.join(mapping.withColumnRenamed("key", "_k"), F.col(key) == F.col("_k")).drop("_k")
    reps = representatives(rows, cls="super_id", vec=vec, key=key).select(F.col("class").alias("super_id"), F.col("key").alias("repr_key"))
    names = anchors.select(F.col(key).alias("repr_key"), F.col(label).alias("repr_label"))
    members = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(label).cast("string").alias("l"))))
    lists = rows.groupBy("super_id").agg(F.count("*").alias("size"), members.alias("m"))
    return lists.join(reps, "super_id").join(names, "repr_key").select("super_id", "size", "repr_key", "repr_label", F.array_join(F.transform("m", lambda s: s["k"].cast("string")), ";").alias("member_keys"), F.array_join(F.transform("m", lambda s: s["l"]), ";").alias("member_labels"))


def outliers(df: DataFrame) -> DataFrame:
    """n_clusters (without outliers), n_outliers."""
    return df.agg(F.countDistinct(F.when(~F.col("is_outlier"), F.col("cluster_id"))).alias("n_clusters"), F.count_if("is_outlier").alias("n_outliers"))
