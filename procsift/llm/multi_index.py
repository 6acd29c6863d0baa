"""Nearest neighbours by an inverted multi-index: two codebooks, cells in order of summed distance."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procsift.llm.common import hash_sample, stored

#: Neighbours of a query; a class of equal vectors keeps one id more, as one may be the query's.
NEAREST = 5
#: The codebooks are fitted on at most so many distinct vectors.
MAX_TRAINED = 20_000
#: Centroids of a half: the root of a cell for each so many vectors, within bounds.
VECTORS_A_CELL, LEAST_CENTROIDS, MOST_CENTROIDS = 8, 2, 1024
#: At most so many queries measure how far a search must go for this recall.
CALIBRATED, RECALL = 256, 0.95
#: No search ends before it has seen so many distinct vectors.
LEAST_SEEN = 256
#: Vectors, and queries, that one task compares at a time.
SHARD_VECTORS, SHARD_QUERIES = 2048, 512
_ROUNDS = 12
#: What a product of matrices and the exact measure may differ in.
_SLACK = 1e-9


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that no square over- or underflows; the angle stays."""
    _, power = np.frexp(np.abs(vectors).max(axis=1, keepdims=True, initial=0.0))
    return np.ldexp(vectors, -power)


def unit(vectors: np.ndarray) -> np.ndarray:
    small = scaled(vectors)
    return small / np.sqrt((small * small).sum(axis=1, keepdims=True))


def cosine(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The measure, row by row, in double precision."""
    x, y = scaled(one), scaled(other)
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def _distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points * points).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1) - 2 * points @ centroids.T


def fit_codebook(points: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Centroids by Lloyd's rounds, in the order of their first component."""
    random = np.random.default_rng(seed)
    centroids = points[random.choice(len(points), size, replace=len(points) < size)].copy()
    for _ in range(_ROUNDS):
        nearest = _distances(points, centroids).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=size)
        met = counts > 0
        centroids[met] = sums[met] / counts[met, None]
    return centroids[np.argsort(centroids[:, 0], kind="stable")] if centroids.shape[1] else centroids


@dataclass(frozen=True)
class Codebooks:
    """Centroids of both halves; cell = first * size + second."""

    first: np.ndarray
    second: np.ndarray

    @property
    def size(self) -> int:
        return len(self.first)

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of each vector's halves to the centroids."""
        points, cut = unit(vectors), self.first.shape[1]
        return _distances(points[:, :cut], self.first), _distances(points[:, cut:], self.second)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        one, two = self.halves(vectors)
        return one.argmin(axis=1) * self.size + two.argmin(axis=1)


def traverse(one: np.ndarray, two: np.ndarray, counts: np.ndarray, budget: int) -> list[int]:
    """Cells in the order of summed distance, until ``budget`` vectors lie in them.

    The multi-sequence walk: both halves are sorted once, and a pair enters the
    heap when the pairs before it in both directions have left it.
    """
    size = len(one)
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    x, y, a, b = one[a].tolist(), two[b].tolist(), a.tolist(), b.tolist()
    done = [0] * size  # how many of a row's pairs have left the heap
    heap, seen, found = [(x[0] + y[0], 0, 0)], 0, []
    while heap and seen < budget:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * size + b[j]
        if counts[cell]:
            found.append(cell)
            seen += int(counts[cell])
        done[i] = j + 1
        if i + 1 < size and done[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
        if j + 1 < size and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
    return found


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def valid_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows that take part."""
    vec = F.col(embedding).cast("array<double>")
    fine: Column = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), vec.alias("vec")).where(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & fine & F.exists("vec", lambda x: x != 0)
    )
    widths = some.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    return some.where(F.size("vec") == (widths[0]["width"] if widths else 0))


def classes_of(rows: DataFrame, most: int) -> DataFrame:
    """(class, h, vec, ids): distinct vectors, each with its ``most`` smallest ids.

    Rows beyond them are gone before the shuffle, so that a vector with a third
    of all rows sends ``most`` of them from each task.
    """
    keyed = rows.select(F.xxhash64("vec").alias("h"), "vec", "vec_id")
    place = F.row_number().over(Window.partitionBy("h", "vec").orderBy("vec_id"))
    return stored(
        keyed.withColumn("_place", place)
        .where(F.col("_place") <= most)
        .groupBy("h", "vec")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        .withColumn("class", F.monotonically_increasing_id()),
        "ann-classes",
    )


def _fitted(classes: DataFrame, n: int, width: int, max_trained: int) -> Codebooks:
    """Codebooks of a bounded sample: the vectors of the smallest hash."""
    sample = hash_sample(classes.select("vec"), max_trained, "vec").toPandas()
    points = unit(np.array(sample["vec"].tolist(), dtype=np.float64).reshape(-1, width))
    size = int(np.clip(round((n / VECTORS_A_CELL) ** 0.5), LEAST_CENTROIDS, MOST_CENTROIDS))
    cut = width // 2
    return Codebooks(fit_codebook(points[:, :cut], size, 5), fit_codebook(points[:, cut:], size, 6))


def _true_cells(entries: DataFrame, vectors: np.ndarray, keys: np.ndarray, nearest: int) -> dict[int, list[int]]:
    """By brute force over all entries: the cells of the nearest other vectors of a few queries.

    Each task keeps the best of its entries for each query, so the work is
    linear in the table and what leaves a task is bounded.
    """
    width, wanted = vectors.shape[1], unit(vectors)
    shared = entries.sparkSession.sparkContext.broadcast((wanted, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, own = shared.value
        score = np.full((len(asked), nearest), -np.inf)
        cell = np.full((len(asked), nearest), -1, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            found = asked @ unit(_vectors(batch.column(2), width)).T
            found[own[:, None] == batch.column(0).to_numpy()[None, :]] = -np.inf
            cells = np.broadcast_to(batch.column(1).to_numpy().astype(np.int64), found.shape)
            found, cells = np.concatenate([score, found], axis=1), np.concatenate([cell, cells], axis=1)
            best = np.argpartition(-found, nearest - 1, axis=1)[:, :nearest]
            score, cell = np.take_along_axis(found, best, axis=1), np.take_along_axis(cells, best, axis=1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(own, nearest), pa.int64()),
                pa.array(score.ravel(), pa.float64()),
                pa.array(cell.ravel(), pa.int64()),
            ],
            names=["query", "score", "cell"],
        )

    best = entries.select("class", "cell", "vec").mapInArrow(run, "query bigint, score double, cell bigint")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cell"))
    rows = best.where("cell >= 0").withColumn("_place", place).where(F.col("_place") <= nearest).collect()
    out: dict[int, list[int]] = {}
    for row in rows:
        out.setdefault(row["query"], []).append(row["cell"])
    return out


def _budget(books: Codebooks, counts: np.ndarray, vectors: np.ndarray, true_cells: list[list[int]], recall: float) -> int:
    """Vectors that a search must see for ``recall`` of the true neighbours of the calibrated queries."""
    needed = []
    one, two = books.halves(vectors)
    for a, b, cells in zip(one, two, true_cells, strict=True):
        away = (a[:, None] + b[None, :]).ravel()
        order = np.argsort(away, kind="stable")
        before = np.empty(len(order), dtype=np.int64)
        before[order] = np.cumsum(counts[order])
        needed.extend(before[cells].tolist())
    if not needed:
        return LEAST_SEEN
    return max(LEAST_SEEN, int(np.quantile(needed, recall, method="higher")))


@dataclass(frozen=True)
class _Plan:
    """What a search task needs: bounded by the number of cells."""

    books: Codebooks
    counts: np.ndarray
    starts: np.ndarray
    budget: int
    width: int


def _probes(asked: DataFrame, plan: _Plan) -> DataFrame:
    """(shard, query, vec, cells): for each shard that a query visits, the cells in it.

    A shard is a run of cells in order, or a part of a large cell.
    """
    shared = asked.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = p.books.halves(_vectors(batch.column(1), p.width))
            for row in range(batch.num_rows):
                found = np.sort(np.array(traverse(one[row], two[row], p.counts, p.budget), dtype=np.int64))
                low = p.starts[found] // SHARD_VECTORS
                high = (p.starts[found] + p.counts[found] - 1) // SHARD_VECTORS
                many = high - low + 1
                cells = np.repeat(found, many)
                shards = np.repeat(low, many) + np.arange(len(cells)) - np.repeat(np.cumsum(many) - many, many)
                order = np.argsort(shards, kind="stable")
                shards, cells = shards[order], cells[order]
                names, at = np.unique(shards, return_index=True)
                same = pa.array(np.full(len(names), row), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.int64()),
                        batch.column(0).take(same),
                        batch.column(1).take(same),
                        pa.ListArray.from_arrays(
                            pa.array(np.append(at, len(cells)), pa.int32()), pa.array(cells, pa.int64())
                        ),
                    ],
                    names=["shard", "query", "vec", "cells"],
                )

    return asked.select("class", "vec").mapInArrow(
        run, "shard bigint, query bigint, vec array<double>, cells array<bigint>"
    )


def best_in_shard(
    vectors: np.ndarray, cells: np.ndarray, first_ids: np.ndarray, asked: np.ndarray, visited: list[np.ndarray], most: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, score): for each query the ``most`` best entries of its visited cells, ties to smaller ids."""
    names, place = np.unique(cells, return_inverse=True)
    open_cells = np.zeros((len(asked), len(names)), dtype=bool)
    for row, own in enumerate(visited):
        at = np.searchsorted(names, own)
        at = at[at < len(names)]
        open_cells[row, at[np.isin(names[at], own)]] = True
    near = np.where(open_cells[:, place], unit(asked) @ unit(vectors).T, -np.inf)
    if near.shape[1] > most:
        least = -np.partition(-near, most - 1, axis=1)[:, most - 1]
        wanted = (near >= (least - _SLACK)[:, None]) & (near > -np.inf)
    else:
        wanted = near > -np.inf
    query, entry = np.nonzero(wanted)
    score = cosine(asked[query], vectors[entry])
    order = np.lexsort((first_ids[entry], -score, query))
    query, entry, score = query[order], entry[order], score[order]
    begin = np.searchsorted(query, query, side="left")
    keep = np.arange(len(query)) - begin < most
    return query[keep], entry[keep], score[keep]


def _compared(entries: DataFrame, probes: DataFrame, width: int, most: int) -> DataFrame:
    """(query, score, class, ids) of the best entries of each visited shard.

    Entries and probes meet by shard. A shard that very many queries visit is
    sent to several tasks, each with a part of the queries.
    """
    passes = (
        probes.groupBy("shard")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", F.ceil(F.col("n") / SHARD_QUERIES).cast("int").alias("passes"))
    )
    left = (
        entries.join(passes, "shard")
        .select("shard", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass"), "cell", "class", "ids", "vec")
    )
    mine = F.pmod(F.xxhash64("query", F.lit(9)), F.col("passes")).cast("int")
    right = probes.join(passes, "shard").select("shard", mine.alias("pass"), "query", "vec", "cells")

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        own, asked = own.combine_chunks(), asked.combine_chunks()
        kinds = [("query", pa.int64()), ("score", pa.float64()), ("class", pa.int64()), ("ids", pa.list_(pa.int64()))]
        if not own.num_rows or not asked.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for _, k in kinds], names=[n for n, _ in kinds])
        vectors = _vectors(own["vec"].combine_chunks(), width)
        first = np.array([x[0] for x in own["ids"].to_pylist()], dtype=np.int64)
        query, entry, score = best_in_shard(
            vectors,
            own["cell"].to_numpy(),
            first,
            _vectors(asked["vec"].combine_chunks(), width),
            [np.array(x, dtype=np.int64) for x in asked["cells"].to_pylist()],
            most,
        )
        entry = pa.array(entry, pa.int64())
        return pa.Table.from_arrays(
            [
                asked["query"].combine_chunks().take(pa.array(query, pa.int64())),
                pa.array(score, pa.float64()),
                own["class"].combine_chunks().take(entry),
                own["ids"].combine_chunks().take(entry),
            ],
            names=[n for n, _ in kinds],
        )

    return (
        left.groupBy("shard", "pass")
        .cogroup(right.groupBy("shard", "pass"))
        .applyInArrow(run, "query bigint, score double, class bigint, ids array<bigint>")
    )


_EMPTY = "query_id bigint, rank int, vec_id bigint, score double"


def nearest_neighbours(
    rows: DataFrame,
    asks: Column,
    nearest: int = NEAREST,
    recall: float = RECALL,
    max_trained: int = MAX_TRAINED,
    calibrated: int = CALIBRATED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows by cosine of every row for which ``asks`` holds.

    ``asks`` is a condition on vec_id. Equal vectors are one class, with the
    ids that an answer can need. The halves of the unit vectors are quantised
    by two codebooks, fitted on at most ``max_trained`` distinct vectors; every
    class is entered in the cell of its two centroids. A query walks through
    the cells in the order of summed distance and is compared exactly with all
    classes in them.

    How far it walks is measured, not guessed: for at most ``calibrated`` of the
    queries the true neighbours are found by brute force over the whole table,
    and all queries see as many vectors as it takes to reach ``recall`` of
    these. In tables of up to LEAST_SEEN distinct vectors answers are exact.

    Cells in a row share shards of about SHARD_VECTORS vectors, a larger cell
    is dealt over several; answers don't depend on the shards. Null vec_ids and
    vectors that are null, zero, or hold null or non-finite components take no
    part, nor do those of another length than most have. A row that repeats a
    vec_id is a row of its own; the query's own row is one of equal id and
    vector. Equal scores go to the smaller vec_id. Without a query, no rows.
    """
    spark = rows.sparkSession
    usable = valid_vectors(rows)
    kept = nearest + 1
    classes = classes_of(usable, kept)
    wanted = usable.where(asks).select(F.xxhash64("vec").alias("h"), "vec", "vec_id")
    queries = stored(
        wanted.join(classes.select("h", "vec", F.col("class").alias("query")), ["h", "vec"]).select("vec_id", "query"),
        "ann-queries",
    )
    asked = stored(classes.join(queries.select(F.col("query").alias("class")).distinct(), "class"), "ann-asked")
    n, width = classes.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not n or asked.isEmpty():
        return spark.createDataFrame([], _EMPTY)
    books = _fitted(classes, n, width, max_trained)
    shared = spark.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = shared.value.cells(_vectors(batch.column(2), width)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.int64())], names=["class", "ids", "vec", "cell"]
            )

    entries = stored(
        classes.select("class", "ids", "vec").mapInArrow(
            assign, "class bigint, ids array<bigint>, vec array<double>, cell bigint"
        ),
        "ann-entries",
    )
    # One row for each cell in use, MOST_CENTROIDS squared at most.
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = stored(
        entries.groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))),
        "ann-cells",
    )
    counts = np.zeros(books.size**2, dtype=np.int64)
    starts = np.zeros_like(counts)
    used = cells.toPandas()
    counts[used["cell"]], starts[used["cell"]] = used["n"], used["start"]

    probe = hash_sample(asked.select("class", "vec"), calibrated, "vec", "class").toPandas()
    vectors = np.array(probe["vec"].tolist(), dtype=np.float64).reshape(-1, width)
    keys = probe["class"].to_numpy(dtype=np.int64)
    true_cells = _true_cells(entries, vectors, keys, nearest)
    budget = _budget(books, counts, vectors, [true_cells.get(int(k), []) for k in keys], recall)

    probes = stored(_probes(asked, _Plan(books, counts, starts, budget, width)), "ann-probes")
    spot = F.col("start") + F.pmod(F.xxhash64("class", F.lit(4)), F.col("n"))
    sharded = entries.join(F.broadcast(cells), "cell").withColumn(
        "shard", F.floor(spot / SHARD_VECTORS).cast("bigint")
    )
    place = F.row_number().over(
        Window.partitionBy("query").orderBy(F.desc("score"), F.element_at("ids", 1), "class")
    )
    best = _compared(sharded, probes, width, kept).withColumn("_place", place).where(F.col("_place") <= kept)
    item = F.struct((-F.col("score")).alias("away"), F.col("vec_id"), (F.col("class") == F.col("query")).alias("own"))
    answers = (
        best.withColumn("vec_id", F.explode("ids"))
        .groupBy("query")
        .agg(F.array_sort(F.collect_list(item)).alias("found"))
    )  # at most the square of ``kept`` for each query
    own = F.expr("array_position(transform(found, f -> f.own and f.vec_id = query_id), true)")
    others = F.expr("filter(found, (f, i) -> i + 1 != own)")
    return (
        queries.withColumnRenamed("vec_id", "query_id")
        .join(answers, "query")
        .withColumn("own", own)
        .select("query_id", F.posexplode(F.slice(others, 1, nearest)).alias("at", "f"))
        .select(
            "query_id",
            (F.col("at") + 1).alias("rank"),
            F.col("f.vec_id").alias("vec_id"),
            (-F.col("f.away")).alias("score"),
        )
    )
