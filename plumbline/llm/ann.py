"""Approximate nearest neighbours by learned partitions.

On a bounded sample of vectors a nearest-neighbour graph is built and cut into balanced partitions
(balanced k-means, then graph moves that keep the sizes), about as many as the root of the number of
vectors.  A softmax classifier learns each vector's partition and those of its graph neighbours.  Every
distinct vector of the table is indexed in its most probable partition; a query is routed to its most
probable ones, where an exact search in double precision ranks what it finds.  How many those
are is measured: a second part of the sample, unseen in learning, is routed and searched, and the
fewest partitions are taken with which it finds `RECALL` of its true neighbours.  Vectors in clusters
need few; vectors without any structure need about half of all.

Partitions are put together into blocks (`block_size`) by their counted sizes, and a larger one is
cut into several.  A block's vectors are held by one task, and all queries sent to it stream past them, each
once a block, so memory is bounded whatever the number of queries.

Equal vectors are one entry that keeps its smallest `top + 1` ids, cut down before the shuffle: more
copies can never be ranked, so a vector that fills a third of the table costs one entry.  A query that
finds too few is searched again in all partitions.

Sample: the distinct vectors of smallest hash, `SAMPLE` and `VALUES` at most; learning from it takes
memory in proportion to the sample, not to sample times partitions.  Everything else uses all rows.

Defined results: a null vec_id, a vector that is null, zero or holds null or non-finite components,
or whose length isn't the table's commonest, takes no part; a repeated row counts once; equal scores go
to smaller ids; further columns are ignored; fewer than two vectors give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, spark_schema, stored

#: Sampled vectors at least and at most, half for learning and half for measuring; sampled vectors for each partition.
SAMPLE, PER_PARTITION = (16384, 65536), 64
#: Partitions at most, and the vectors that each needs.
PARTITIONS, LEAST = 1024, 32
#: Values of the sample at most, whatever the vectors' length; rows that learning handles at once; centres that a vector tries before all.
VALUES, ROWS, CHOICES = 1 << 23, 512, 32
#: The step of learning.
RATE = 0.008
#: Neighbours in the graph, queries scored (and sampled vectors learned from) at once.
NEIGHBOURS, AT_ONCE = 10, 256
#: Vectors in a block: so many roots of their number, so that neither blocks nor the finds of a query in all of them become too many; at most.
ROOTS, BLOCK = 20, 65536
#: The share of true neighbours that sampled queries must find, and how many are asked.
RECALL, ASKED = 0.94, 512


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(finite & F.exists("embedding", lambda x: x != 0))
    size = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("embedding") == (size["size"] if size else 0))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """One row a vector: h, embedding and its `keep` smallest ids in order."""
    rows = rows.distinct().withColumn("h", F.xxhash64("embedding"))
    nth = F.row_number().over(Window.partitionBy("h", "embedding").orderBy("vec_id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= keep)
    return few.groupBy("h", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def neighbour_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each vector by inner product, block by block."""
    out = []
    for at in range(0, len(vectors), ROWS):
        near = vectors[at : at + ROWS] @ vectors.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out.append(np.argpartition(-near, k, axis=1)[:, :k].astype(np.int32))
    return np.concatenate(out)


def nearest_centres(vectors: np.ndarray, centres: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centres in order, and its inner product with the very nearest; block by block."""
    order, best = np.empty((len(vectors), first), np.int32), np.empty(len(vectors), vectors.dtype)
    for at in range(0, len(vectors), ROWS):
        near = vectors[at : at + ROWS] @ centres.T
        some = np.argpartition(-near, first - 1, axis=1)[:, :first]
        score = np.take_along_axis(near, some, 1)
        ranked = np.argsort(-score, axis=1, kind="stable")
        order[at : at + ROWS], best[at : at + ROWS] = np.take_along_axis(some, ranked, 1), score.max(1)
    return order, best


def balanced_partition(vectors: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """A part for each vector, none above 1.05 of the mean size, with few graph edges cut."""
    n, most = len(vectors), int(np.ceil(len(vectors) / parts * 1.05))
    centres = vectors[rng.choice(n, parts, replace=False)]
    for _ in range(rounds):
        choices, best = nearest_centres(vectors, centres, min(parts, CHOICES))
        part, size = np.full(n, -1), np.zeros(parts, np.int64)
        for i in np.argsort(-best, kind="stable").tolist():
            p = next((p for p in choices[i].tolist() if size[p] < most), None)
            if p is None:  # all near ones are full
                near = vectors[i] @ centres.T
                p = int(np.where(size < most, near, -np.inf).argmax())
            part[i], size[p] = p, size[p] + 1
        centres = np.zeros_like(centres)
        np.add.at(centres, part, vectors)
        centres /= np.maximum(size, 1)[:, None].astype(vectors.dtype)
    for _ in range(rounds):
        votes, moved = Votes(graph, part, parts), 0
        best = votes.greatest()
        for i in rng.permutation(np.flatnonzero(best != part)).tolist():
            if size[best[i]] < most:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


class Votes:
    """How many graph neighbours, either way, each vector has in each part: only the parts that have any."""

    def __init__(self, graph: np.ndarray, part: np.ndarray, parts: int, own: int = 0):
        """own: votes that a vector's own part gets besides."""
        n, k = graph.shape
        who, whose = np.concatenate([np.repeat(np.arange(n), k), graph.ravel()]), np.concatenate([part[graph].ravel(), np.repeat(part, k)])
        keys, counts = np.unique(np.concatenate([who * parts + whose, np.arange(n) * parts + part]), return_counts=True)
        self.vector, self.part, self.n, self.parts = keys // parts, keys % parts, n, parts
        self.count = counts + (self.part == part[self.vector]) * (own - 1)
        self.now, self.starts = part, np.searchsorted(self.vector, np.arange(n + 1))

    def greatest(self) -> np.ndarray:
        """Each vector's part of most votes: its own if no other has more, else the smallest of those."""
        order = np.lexsort((self.part, self.part != self.now[self.vector], -self.count, self.vector))
        return self.part[order][np.searchsorted(self.vector[order], np.arange(self.n))]

    def rows(self, which: np.ndarray) -> np.ndarray:
        """Shares of votes of some vectors, one row each."""
        out = np.zeros((len(which), self.parts), np.float32)
        for k, i in enumerate(which.tolist()):
            at = slice(self.starts[i], self.starts[i + 1])
            out[k, self.part[at]] = self.count[at]
        return out / out.sum(1, keepdims=True)


class Router:
    """A softmax classifier of partitions; order() ranks them for vectors of any length."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, scale: float):
        self.weights, self.bias, self.scale = weights, bias, scale

    @classmethod
    def learn(cls, vectors: np.ndarray, parts: int, seed: int = 7, epochs: int = 12) -> Router:
        """Single precision and blocks of rows: memory is that of the vectors and of a block by all of them."""
        rng, (n, width) = np.random.default_rng(seed), vectors.shape
        vectors = vectors.astype(np.float32)
        scale = float(np.sqrt(width) / max(np.sqrt((vectors.astype(np.float64) ** 2).sum(1).mean()), 1e-12))
        graph = neighbour_graph(vectors, min(NEIGHBOURS, n - 1))
        votes = Votes(graph, balanced_partition(vectors, graph, parts, rng), parts, graph.shape[1])
        weights = np.vstack([rng.normal(0, 0.01, (width, parts)), np.zeros((1, parts))]).astype(np.float32)
        first, second, step = np.zeros_like(weights), np.zeros_like(weights), 0
        ones = np.ones((n, 1), np.float32)
        inputs = np.hstack([vectors * np.float32(scale), ones])
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(n), max(1, n // AT_ONCE)):
                wrong = (_softmax(inputs[rows] @ weights) - votes.rows(rows)) / np.float32(len(rows))
                slope, step = inputs[rows].T @ wrong, step + 1
                first += np.float32(0.1) * (slope - first)
                second += np.float32(0.001) * (slope * slope - second)
                weights -= np.float32(RATE / (1 - 0.9**step)) * first / (np.sqrt(second / np.float32(1 - 0.999**step)) + np.float32(1e-8))
        return cls(weights[:-1].astype(np.float64), weights[-1].astype(np.float64), scale)

    def order(self, vectors: np.ndarray, first: int) -> np.ndarray:
        """Each vector's most probable partitions in order; block by block."""
        out = np.empty((len(vectors), first), np.int64)
        for at in range(0, len(vectors), ROWS):
            score = -(vectors[at : at + ROWS] * self.scale @ self.weights + self.bias)
            out[at : at + ROWS] = score.argmin(1)[:, None] if first == 1 else np.argsort(score, axis=1, kind="stable")[:, :first]
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def probes_needed(router: Router, parts: int, unseen: np.ndarray, top: int, total: int) -> int:
    """The fewest partitions that let vectors unseen in learning find RECALL of their nearest among themselves.

    A sample's neighbours are farther away than those among all `total` vectors; so of the `top`, only
    those in proportion to the sample are asked for, five at least.
    """
    n = len(unseen)
    k = min(n - 1, max(5, round(top * n / max(total, 1))))
    if k < 1:
        return parts
    own = router.order(unseen, 1)[:, 0]
    found = np.zeros(parts)
    for at in range(0, min(ASKED, n), 128):
        asked = unseen[at : min(at + 128, ASKED)]
        near = asked @ unseen.T
        near[np.arange(len(asked)), np.arange(at, at + len(asked))] = -np.inf
        nearest = np.argpartition(-near, k - 1, axis=1)[:, :k]
        place = np.argsort(router.order(asked, parts), axis=1)  # of each partition in a query's order
        np.add.at(found, np.take_along_axis(place, own[nearest], axis=1).ravel(), 1)
    return int(np.searchsorted(np.cumsum(found) / found.sum(), RECALL)) + 1


ROUTED = arrow_schema(h=pa.int64(), first=pa.int64(), ids=pa.list_(pa.int64()), embedding=pa.list_(pa.float64()), part=pa.int32())


def routed(entries: DataFrame, router: Router | None) -> DataFrame:
    """Entries with their most probable partition; no router: the only one."""

    def route(batches):
        for batch in batches:
            vectors = _matrix(batch.column("embedding"))
            parts = router.order(vectors, 1)[:, 0] if router else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts.astype(np.int32))], schema=ROUTED)

    return entries.select("h", F.col("ids")[0].alias("first"), "ids", "embedding").mapInArrow(route, spark_schema(ROUTED))


def block_size(n: int, width: int) -> int:
    """Vectors that a block of a table of n should hold."""
    return max(1, min(round(ROOTS * n**0.5), BLOCK, VALUES // width))


def blocks_of(sizes: dict[int, int], parts: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first block of each partition and how many blocks it is cut into; small ones share a block in order."""
    first, cuts, block, held = np.zeros(parts, np.int32), np.ones(parts, np.int32), 0, 0
    for p in range(parts):
        size = sizes.get(p, 0)
        if held and held + size > most:
            block, held = block + 1, 0
        first[p], cuts[p] = block, max(1, -(-size // most))
        if size > most:
            block, held = block + int(cuts[p]), 0
        else:
            held += size
    return first, cuts


#: A block's vectors (kind 0, with their partition) and the queries sent to it (kind 1, with the partitions they probe there).
MEETING = arrow_schema(block=pa.int32(), kind=pa.int32(), h=pa.int64(), first=pa.int64(), ids=pa.list_(pa.int64()), embedding=pa.list_(pa.float64()), parts=pa.list_(pa.int32()))
FOUND = arrow_schema(q_h=pa.int64(), q_first=pa.int64(), ids=pa.list_(pa.int64()), score=pa.float64())


def _sent(queries: DataFrame, router: Router | None, probes: int, first: np.ndarray, cuts: np.ndarray) -> DataFrame:
    """A row for each query and block, with the partitions that it probes there."""

    def send(batches):
        for batch in batches:
            vectors = _matrix(batch.column("embedding"))
            order = router.order(vectors, probes) if router else np.zeros((batch.num_rows, 1), np.int64)
            rows, blocks, parts = [], [], []
            for i, probed in enumerate(order):
                at: dict[int, list[int]] = {}
                for p in np.sort(probed).tolist():
                    for block in range(first[p], first[p] + cuts[p]):
                        at.setdefault(block, []).append(p)
                rows += [i] * len(at)
                blocks += at.keys()
                parts += at.values()
            taken = batch.take(pa.array(rows, pa.int64()))
            n, none = len(rows), pa.nulls(len(rows), pa.list_(pa.int64()))
            columns = [pa.array(blocks, pa.int32()), pa.array(np.ones(n, np.int32)), taken.column("h"), taken.column("first"), none, taken.column("embedding"), pa.array(parts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, schema=MEETING)

    return queries.select("h", "first", "embedding").mapInArrow(send, spark_schema(MEETING))


class _Block:
    """The vectors of one block, in order of partitions."""

    def __init__(self, tables: list[pa.RecordBatch]):
        table = pa.Table.from_batches(tables)
        part = table["parts"].combine_chunks().flatten().to_numpy()
        order = np.argsort(part, kind="stable")
        self.base, self.ids, part = _matrix(table["embedding"])[order], table["ids"].combine_chunks().take(pa.array(order)), part[order]
        self.smallest = table["first"].to_numpy()[order]
        names, starts = np.unique(part, return_index=True)
        ends = [*starts[1:].tolist(), len(part)]
        self.places = {p: slice(a, b) for p, a, b in zip(names.tolist(), starts.tolist(), ends, strict=True)}

    def search(self, queries: pa.RecordBatch, top: int) -> Iterator[pa.RecordBatch]:
        for at in range(0, queries.num_rows, AT_ONCE):
            yield from self._search(queries.slice(at, AT_ONCE), top)

    def _search(self, queries: pa.RecordBatch, top: int) -> Iterator[pa.RecordBatch]:
        asked, probed = _matrix(queries.column("embedding")), queries.column("parts")
        owner = np.repeat(np.arange(len(probed)), probed.value_lengths().to_numpy())
        wanted = probed.flatten().to_numpy()
        scores = np.full((len(asked), len(self.base)), -np.inf)
        for p, where in self.places.items():
            rows = owner[wanted == p]
            if rows.size:
                scores[rows, where] = asked[rows] @ self.base[where].T
        k = min(top, len(self.base))
        least = np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        rows, cols = np.nonzero((-scores <= least) & (scores > -np.inf))  # with all ties of the last
        order = np.lexsort((self.smallest[cols], -scores[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        rows, cols = rows[nth < k], cols[nth < k]
        exact = np.einsum("ij,ij->i", asked[rows], self.base[cols])
        at = pa.array(rows)
        yield pa.RecordBatch.from_arrays([queries.column("h").take(at), queries.column("first").take(at), self.ids.take(pa.array(cols)), pa.array(exact)], schema=FOUND)


def _searched(index: DataFrame, sent: DataFrame, first: np.ndarray, cuts: np.ndarray, top: int) -> DataFrame:
    """Each query's best of every block that it is sent to."""
    tables = F.broadcast(index.sparkSession.createDataFrame([(p, int(a), int(n)) for p, (a, n) in enumerate(zip(first, cuts, strict=True))], "part int, begin int, cuts int"))  # a row for each partition
    block = F.col("begin") + F.pmod(F.xxhash64(F.lit("block"), "h"), F.col("cuts")).cast("int")
    left = index.join(tables, "part").select(block.alias("block"), F.lit(0).alias("kind"), "h", "first", "ids", "embedding", F.array("part").alias("parts"))
    met = left.unionByName(sent).repartition("block").sortWithinPartitions("block", "kind")

    def search(batches):
        at, held, own = None, [], None
        for batch in batches:
            blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if blocks[a] != at:
                    at, held, own = blocks[a], [], None
                if kinds[a] == 0:
                    held.append(part)
                elif held or own:
                    own = own or _Block(held)
                    held = []
                    yield from own.search(part, top)

    return met.mapInArrow(search, spark_schema(FOUND))


def nearest(vectors: DataFrame, is_query: Column, top: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's nearest others by largest inner product.

    is_query is a condition on vec_id that states the query set.
    """
    rows = stored(usable(vectors), "ann-rows")
    entries = stored(distinct_vectors(rows, top + 1), "ann-entries")
    n = entries.count()
    width = (entries.select(F.size("embedding")).first() or [1])[0]
    most = max(2 * LEAST, VALUES // width)
    parts = max(1, min(PARTITIONS, round(n**0.5), n // LEAST, most // LEAST))
    router, probes = None, 1
    if parts > 1:
        size = min(n, most, max(SAMPLE[0], min(SAMPLE[1], PER_PARTITION * parts)))
        sample = _matrix(entries.orderBy(F.xxhash64(F.lit("sample"), "h"), "h", "embedding").limit(size).select("embedding").toArrow()["embedding"])
        seen, unseen = sample[::2], sample[1::2]
        router = Router.learn(seen, parts)
        probes = probes_needed(router, parts, unseen, top, n)
    index = stored(routed(entries, router), "ann-index")
    first, cuts = blocks_of({r["part"]: r["count"] for r in index.groupBy("part").count().collect()}, parts, block_size(n, width))  # a row for each partition
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("h"), "embedding").distinct()
    of_query = asked.join(index.select("h", "embedding", "first"), ["h", "embedding"]).select("query_id", "h", "first")
    of_query = stored(of_query, "ann-queries")
    queries = index.join(of_query.select("h", "first").distinct(), ["h", "first"], "left_semi")
    search = lambda wanted, probes: _best(_searched(index, _sent(wanted, router, probes, first, cuts), first, cuts, top + 1), top + 1)
    found = stored(_ranked(search(queries, probes), of_query, top), "ann-found")
    # Everyone must find `top`, or all others if they are fewer: else it is asked everywhere.
    others = rows.select("vec_id").distinct().count() - 1
    short = of_query.join(found.where(F.col("rank") == min(top, others)).select("query_id"), "query_id", "left_anti")
    if others < 1 or probes == parts or short.isEmpty():
        return found
    short = stored(short, "ann-short")
    again = _ranked(search(queries.join(short.select("h", "first").distinct(), ["h", "first"], "left_semi"), parts), short, top)
    return found.join(short.select("query_id"), "query_id", "left_anti").unionByName(again)


def _best(found: DataFrame, top: int) -> DataFrame:
    """Each query vector's best ids of all blocks; a vector lies in one block, so none comes twice."""
    expanded = found.select("q_h", "q_first", F.explode("ids").alias("vec_id"), "score")
    nth = F.row_number().over(Window.partitionBy("q_h", "q_first").orderBy(F.desc("score"), "vec_id"))
    return expanded.withColumn("nth", nth).where(F.col("nth") <= top).drop("nth")


def _ranked(found: DataFrame, of_query: DataFrame, top: int) -> DataFrame:
    """The ranks of each query row: its vector's finds without itself."""
    joined = of_query.join(found, (F.col("h") == F.col("q_h")) & (F.col("first") == F.col("q_first"))).where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return joined.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
