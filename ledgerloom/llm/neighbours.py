"""Operator 9, approximate nearest neighbours: a permutation index over pivots, reranked by exact inner products.

A vector is represented by the order of its nearest pivots. It is posted in the inverted files of the first of them, and
a query visits the files of its own. There, candidates are ranked by the footrule distance of the two orders, and the
best are reranked by inner products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.staging import stage

#: Pivots (at most 256), and how many of the nearest make a vector's order.
PIVOTS, ORDERED = 256, 64
#: Files in which a vector of usual length is posted, the most times more for a longer one, and files that a query visits.
POSTS, LONGER, VISITS = 4, 8, 64
#: Share of all vectors that a query reranks, by footrule distance, but LEAST at least.
RERANKED, LEAST = 0.2, 400
#: Rows of the sample from which pivots, the scale of distances and each query's limit are taken.
SAMPLE = 2048
#: Rows of a part of a file, and of the queries that visit it: what one task holds at a time.
VECTOR_ROWS, QUERY_ROWS = 8192, 2048


def usable(df: DataFrame) -> DataFrame:
    """Rows with an id and a vector that isn't zero and has no null or non-finite component."""
    wrong = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", wrong) & F.exists("embedding", lambda x: x != 0))


@dataclass
class Index:
    """What every task needs of the sample; ``pivots`` have length 1, ``share`` of all vectors is reranked.

    The cosine of two vectors is estimated as ``scale[0] + scale[1] * gain`` of their orders. Its product with the
    candidate's length ranks candidates, so that for vectors of one length the footrule distance alone does.
    """

    pivots: np.ndarray
    ordered: int
    scale: tuple[float, float]
    typical: float
    sample_places: np.ndarray
    sample_norms: np.ndarray
    share: float

    def orders(self, x: np.ndarray) -> np.ndarray:
        """The numbers of the nearest pivots of each row, nearest first; ties to the smaller number."""
        return np.argsort(-(x @ self.pivots.T), axis=1, kind="stable")[:, : self.ordered].astype(np.uint8)

    def places(self, order: np.ndarray) -> np.ndarray:
        """For each pivot its place in every order, ``ordered`` where it has none."""
        out = np.full((len(self.pivots), len(order)), self.ordered, np.int16)
        np.put_along_axis(out, order.T.astype(np.int64), np.arange(order.shape[1], dtype=np.int16)[:, None], axis=0)
        return out

    def estimates(self, order: np.ndarray, places: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Of one query's order against rows: twice the sum of ``ordered`` less the later of both places of a pivot,
        which is ordered * (ordered + 1) less the footrule distance, scaled."""
        later = np.maximum(np.arange(len(order), dtype=np.int16)[:, None], places[order]).sum(0, dtype=np.int32)
        gain = 2 * (len(order) * self.ordered - later)
        return norms * (self.scale[0] + self.scale[1] * gain)

    def limit(self, order: np.ndarray) -> float:
        """The estimate that ``share`` of the sample reaches."""
        found = self.estimates(order, self.sample_places, self.sample_norms)
        keep = min(len(found), int(np.ceil(self.share * len(found))) + 1)
        return float(np.partition(found, len(found) - keep)[len(found) - keep]) if self.share < 1 else -np.inf


def build_index(vectors: DataFrame, rows: int, pivots: int, ordered: int, share: float, least: int) -> Index:
    """An index from the first ``SAMPLE`` rows by a hash of the id; pivots are the first distinct vectors of these."""
    found = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    x = np.array([r["embedding"] for r in found], np.float64).reshape(len(found), -1)
    norms = np.linalg.norm(x, axis=1)
    marks = np.array(list(dict.fromkeys(map(tuple, x / norms[:, None])))[:pivots])
    index = Index(marks, min(ordered, len(marks)), (0.0, 1.0), float(np.median(norms)), np.zeros((len(marks), 0), np.int16), norms, min(1.0, max(share, least / rows)))
    order = index.orders(x)
    index.sample_places = index.places(order)
    half = len(x) // 2
    if half:
        gain = np.array([index.estimates(o, index.sample_places[:, half + i : half + i + 1], np.ones(1))[0] for i, o in enumerate(order[:half])])
        cosine = (x[:half] * x[half : 2 * half]).sum(1) / (norms[:half] * norms[half : 2 * half])
        spread = ((gain - gain.mean()) ** 2).sum()
        slope = ((gain - gain.mean()) * cosine).sum() / spread if spread else 0.0
        if slope > 0:
            index.scale = (float(cosine.mean() - slope * gain.mean()), float(slope))
    return index


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _poster(sent, every: int, posts: int, visits: int):
    """Each row's order, the files in which it is posted, and as a query the files that it visits and its limit."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            order = index.orders(x)
            times = np.clip(np.linalg.norm(x, axis=1) / index.typical, 1, LONGER)
            number = np.minimum(np.ceil(posts * times - 1e-9).astype(np.int64), index.ordered)
            asks = batch.column("vec_id").to_numpy() % every == 0
            lists = [pa.array([o[:n].tolist() for o, n in zip(order, number)], pa.list_(pa.int32())), pa.array([o[:visits].tolist() if a else None for o, a in zip(order, asks)], pa.list_(pa.int32()))]
            limits = pa.array([index.limit(o) if a else None for o, a in zip(order, asks)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), batch.column("embedding"), _bytes(order), pa.array(number, pa.int32()), *lists, limits], ["row", "vec_id", "embedding", "order", "posts", "posted", "visited", "least"])

    return post


def search_file(index: Index, file: int, x: dict, q: dict, visits: int, k: int) -> list[np.ndarray]:
    """The ``k`` best candidates of a file for each query: query rows, query ids, rows, ids and inner products.

    A candidate that is posted in several files which the query visits belongs to the first of them in its order.
    """
    places, norms = index.places(x["order"]), np.linalg.norm(x["vector"], axis=1)
    first = np.arange(x["order"].shape[1]) < x["posts"][:, None]
    most = int(x["posts"].max())
    order, first = x["order"][:, :most].astype(np.int64), first[:, :most]
    out: list[tuple] = []
    for row, own, vector, asked, least in zip(q["row"], q["vec_id"], q["vector"], q["order"], q["least"]):
        open_ = np.zeros(len(index.pivots), bool)
        open_[asked[:visits]] = True
        met = open_[order] & first
        mine = (order[np.arange(len(order)), met.argmax(1)] == file) & (x["vec_id"] != own)
        kept = np.flatnonzero(mine & (index.estimates(asked, places, norms) >= least))
        score = x["vector"][kept] @ vector
        best = np.lexsort((x["vec_id"][kept], -score))[:k]
        out.append((np.full(len(best), row), np.full(len(best), own), x["row"][kept][best], x["vec_id"][kept][best], score[best]))
    return [np.concatenate(c) for c in zip(*out)]


def _searcher(sent, visits: int, k: int):
    names = ["query_row", "query_id", "row", "vec_id", "score"]

    def columns(t: pa.Table, *more: str) -> dict:
        order = np.frombuffer(b"".join(t["order"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
        return {"vector": _matrix(t["embedding"]), "order": order, **{c: t[c].to_numpy() for c in ("row", "vec_id", *more)}}

    def search(x: pa.Table, q: pa.Table) -> pa.Table:
        if not x.num_rows or not q.num_rows:
            return pa.table({n: pa.array([], pa.float64() if n == "score" else pa.int64()) for n in names})
        return pa.table(dict(zip(names, search_file(sent.value, x["file"][0].as_py(), columns(x, "posts"), columns(q, "least"), visits, k))))

    return search


def nearest_neighbours(vectors: DataFrame, every: int = 20, k: int = 20, pivots: int = PIVOTS, ordered: int = ORDERED, share: float = RERANKED, least: int = LEAST, posts: int = POSTS, visits: int = VISITS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id ``every`` divides, its ``k`` nearest other rows found.

    Every row is posted, with its order of pivots, in the inverted files of its nearest ones: ``posts`` files, and more
    for vectors longer than the median, as they are near to many. A query visits the files of its nearest ``visits``
    pivots, ranks what is posted there by footrule distance and the candidate's length, reranks what is above the limit
    that ``share`` of the sample reaches (of a small table ``least`` rows) by inner products in double precision, and
    keeps ``k`` of each file. Files with many rows or queries are parts of ``VECTOR_ROWS`` and ``QUERY_ROWS``. Only
    pivots and scales come from a sample (``build_index``), which each task gets. Vectors of other
    lengths than the pivots' are searched among their like; there is one index for each length, of which there should be few.

    Null, zero and non-finite vectors take no part; ties go to the smaller vec_id; of rows that repeat an id, every
    other than the query's own id is a candidate and each is returned, and queries that repeat an id are one, whose
    candidates have the better score. An empty table gives an empty result. Other columns are ignored.
    """
    if pivots > 256:
        raise ValueError("at most 256 pivots")
    spark = vectors.sparkSession
    rows = usable(vectors.select("vec_id", "embedding")).select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding", F.size("embedding").alias("size"))
    good = stage(rows, "ann-vectors")
    found = None
    for size, number in [(r["size"], r["count"]) for r in good.groupBy("size").count().collect()]:
        own = good.where(F.col("size") == size).drop("size")
        sent = spark.sparkContext.broadcast(build_index(own, number, pivots, ordered, share, least))
        schema = "row long, vec_id long, embedding array<float>, order binary, posts int, posted array<int>, visited array<int>, least double"
        posted = stage(own.withColumn("embedding", F.col("embedding").cast(vectors.schema["embedding"].dataType)).mapInArrow(_poster(sent, every, posts, visits), schema.replace("array<float>", vectors.schema["embedding"].dataType.simpleString())), "ann-index")
        left = posted.select(F.explode("posted").alias("file"), "row", "vec_id", "embedding", "order", "posts")
        # queries that repeat id and vector are one
        right = posted.toDF(*posted.columns).where("visited IS NOT NULL").dropDuplicates(["vec_id", "embedding"]).select(F.explode("visited").alias("file"), "row", "vec_id", "embedding", "order", "least")
        # at most as many rows as pivots
        parts = lambda df, name, most: df.groupBy("file").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
        sizes = F.broadcast(stage(parts(left, "blocks", VECTOR_ROWS).join(parts(right, "turns", QUERY_ROWS), "file"), "ann-files"))
        up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        part = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
        left = left.join(sizes, "file").withColumns({"a": part("blocks")}).withColumn("b", up_to("turns")).drop("blocks", "turns")
        right = right.join(sizes, "file").withColumns({"b": part("turns")}).withColumn("a", up_to("blocks")).drop("blocks", "turns")
        near = left.groupBy("file", "a", "b").cogroup(right.groupBy("file", "a", "b")).applyInArrow(_searcher(sent, visits, k), "query_row long, query_id long, row long, vec_id long, score double")
        found = near if found is None else found.unionByName(near)
    if found is None:
        found = spark.createDataFrame([], "query_row long, query_id long, row long, vec_id long, score double")
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "row"))).where(F.col("rank") <= k)
    best = ranked(found, "query_row").groupBy("query_id", "row").agg(F.first("vec_id").alias("vec_id"), F.max("score").alias("score"))
    return ranked(best, "query_id").select("query_id", "rank", "vec_id", "score")
