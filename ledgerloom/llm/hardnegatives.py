"""Operator 13, hard negatives: integer inner products by a two-dimensional block matrix product, reduced tile by tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.staging import stage

#: Sides of a tile, components of a chunk, and groups of labels. A tile of 64-bit scores has 4 MB.
ANCHORS, ROWS, CHUNK, BUCKETS = 256, 2048, 32, 64
#: Scaled components beyond it are set to it, so that sums over 64 dimensions fit 64 bits.
LARGEST = 1 << 28
_NONE = np.iinfo(np.int64).min + 1

_BLOCK = "block int, chunk int, size int, ids binary, labels binary, matrix binary, scores binary, positives binary"
_TILE = "i int, j int, a_ids binary, a_labels binary, b_ids binary, b_labels binary, scores binary, positives binary, tile binary"


def _scaled(scale: float):
    """Rows that take part, with their scaled components as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for vec_id, label, anchor, vector in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3)):
                values = vector.values.to_numpy(zero_copy_only=False).astype(np.float64) if vector.is_valid else None
                if vec_id is not None and label is not None and values is not None and np.isfinite(values).all():
                    with np.errstate(over="ignore"):
                        whole = np.clip(np.floor(scale * values), -LARGEST, LARGEST)
                    rows.append((vec_id, label, bool(anchor), whole.astype("<i4").tobytes()))
            columns = zip(*rows) if rows else ([], [], [], [])
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["vec_id", "label", "anchor", "vector"])

    return run


def _pack(chunks: int, kept: int):
    """One block as ``chunks`` matrices of ``CHUNK`` components each; rows in order of their ids, missing components 0."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        matrix = np.zeros((len(table), chunks * CHUNK), "<i4")
        for r, vector in enumerate(table.column("vector")):
            values = np.frombuffer(vector.as_py(), "<i4")
            matrix[r, : len(values)] = values
        of_first = {name: table.column(column).to_numpy().astype("<i8").tobytes() for name, column in (("ids", "vec_id"), ("labels", "label"))}
        if kept:
            for name in ("scores", "positives"):
                padded = np.full((len(table), kept), _NONE, "<i8")
                for r, values in enumerate(table.column(name).to_pylist()):
                    padded[r, : len(values)] = values
                of_first[name] = padded.tobytes()
        rows = [{"block": key[0].as_py(), "chunk": k, "size": len(table), "matrix": np.ascontiguousarray(matrix[:, k * CHUNK : (k + 1) * CHUNK]).tobytes()} | (of_first if k == 0 else {}) for k in range(chunks)]
        return pa.Table.from_pylist(rows, pa.schema([("block", pa.int32()), ("chunk", pa.int32()), ("size", pa.int32()), *((n, pa.binary()) for n in ("ids", "labels", "matrix", "scores", "positives"))]))

    return run


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact 64-bit ``a @ b.T``: in double precision where no sum can pass 2**53, else in integers."""
    largest = [int(np.abs(x).max(initial=0)) for x in (a, b)]
    kind = np.float64 if largest[0] * largest[1] * a.shape[1] < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _partial_tile(key: tuple, table: pa.Table) -> pa.Table:
    """The product of one chunk of an anchor block and of a row block; ids and labels go with the first chunk.

    None, if all anchors of the block have no positives, and so aren't there.
    """
    sides = {r["side"]: r for r in table.to_pylist()}
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), *((n, pa.binary()) for n in ("a_ids", "a_labels", "b_ids", "b_labels", "scores", "positives", "tile"))])
    if len(sides) < 2:
        return schema.empty_table()
    one, other = sides["a"], sides["b"]
    a, b = (np.frombuffer(x["matrix"], "<i4").reshape(x["size"], CHUNK) for x in (one, other))
    row = {"i": key[0].as_py(), "j": key[1].as_py(), "a_ids": one["ids"], "a_labels": one["labels"], "b_ids": other["ids"], "b_labels": other["labels"], "scores": one["scores"], "positives": one["positives"], "tile": product(a, b).tobytes()}
    return pa.Table.from_pylist([row], schema)


def _summed(table: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The sum of a tile's partial products, and the ids, labels and positives of its sides."""
    first = next(r for r in table.drop_columns(["tile"]).to_pylist() if r["a_ids"] is not None)
    sides = {n: np.frombuffer(v, "<i8") for n, v in first.items() if isinstance(v, bytes)}
    total = np.zeros((len(sides["a_ids"]), len(sides["b_ids"])), np.int64)
    for part in table.column("tile"):
        total += np.frombuffer(part.as_py(), "<i8").reshape(total.shape)
    return total, sides


def _nearest_positives(most: int):
    """Each anchor's best rows of its label in one tile; a tile's rows are in order of their ids, which decide ties."""

    def run(table: pa.Table) -> pa.Table:
        tile, sides = _summed(table)
        own = (sides["a_labels"][:, None] == sides["b_labels"]) & (sides["a_ids"][:, None] != sides["b_ids"])
        held = np.where(own, tile, _NONE)
        order = np.argsort(-held, axis=1, kind="stable")[:, :most]
        best = np.take_along_axis(held, order, 1)
        r, c = np.nonzero(best > _NONE)
        return pa.table({"anchor_id": sides["a_ids"][r], "positive_id": sides["b_ids"][order[r, c]], "positive_score": best[r, c]})

    return run


def _nearest_negatives(kept: int, most: int, low: int, high: int):
    """The best rows of other labels of one tile in the window below each of the anchors' positives."""

    def run(table: pa.Table) -> pa.Table:
        tile, sides = _summed(table)
        held = np.where(sides["a_labels"][:, None] != sides["b_labels"], tile, _NONE)
        order = np.argsort(-held, axis=1, kind="stable")
        falling = np.take_along_axis(held, order, 1)
        scores, positives = (sides[n].reshape(-1, kept) for n in ("scores", "positives"))
        found: list[tuple[int, int, int, int, int]] = []
        for r, line in enumerate(falling):
            for score, positive in zip(scores[r].tolist(), positives[r].tolist()):
                if score == _NONE:
                    break
                # 100 * negative <= high * positive, as whole numbers
                start = int(np.searchsorted(-line, -(high * score // 100), "left"))
                for c in range(start, min(start + most, len(line))):
                    value = int(line[c])
                    if value == _NONE or low * score > 100 * value:
                        break
                    found.append((int(sides["a_ids"][r]), positive, score, int(sides["b_ids"][order[r, c]]), value))
        names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found) if found else [[]] * 5)], names)

    return run


def _tiles(anchors: DataFrame, rows: DataFrame, reduce, schema: str) -> DataFrame:
    """Multiply copies of the blocks that meet, add up the chunks of each tile, and reduce it. Blocks carry ``met``."""
    copies = anchors.select(F.lit("a").alias("side"), F.col("block").alias("i"), F.explode("met").alias("j"), *[c for c in anchors.columns if c not in ("block", "met")])
    others = rows.select(F.lit("b").alias("side"), F.explode("met").alias("i"), F.col("block").alias("j"), *[c for c in rows.columns if c not in ("block", "met")])
    partial = copies.unionByName(others).groupBy("i", "j", "chunk").applyInArrow(_partial_tile, _TILE)
    return partial.groupBy("i", "j").applyInArrow(reduce, schema)


def mine_hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, from vec_id, label and embedding.

    Components become floor(scale * x); a score is the integer inner product with the anchor, a row for which ``anchor``
    holds. Its positives are its best ``positives`` other rows of its label; each of them gets the best ``negatives``
    rows of other labels with ``low * positive_score <= 100 * negative_score <= high * positive_score``. Higher scores
    come first, ties by smaller vec_id; windows of negative scores are empty.

    Rows are cut into blocks by hashes of their ids within ``BUCKETS`` groups of labels, dimensions into chunks. Each
    anchor block meets each row block for every chunk; the partial tiles are shuffled, added, and reduced to the best
    rows of each window, so only tiles and those rows ever meet in one task. Positives only need tiles of one group of
    labels. Tiles are as many as pairs of blocks: the product is of all anchors and all rows, by contract.

    Rows take no part if vec_id, label, vector or a component is null or a component isn't finite. Rows that repeat a
    vec_id count once, with the least label and vector. Shorter vectors count as filled with zeros, scaled components
    beyond 2**28 as that. No anchors, or an empty table, give an empty result. Other columns are ignored.
    """
    chosen = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("vector"))
    scaled = chosen.mapInArrow(_scaled(scale), "vec_id long, label long, anchor boolean, vector binary")
    one_each = scaled.groupBy("vec_id").agg(F.min(F.struct("label", "vector", "anchor")).alias("row")).select("vec_id", "row.*")
    base = stage(one_each.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int")), "negatives-rows")
    sizes = {r["bucket"]: r for r in base.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors"), F.max(F.length("vector")).alias("width")).collect()}
    schema = "anchor_id long, positive_id long, positive_score long"
    chunks = max(1, *(-(-r["width"] // (4 * CHUNK)) for r in sizes.values())) if sizes else 1

    def blocks(side: str, most: int) -> tuple[list[int], list[int]]:
        """Of each group of labels: its first block, and how many it has."""
        numbers = [-(-sizes[b][side] // most) if b in sizes else 0 for b in range(BUCKETS)]
        return [sum(numbers[:b]) for b in range(BUCKETS)], numbers

    of_anchors, of_rows = blocks("anchors", ANCHORS), blocks("n", ROWS)
    at = lambda values: F.get(F.array(*map(F.lit, values)), F.col("bucket"))
    placed = lambda df, plan: df.withColumn("block", (at(plan[0]) + F.pmod(F.xxhash64("vec_id"), at(plan[1]))).cast("int"))
    own_bucket = lambda plan: F.when(at(plan[1]) > 0, F.sequence(at(plan[0]), at(plan[0]) + at(plan[1]) - 1)).otherwise(F.array().cast("array<int>"))
    every = lambda plan: F.sequence(F.lit(0), F.lit(sum(plan[1]) - 1))
    if not sum(of_anchors[1]):
        return base.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    def bucket_of(plan):
        """The group of labels of a block, so that packed blocks know whom they meet."""
        return F.get(F.array(*[F.lit(b) for b in range(BUCKETS) for _ in range(plan[1][b])]), F.col("block"))

    row_blocks = stage(placed(base.select("vec_id", "label", "vector", "bucket"), of_rows).drop("bucket").groupBy("block").applyInArrow(_pack(chunks, 0), _BLOCK), "negatives-blocks")
    anchors = placed(base.where("anchor").select("vec_id", "label", "vector", "bucket"), of_anchors).drop("bucket")
    anchor_blocks = anchors.groupBy("block").applyInArrow(_pack(chunks, 0), _BLOCK)
    met = lambda df, own, other: df.withColumn("bucket", bucket_of(own)).withColumn("met", own_bucket(other)).drop("bucket")
    in_tiles = _tiles(met(anchor_blocks, of_anchors, of_rows), met(row_blocks, of_rows, of_anchors), _nearest_positives(positives), schema)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = in_tiles.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= positives)
    near = stage(near.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_list("positive_score").alias("scores"), F.collect_list("positive_id").alias("positives")), "negatives-positives")

    wanted = anchors.join(near, anchors["vec_id"] == near["anchor_id"]).drop("anchor_id")
    full = wanted.groupBy("block").applyInArrow(_pack(chunks, positives), _BLOCK)
    found = _tiles(full.withColumn("met", every(of_rows)), row_blocks.withColumn("met", every(of_anchors)), _nearest_negatives(positives, negatives, low, high), schema + ", negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")


#: For ``op13_hard_negatives``, on vectors of one length.
ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
) WHERE rank <= 5
"""
