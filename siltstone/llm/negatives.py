"""Hard negatives of anchors by inner products over an orthogonal PCA rotation.

1. Vectors are of whole numbers, so scores are exact. Their second moments are summed over all rows; the eigenvectors are an
   orthogonal rotation after which the first components hold most of any product.
2. Rows and anchors are dealt to blocks of bounded size by the hash of their id, so that no label makes a block; each block
   of rows meets each block of anchors in one task.
3. A task adds up partial products over leading components. What is left of a product is at most the product of the norms of
   the components that are left; SLACK of the product of the whole norms stands for rounding. A pair goes as soon as that
   bound shows that it can't be among the best so far, or in no window asked for; a row goes when all its pairs have.
4. What survives is verified by integer products, which alone decide; a task keeps the best of its block, and the best of
   these are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import settled, to_driver

#: Positives of an anchor, negatives of a positive, and the percentages of the positive's score that a negative's lies between.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Rows and anchors of a block, rows that a task rates at once, and shares of the components after which it discards.
ROWS, ANCHORS, AT_ONCE, STAGES = 8192, 1024, 1024, (0.125, 0.25, 0.5, 0.75)
#: Rounding of a product in double precision, as a share of the product of the norms (2**-53 an operation, some 10^4 of them).
SLACK = 1e-11
#: The square of the greatest norm whose products are sure to be longs.
GREATEST = float(1 << 60)

_PARTS = "block int, anchors int, is_anchor boolean, id bigint, label string, vector binary, scores array<bigint>"


def usable(df: DataFrame, id_col: str, label: Column, vector: Column) -> DataFrame:
    """(id, label, vector): a row an id that takes part, of several rows of one id the least by label and vector.

    vector is a column of bigint arrays. Left out are rows with a null id, label, vector or component, and those whose norm
    is so great that a product might be no long.
    """
    kept = df.select(F.col(id_col).cast("bigint").alias("id"), label.cast("string").alias("label"), vector.alias("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    kept = kept.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & (square <= GREATEST))
    kept = kept.select("id", "label", F.transform("vector", lambda x: x.cast("int")).alias("vector"))
    return kept.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("own")).select("id", "own.label", "own.vector")


def whole_numbers(vector: Column, times: float) -> Column:
    """Each component times `times`, in double precision, without its fraction (towards less); null for a null or non-finite one,
    and for one beyond all longs."""
    scaled = F.transform(vector.cast("array<double>"), lambda x: F.floor(F.when(F.abs(x * times) < 9e18, x * times)))
    return F.when(~F.exists(scaled, lambda x: x.isNull()), scaled)


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of doubles; shorter ones are followed by zeros."""
    flat, ends = np.asarray(vectors.flatten()), np.concatenate(([0], np.cumsum(np.asarray(vectors.value_lengths()))))
    if len(flat) == len(vectors) * width:
        return flat.reshape(len(vectors), width).astype(float)
    out = np.zeros((len(vectors), width))
    for i in range(len(vectors)):
        out[i, : ends[i + 1] - ends[i]] = flat[ends[i] : ends[i + 1]]
    return out


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """The orthogonal matrix of the eigenvectors of all rows' second moments, of the greatest first. width ** 2 sums a task move."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column(0), width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["at", "sums"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[at] = held.get(at, 0.0) + np.frombuffer(sums)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([r.tobytes() for r in held.values()], pa.binary())], ["at", "sums"])

    got = to_driver(rows.select("vector").mapInArrow(moments, "at int, sums binary").repartition("at").mapInArrow(summed, "at int, sums binary"))
    total = np.zeros((width, width))
    for at, sums in zip(got.column("at").to_pylist(), got.column("sums").to_pylist(), strict=True):
        total[at] = np.frombuffer(sums)
    return np.linalg.eigh(total)[1][:, ::-1]


def first(key: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the first k of each key, by score from the greatest, then by id."""
    order = np.lexsort((ids, -score, key))
    sorted_key = key[order]
    begun = np.searchsorted(sorted_key, sorted_key)
    return order[np.arange(len(order)) - begun < k]


class Rated:
    """Anchors rated against rows, `AT_ONCE` rows at a time. For each anchor there are windows (low, high) of scores asked for,
    each of which takes the first k rows; what a window has k of raises its low end."""

    def __init__(self, anchors: np.ndarray, turned: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.anchors, self.turned, self.k = anchors, turned, k
        self.high, self.least = high, low.copy()
        self.edges = sorted({*(int(anchors.shape[1] * s) for s in STAGES), anchors.shape[1]} - {0})
        self.rest = _rests(turned, self.edges)
        self.key, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, rows: np.ndarray, turned: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Rate rows, of which an anchor may take the allowed ones (anchors x rows)."""
        rest = _rests(turned, self.edges)
        slack = SLACK * self.rest[0][:, None] * rest[0][None, :] + 0.5  # whole numbers apart
        at, alive, product, begun = np.arange(len(rows)), allowed, np.zeros(allowed.shape), 0
        lowest, highest = self.least.min(axis=1)[:, None], self.high.max(axis=1)[:, None]
        for k, end in enumerate(self.edges):
            product += self.turned[:, begun:end] @ turned[at, begun:end].T
            bound = self.rest[k + 1][:, None] * rest[k + 1][at][None, :] + slack
            alive = alive & (product + bound >= lowest) & (product - bound <= highest)
            keep = alive.any(axis=0)
            if not keep.all():
                at, alive, product, slack = at[keep], alive[:, keep], product[:, keep], slack[:, keep]
            begun = end
            if not len(at):
                return
        for j in range(self.high.shape[1]):
            low, high = self.least[:, j : j + 1], self.high[:, j : j + 1]
            inside = alive & (product + slack >= low) & (product - slack <= high)
            if product.shape[1] > self.k:  # the k-th that is inside for sure: what is surely below it is not among the first k
                sure = np.where(alive & (product - slack >= low) & (product + slack <= high), product - slack, -np.inf)
                inside &= product + slack >= np.partition(sure, -self.k, axis=1)[:, -self.k][:, None]
            a, x = np.nonzero(inside)
            score = _products(self.anchors, rows, a, at[x])
            good = (score >= self.least[a, j]) & (score <= self.high[a, j])
            self._take(a[good] * self.high.shape[1] + j, score[good], ids[at[x[good]]])

    def _take(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        key, score, ids = np.concatenate((self.key, key)), np.concatenate((self.score, score)), np.concatenate((self.ids, ids))
        best = first(key, score, ids, self.k)
        self.key, self.score, self.ids = key[best], score[best], ids[best]
        full = np.flatnonzero(np.bincount(self.key, minlength=self.high.size) == self.k)
        last = np.searchsorted(self.key, full, side="right") - 1
        self.least.reshape(-1)[full] = np.maximum(self.least.reshape(-1)[full], self.score[last])


def _rests(turned: np.ndarray, edges: list[int]) -> list[np.ndarray]:
    """Norms of the whole vectors, then of what is left after each edge, rounded up."""
    squares = np.concatenate((np.zeros((len(turned), 1)), np.cumsum((turned**2)[:, ::-1], axis=1)), axis=1)[:, ::-1]
    return [np.sqrt(squares[:, e]) * (1 + 1e-9) for e in (0, *edges)]


def _products(anchors: np.ndarray, rows: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products of pairs, some at a time."""
    out = np.zeros(len(a), np.int64)
    for i in range(0, len(a), 1 << 14):
        out[i : i + (1 << 14)] = np.einsum("ij,ij->i", anchors[a[i : i + (1 << 14)]], rows[x[i : i + (1 << 14)]])
    return out


_NONE, _ALL = -(1 << 62), 1 << 62


def _met(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """The rows of each block beside the anchors of each block, grouped. A row goes to every block of anchors, an anchor to
    every block of rows: ANCHORS and ROWS at a time, the least that two sides which all meet can be moved."""
    blocks, sides = max(1, -(-n_rows // ROWS)), max(1, -(-n_anchors // ANCHORS))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(dealt(blocks).alias("block"), every(sides).alias("anchors"), F.lit(False).alias("is_anchor"), "id", "label", "vector", F.lit(None).cast("array<bigint>").alias("scores"))
    right = anchors.select(every(blocks).alias("block"), dealt(sides).alias("anchors"), F.lit(True).alias("is_anchor"), "id", "label", "vector", "scores")
    return left.unionByName(right).groupBy("block", "anchors")


def _rated(met, turn, width: int, k: int, same: bool, low: int, high: int) -> DataFrame:  # noqa: ANN001
    """(anchor_id, positive_score, id, score): the first k rows in each block of the same label, or of others in the windows of
    the anchor's scores."""

    def run(group: pa.Table) -> pa.Table:
        label = group.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        ids, is_anchor = group.column("id").to_numpy(), group.column("is_anchor").to_numpy(zero_copy_only=False)
        whole = _matrix(group.column("vector").combine_chunks(), width).astype(np.int64)
        a, x = np.flatnonzero(is_anchor), np.flatnonzero(~is_anchor)
        scores = [s or [] for s in group.column("scores").take(pa.array(a)).to_pylist()]
        wide = 1 if same else max(map(len, scores), default=0)
        least, most = np.full((len(a), wide), _ALL if not same else _NONE), np.full((len(a), wide), _NONE if not same else _ALL)
        for i, own in enumerate(scores if not same else []):
            least[i, : len(own)], most[i, : len(own)] = [-(-low * s // 100) for s in own], [high * s // 100 for s in own]
        schema = pa.schema([("anchor_id", pa.int64()), ("positive_score", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
        if not (len(a) and len(x) and wide):
            return schema.empty_table()
        rated = Rated(whole[a], whole[a] @ turn.value, least, most, k)
        for i in range(0, len(x), AT_ONCE):
            at = x[i : i + AT_ONCE]
            alike = label[a][:, None] == label[at][None, :]
            rated.add(whole[at], whole[at] @ turn.value, ids[at], alike & (ids[a][:, None] != ids[at][None, :]) if same else ~alike)
        own, j = rated.key // wide, rated.key % wide
        positive = None if same else pa.array([scores[o][w] for o, w in zip(own.tolist(), j.tolist(), strict=True)], pa.int64())
        return pa.Table.from_arrays([pa.array(ids[a][own]), pa.nulls(len(own), pa.int64()) if same else positive, pa.array(rated.ids), pa.array(rated.score)], schema=schema)

    return met.applyInArrow(run, "anchor_id bigint, positive_score bigint, id bigint, score bigint")


def mined(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows (id, label, vector) of usable().

    Scores are inner products; higher ones come first, then smaller ids. An anchor's positives are its first `positives` rows of
    the same label but for its own id, all if there are fewer. For each of them the first `negatives` rows of other labels
    whose score is between low and high hundredths of the positive's are its negatives, ranked from 1; there is none for a
    negative positive score. Equal rows and ties have the order of their ids. Vectors may differ in length: the shorter one counts
    as followed by zeros. An anchor without positives or negatives gives no rows, nor do empty tables. Each row goes once to
    every block of anchors; only the rotation, the square of the greatest length, is sent to executors.
    """
    session = rows.sparkSession
    rows = settled(rows)
    anchors = settled(anchors.select("id", "label", "vector"))
    n, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    n_anchors, width = anchors.count(), int(width or 0)
    turn = session.sparkContext.broadcast(rotation(rows, width))
    bare = anchors.withColumn("scores", F.lit(None).cast("array<bigint>"))
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    near = _rated(_met(rows, bare, n, n_anchors), turn, width, positives, True, low, high)
    near = settled(near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    asked = near.where("positive_score >= 0").groupBy("anchor_id").agg(F.array_sort(F.collect_set("positive_score")).alias("scores"))  # at most `positives` each
    asked = anchors.join(asked, F.col("id") == F.col("anchor_id")).select("id", "label", "vector", "scores")
    best = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("score"), "id")
    far = _rated(_met(rows, asked, n, n_anchors), turn, width, negatives, False, low, high)
    far = settled(far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives))
    far = far.select("anchor_id", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def prepared(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and anchors of a table (vec_id, embedding, label) as the query asks for them: components are the whole part of 256 times
    themselves, an id that 7 divides has the label after its own of ten, an id that 100 divides is an anchor."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(embeddings, "vec_id", label, whole_numbers(F.col("embedding"), 256.0))
    return rows, rows.where("id % 100 = 0")


#: The same as pairs of all anchors and all rows.
SQL = """
WITH rows AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
rated AS (
  SELECT a.id AS anchor_id, r.id, a.label = r.label AS alike, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM rows a JOIN rows r ON a.id % 100 = 0 AND a.id <> r.id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM rated WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER own)::INTEGER AS rank, n.id AS negative_id, positive_score, n.score AS negative_score
FROM positives JOIN rated n USING (anchor_id)
WHERE NOT n.alike AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
WINDOW own AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER own <= 10
"""
