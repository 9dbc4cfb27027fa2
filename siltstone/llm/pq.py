"""Near-duplicate vectors by product quantisation.

1. Equal vectors of one label are one node. Nodes are taken as unit vectors; a cosine of THRESHOLD is then a distance, the reach.
2. An index is fitted on a bounded sample (the least hashes of the nodes): coarse cells by k-means, and for each of PARTS
   subspaces of the residuals 256 codes by k-means. Every node is in the inverted list of its nearest cell, as codes and the
   exact length of what they leave out.
3. A node probes all lists of its label that can hold a vector within its reach: the distance to the list's centre is within
   the reach of the radii that the list has, and the bisector of both centres is not beyond the reach. These probes are
   sufficient by the triangle inequality, whatever the sample was like.
4. Lists and the nodes that probe them are dealt to blocks of bounded size by their hash, so that no label, list or group of near
   copies makes one. In a block asymmetric distances are looked up in tables; a pair goes if the distance to the codes less
   what they leave out is beyond the reach. The others are rated by their exact cosine in double precision.
5. A block passes on how many vectors each node is linked with and one row a node that ties its component, never its pairs.

No link is lost: both bounds are one-sided, with SLACK for single precision. How few pairs are left depends on the vectors: where
they have no clusters at all, nearly every list is probed and the tables alone save work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import settled, to_driver
from siltstone.llm.graph import components

#: The least cosine of near duplicates.
THRESHOLD = 0.93
#: Vectors, and numbers in them, that the index is fitted on at most.
SAMPLE, SAMPLE_NUMBERS = 8192, 1 << 22
#: Cells at most and nodes of a label that a cell is meant for; subspaces and codes of each.
CELLS, CELL_NODES, PARTS, CODES = 256, 2048, 16, 256
#: Nodes of a list and nodes that probe it in one block, and those looked up at once.
LISTED, PROBING, AT_ONCE = 2048, 4096, 256
#: Rows of cells sent to every executor; more are joined by shuffle.
SENT = 100_000
#: What single precision may add to a distance of unit vectors.
SLACK = 1e-4


def _means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k-means of the rows of x; centres that lose all their rows stay where they are."""
    centres = x[np.sort(np.random.default_rng(seed).permutation(len(x))[:k])].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


@dataclass
class Index:
    """Centres of the cells, and the codes of each subspace (parts x codes x numbers); width is padded to whole subspaces."""

    centres: np.ndarray
    codes: np.ndarray

    @classmethod
    def fitted(cls, sample: np.ndarray, cells: int) -> Index:
        parts, size = cls.shape(sample.shape[1])
        x = np.pad(sample, ((0, 0), (0, parts * size - sample.shape[1])))
        if not len(x):
            x = np.zeros((1, parts * size))
        centres = _means(x, min(cells, len(x)), 10, 1)
        left = x - centres[_nearest(x, centres)]
        codes = np.zeros((parts, CODES, size))
        for m in range(parts):
            own = _means(left[:, m * size : (m + 1) * size], CODES, 8, 2 + m)
            codes[m, : len(own)] = own
        return cls(centres, codes)

    @staticmethod
    def shape(width: int) -> tuple[int, int]:
        parts = max(1, min(PARTS, width))
        return parts, max(1, -(-width // parts))

    @property
    def width(self) -> int:
        return self.codes.shape[0] * self.codes.shape[2]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cells, codes, lengths of what the codes leave out, and distances to the centres."""
        cell = _nearest(x, self.centres)
        left = x - self.centres[cell]
        parts, size = self.codes.shape[0], self.codes.shape[2]
        code = np.stack([_nearest(left[:, m * size : (m + 1) * size], self.codes[m]) for m in range(parts)], axis=1).astype(np.uint8)
        away = left - np.concatenate([self.codes[m][code[:, m]] for m in range(parts)], axis=1)
        return cell, code, np.linalg.norm(away, axis=1), np.linalg.norm(left, axis=1)

    def distances(self, x: np.ndarray, cell: int, code: np.ndarray) -> np.ndarray:
        """Squared distances of the rows of x to the coded vectors of a cell, by a table a subspace."""
        left = (x - self.centres[cell]).astype(np.float32)
        parts, size = self.codes.shape[0], self.codes.shape[2]
        total = np.zeros((len(x), len(code)), np.float32)
        for m in range(parts):
            own, codes = left[:, m * size : (m + 1) * size], self.codes[m].astype(np.float32)
            table = (own**2).sum(axis=1)[:, None] - 2 * own @ codes.T + (codes**2).sum(axis=1)
            total += table[:, code[:, m]]
        return total


def _units(raw: list[bytes], width: int) -> np.ndarray:
    """Unit vectors of little-endian doubles, padded by zeros."""
    out = np.zeros((len(raw), width))
    for i, r in enumerate(raw):
        out[i, : len(r) // 8] = np.frombuffer(r)
    out /= np.abs(out).max(axis=1, keepdims=True)  # large and small numbers have norms too
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _nodes(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, label, k1, k2) a row of df, keys null where the vector links with nothing; and the nodes (label, k1, k2, node, n, vector)."""
    vector = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(id_col).alias("id"), F.when(good, F.col(label_col)).alias("label"), F.when(good, vector).alias("vector"))
    keyed = rows.select("id", "label", *(F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(s), "vector")).alias(f"k{s}") for s in (1, 2)), "vector")
    nodes = keyed.where("vector is not null").groupBy("label", "k1", "k2").agg(F.min("id").alias("node"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    return keyed.drop("vector"), nodes


def linked(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row a row of df: the id, n_links (other rows linked directly), component_id (the least id reachable, its own included)
    and kept (whether that is its own).

    Rows are linked if their labels are equal and the cosine of their vectors, in double precision, is `threshold` (above 0) or more;
    equal vectors always are. Null labels, ids or vectors, vectors of zeros or with a null or non-finite number, and empty ones
    link with nothing; a null id is kept and has no component. Vectors of different lengths are not compared. Rows may repeat,
    each counts as a link of the others; where an id has several vectors, they are in one component, and links add up for rows
    that are the least of theirs. Other columns are not read; an empty table gives no rows.
    """
    spark = df.sparkSession
    rows, nodes = _nodes(df, id_col, vector_col, label_col)
    nodes = settled(nodes.withColumn("size", F.size("vector")))
    groups = nodes.groupBy("label", "size").agg(F.count("*").alias("n"))
    largest, width = groups.agg(F.max("n"), F.max("size")).first()
    width, reach = int(width or 1), math.sqrt(2 - 2 * threshold) + SLACK
    picked = nodes.select(F.xxhash64("k1", "k2").alias("h"), "k1", "k2", "label", "vector").orderBy("h", "k1", "k2", "label").limit(min(SAMPLE, max(1, SAMPLE_NUMBERS // width)))
    picked = to_driver(picked.select("vector")).column("vector").to_pylist()
    parts, size = Index.shape(width)
    sample = _units([np.asarray(v).tobytes() for v in picked], parts * size)
    index = spark.sparkContext.broadcast(Index.fitted(sample, max(1, min(CELLS, -(-int(largest or 0) // CELL_NODES)))))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.asarray(v.values).tobytes() for v in batch.column("vector")]
            cell, code, out, away = index.value.encode(_units(raw, index.value.width))
            made = [pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(out), pa.array(away), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "size", "k1", "k2", "node", "n")), *made], ["label", "size", "k1", "k2", "node", "n", "cell", "code", "out", "away", "vector"])

    kind, label = nodes.schema["node"].dataType.simpleString(), nodes.schema["label"].dataType.simpleString()
    coded = f"label {label}, size int, k1 bigint, k2 bigint, node {kind}, n bigint, cell int, code binary, out double, away double, vector binary"
    entries = settled(nodes.select("label", "size", "k1", "k2", "node", "n", "vector").mapInArrow(encode, coded))
    lists = settled(entries.groupBy("label", "size", "cell").agg(F.count("*").alias("listed"), F.min("away").alias("inner"), F.max("away").alias("outer")))
    cells = lists.groupBy("label", "size").agg(F.collect_list(F.struct("cell", "listed", "inner", "outer")).alias("cells"))  # CELLS at most
    cells = F.broadcast(cells) if lists.count() <= SENT else cells

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = index.value.centres
        apart = np.linalg.norm(centres[:, None] - centres[None], axis=2)
        for batch in batches:
            x = _units(batch.column("vector").to_pylist(), index.value.width)
            cell, probes = batch.column("cell").to_numpy(), []
            to = np.sqrt(np.maximum(0, (centres**2).sum(axis=1) - 2 * x @ centres.T + 1))
            for i, own in enumerate(batch.column("cells").to_pylist()):
                there = np.array([c["cell"] for c in own])
                inner, outer = (np.array([c[k] for c in own]) for k in ("inner", "outer"))
                d, me = to[i, there], to[i, cell[i]]
                near = (d >= inner - reach) & (d <= outer + reach) & (d**2 - me**2 <= 2 * reach * apart[cell[i], there] + SLACK)
                probes.append([{"cell": int(there[j]), "listed": own[j]["listed"]} for j in np.flatnonzero(near & (there >= cell[i]))])
            kept = ["label", "size", "k1", "k2", "node", "n", "cell", "vector"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(probes, pa.list_(pa.struct([("cell", pa.int32()), ("listed", pa.int64())])))], [*kept, "probes"])

    asking = entries.join(cells, ["label", "size"]).select("label", "size", "k1", "k2", "node", "n", "cell", "vector", "cells")
    asking = asking.mapInArrow(probe, f"label {label}, size int, k1 bigint, k2 bigint, node {kind}, n bigint, cell int, vector binary, probes array<struct<cell:int,listed:bigint>>")
    asking = settled(asking.select("label", "size", "k1", "k2", "node", "n", "vector", F.col("cell").alias("home"), F.explode("probes").alias("to")).select("*", "to.cell", "to.listed").drop("to"))
    asked = asking.groupBy("label", "size", "cell").agg(F.count("*").alias("probing"))
    lists = settled(lists.join(asked, ["label", "size", "cell"]).select("label", "size", "cell", "listed", "probing"))  # each list is probed by its own
    dealt = lambda of: F.pmod(F.xxhash64("k1", "k2"), of).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), of.cast("int") - 1))
    blocks, sides = F.ceil(F.col("listed") / LISTED), F.ceil(F.col("probing") / PROBING)
    shared = F.broadcast(lists) if lists.count() <= SENT else lists
    left = entries.join(shared, ["label", "size", "cell"]).select("label", "size", "cell", dealt(blocks).alias("block"), every(sides).alias("side"), "k1", "k2", "node", "n", F.lit(-1).alias("home"), "code", "out", "vector")
    right = asking.join(shared.drop("listed"), ["label", "size", "cell"]).select("label", "size", "cell", every(blocks).alias("block"), dealt(sides).alias("side"), "k1", "k2", "node", "n", "home", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("out"), "vector")

    def rate(group: pa.Table) -> pa.Table:
        home, node, n = (group.column(c).to_numpy() for c in ("home", "node", "n"))
        raw, cell = group.column("vector").to_pylist(), group.column("cell")[0].as_py()
        x = _units(raw, index.value.width)
        at, ask = np.flatnonzero(home < 0), np.flatnonzero(home >= 0)
        out = np.array([group.column("out")[int(i)].as_py() for i in at])
        code = np.frombuffer(b"".join(group.column("code")[int(i)].as_py() for i in at), np.uint8).reshape(len(at), -1)
        itself = {raw[i]: k for k, i in enumerate(at)}
        most = ((reach + out + SLACK) ** 2).astype(np.float32) + np.float32(SLACK)
        met = np.zeros((len(ask), len(at)), bool)
        for i in range(0, len(ask), AT_ONCE):
            q = ask[i : i + AT_ONCE]
            a, b = np.nonzero(index.value.distances(x[q], cell, code) <= most)
            for k in range(0, len(a), 1 << 14):
                u, v = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
                good = np.einsum("ij,ij->i", x[q[u]], x[at[v]]) >= threshold
                met[i + u[good], v[good]] = True
        for k, i in enumerate(ask):
            if home[i] == cell and raw[i] in itself:
                met[k, itself[raw[i]]] = False
        links = np.zeros(len(node), np.int64)
        links[ask] = met @ n[at]
        across = home[ask] != cell  # of one list both ends ask; else one does, and tells the other's number too
        links[at] = met[across].T @ n[ask[across]]
        tied, linked_ = _tied(met, node[ask], node[at])
        keep = np.concatenate((linked_[0], linked_[1]))
        order = np.concatenate((ask, at))[keep]
        return pa.Table.from_arrays([group.column("k1").take(pa.array(order)), group.column("k2").take(pa.array(order)), group.column("label").take(pa.array(order)), pa.array(links[order]), group.column("node").take(pa.array(order)), pa.array(tied[keep])], ["k1", "k2", "label", "links", "node", "peer"])

    found = left.unionByName(right).groupBy("label", "size", "cell", "block", "side").applyInArrow(rate, f"k1 bigint, k2 bigint, label {label}, links bigint, node {kind}, peer {kind}")
    found = settled(found)
    links = found.groupBy("label", "k1", "k2").agg(F.sum("links").alias("links"))
    tied = components(found.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    named = nodes.select("label", "k1", "k2", "node", "n").join(links, ["label", "k1", "k2"], "left").join(tied.withColumnRenamed("node", "tied"), F.col("node") == F.col("tied"), "left")
    named = settled(named.select("label", "k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id")))
    whole = rows.join(named, ["label", "k1", "k2"], "left")
    component = F.coalesce("component_id", "id")
    return whole.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _tied(met: np.ndarray, asking: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The least node that each is tied to within a block, of those that ask and then of the listed; and which have a link."""
    a, b = np.nonzero(met)
    left, right = asking.copy(), listed.copy()
    while len(a):
        before = left.copy(), right.copy()
        np.minimum.at(left, a, right[b])
        np.minimum.at(right, b, left[a])
        if (left == before[0]).all() and (right == before[1]).all():
            break
    return np.concatenate((left, right)), (met.any(axis=1), met.any(axis=0))


#: The same by all pairs, components by what each vector reaches.
SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, least(e.vec_id, coalesce(r.least_id, e.vec_id)) AS component_id, e.vec_id <= coalesce(r.least_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT a, min(b) AS least_id FROM reached GROUP BY a) r ON e.vec_id = r.a
"""
