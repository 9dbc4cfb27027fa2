"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

1. A five-word shingle weighs tf * (1 + ln((N + 1) / (df + SMOOTH * N + 1))). Document frequencies are summed in a count-min
   sketch of LINES lines of CELLS counters, less what a counter holds of others on average. A counter's error is a share of
   N that does not depend on N, and SMOOTH is chosen beside it, so that weights mean the same at every size: at 350
   shingles a text the others add 0.0013 N to a counter, nearly all of which is taken off again; what is left is a few
   hundredths of SMOOTH * N but where all LINES counters hold a shingle of SMOOTH * N texts or more, which befalls one
   shingle in 3,000 if 20,000 are as frequent.
2. Each text gets SAMPLES weighted samples, BANDS bands of ROWS. A text of little weight takes each sample from all its
   shingles; one of the weight of SPLIT_AT of the rarest shingles or more deals its shingles over the samples and takes each
   from its own share (an empty one borrows its neighbour's), so that the work is one evaluation a shingle. Texts between
   SPLIT_AT and OVERLAP times that do both, so that the ends of a link always have a scheme in common.
3. Copies are one node (equal words). Of buckets with the same nodes one is kept. In each bucket every node is compared with
   the most central one; pairs whose samples agree too rarely are left out, the others are verified on whole texts by
   weighted Jaccard similarity, and linked nodes make components.
4. In a bucket that still holds several components, all nodes of different ones are compared, exactly: in blocks of bounded
   size, the largest component's against the others', each pair of blocks by a task that gives at most a tree of links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import ALNUM, Words, chunks, mix, settled, to_driver
from siltstone.llm.graph import components

_U = np.uint64
#: Words of a shingle, and the least similarity of near duplicates.
SHINGLE, THRESHOLD = 5, 0.8
#: Bands, samples of a band; at similarity 0.8 a pair shares no band once in 5,000 times.
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
#: Shingles of the greatest weight from whose weight on a text's are dealt over the samples, and how far the two schemes overlap.
SPLIT_AT, OVERLAP = 128, 1.6
#: Lines and counters a line of the document frequencies (CELLS a power of 2), and the counters that move together.
LINES, CELLS, SLICE = 3, 1 << 18, 1 << 12
#: What is added to each document frequency, as a share of the documents.
SMOOTH = 1e-3
#: Samples that a pair must agree on to be verified; at similarity 0.8 fewer agree once in 10^5 times.
AGREEING = 16
#: Bytes of text and nodes of a block of a bucket; a longer text makes a larger one.
BLOCK_BYTES, BLOCK_NODES = 2 << 20, 1024
#: Texts of a shingle up to which its pairs are listed one by one.
LISTED = 16
#: Nodes whose keys (under 100 bytes each) are sent to every executor to pick their texts; more are joined by shuffle.
SENT = 400_000
#: Rounding that a similarity may lie below the threshold.
_SLACK = 1e-9

_RNG = np.random.default_rng(5)
_PLACE = _RNG.integers(1, 2**63, 8, dtype=np.uint64) * _U(2) + _U(1)
_SEED = _RNG.integers(0, 2**63, SAMPLES + 2, dtype=np.uint64)


def _gamma2(n: int) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2."""
    x = np.linspace(0, 40, 400_001)
    return np.interp((np.arange(n) + 0.5) / n, 1 - (1 + x) * np.exp(-x), x)


_R = _gamma2(1 << 12)
_LOG_C = np.log(_gamma2(1 << 16))


def _draw(x: np.ndarray, log_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log a and t of the samples of weight exp(log_w) whose randomness is x; the least a wins."""
    r = _R[(x & _U(0xFFF)).astype(np.int64)]
    log_c = _LOG_C[((x >> _U(12)) & _U(0xFFFF)).astype(np.int64)]
    beta = (x >> _U(40)).astype(np.float64) * 2.0**-24
    t = np.floor(log_w / r + beta)
    return log_c - r * (t - beta + 1), t


def _cells(hashes: np.ndarray, line: int) -> np.ndarray:
    """The counters of shingles in a line of the sketch."""
    return ((hashes >> _U(21 * line)) & _U(CELLS - 1)).astype(np.int64)


@dataclass
class Idf:
    """Weights of shingles from the document frequencies: counts by line and cell, and how many texts there are."""

    counts: np.ndarray
    n: int

    def __post_init__(self):
        total = self.counts.sum(axis=1, keepdims=True)
        self.counts = np.maximum(0, self.counts - (total - self.counts) / (CELLS - 1)).astype(np.float32)
        self.most = float(1 + np.log((self.n + 1) / (SMOOTH * self.n + 1)))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """1 + ln((N + 1) / (df + SMOOTH * N + 1)), at least 1."""
        frequency = self.counts[0][_cells(hashes, 0)]
        for line in range(1, LINES):
            frequency = np.minimum(frequency, self.counts[line][_cells(hashes, line)])
        return np.maximum(1.0, 1 + np.log((self.n + 1) / (frequency.astype(np.float64) + SMOOTH * self.n + 1)))


class Shingles:
    """The distinct shingles of some texts in order of text, with how often each stands there."""

    def __init__(self, texts: list[str | None], words: int = SHINGLE):
        self.words = w = Words(texts, ALNUM)
        n = len(w.hashes)
        text_of = np.repeat(np.arange(len(texts)), w.counts)
        made = np.zeros(max(0, n - words + 1), np.uint64)
        for j in range(words):
            made += w.hashes[j : j + len(made)] * _PLACE[j]
        inside = text_of[: len(made)] == text_of[words - 1 :] if len(made) else np.zeros(0, bool)
        made, owner = made[inside], text_of[: len(inside)][inside]
        few = np.flatnonzero((w.counts > 0) & (w.counts < words))
        if len(few):
            ones = [(w.hashes[w.bounds[i] : w.bounds[i + 1]] * _PLACE[: w.counts[i]]).sum(dtype=np.uint64) + _U(w.counts[i]) for i in few]
            made, owner = np.concatenate((made, np.array(ones, np.uint64))), np.concatenate((owner, few))
        made = mix(made)
        by = np.lexsort((made, owner))
        made, owner = made[by], owner[by]
        begin = np.ones(len(made), bool)
        begin[1:] = (made[1:] != made[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(begin)
        self.hashes, self.owner = made[at], owner[at]
        self.times = np.diff(np.append(at, len(made)))
        self.bounds = np.searchsorted(self.owner, np.arange(len(texts) + 1))

    def weights(self, idf: Idf) -> np.ndarray:
        """tf * idf of each."""
        return self.times * idf.of(self.hashes)

    def fingerprints(self, texts: list[str | None]) -> list[bytes]:
        """16 bytes that are equal for texts of equal words; those without a word go by their text."""
        w, out = self.words, []
        second = mix(w.hashes ^ _SEED[-1])
        n = len(w.hashes)
        power = np.multiply.accumulate(np.full(n + 1, _PLACE[5], np.uint64))
        a = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w.hashes * power[:n])))
        b = np.concatenate((np.zeros(1, np.uint64), np.cumsum(second * power[:n])))
        # the same words further on have the same sum times a power; undo it
        inverse = _U(pow(int(_PLACE[5]), -1, 2**64))
        back = np.multiply.accumulate(np.full(n + 1, inverse, np.uint64))
        s, e = w.bounds[:-1], w.bounds[1:]
        both = np.stack([(x[e] - x[s]) * back[s] + w.counts.astype(np.uint64) for x in (a, b)], axis=1)
        made = mix(both).tobytes()
        for i, text in enumerate(texts):
            if w.counts[i]:
                out.append(made[16 * i : 16 * i + 16])
            else:
                out.append(hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest())
        return out


def samples(s: Shingles, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Samples of each text by the first scheme and by the second, and which texts have each."""
    n_texts = len(s.bounds) - 1
    size, weight = np.diff(s.bounds), s.weights(idf)
    log_w = np.log(weight)
    # a link bounds how far the weights of its ends differ, hence the bounds are of weight
    mass = np.bincount(s.owner, weight, n_texts)
    whole, dealt = (size > 0) & ((mass < idf.most * SPLIT_AT * OVERLAP) | (size < SPLIT_AT * OVERLAP)), mass >= idf.most * SPLIT_AT
    first, second = np.zeros((n_texts, SAMPLES), np.uint64), np.zeros((n_texts, SAMPLES), np.uint64)

    pick = whole[s.owner]
    h, lw, own = s.hashes[pick], log_w[pick], s.owner[pick]
    if len(h):
        begins = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        counts = np.diff(np.append(begins, len(own)))
        for k in range(SAMPLES):
            a, t = _draw(mix(h ^ _SEED[k]), lw)
            won = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, begins), counts))[::-1]
            first[own[won], k] = mix(h[won] ^ (t[won].astype(np.int64).astype(np.uint64) * _PLACE[6]))

    pick = dealt[s.owner]
    h, lw, own = s.hashes[pick], log_w[pick], s.owner[pick]
    if len(h):
        a, t = _draw(mix(h ^ _SEED[SAMPLES]), lw)
        share = ((mix(h ^ _SEED[SAMPLES + 1]) >> _U(32)) * _U(SAMPLES) >> _U(32)).astype(np.int64)
        group = own * SAMPLES + share
        best = np.full(n_texts * SAMPLES, np.inf)
        np.minimum.at(best, group, a)
        won = np.flatnonzero(a == best[group])[::-1]
        second.reshape(-1)[group[won]] = mix(h[won] ^ (t[won].astype(np.int64).astype(np.uint64) * _PLACE[6]))
        empty = (np.isinf(best).reshape(n_texts, SAMPLES)) & dealt[:, None]
        while empty.any():
            lent, still = np.roll(second, -1, axis=1), np.roll(empty, -1, axis=1)
            take = empty & ~still
            second[take] = mix(lent[take] + _PLACE[7])
            empty &= ~take
    return first, second, whole, dealt


def _bands(sample: np.ndarray, scheme: int) -> np.ndarray:
    """A hash for each band of each text."""
    out = np.zeros((len(sample), BANDS), np.uint64)
    for i in range(ROWS):
        out += sample[:, i::ROWS] * _PLACE[i]
    return mix(out + (np.arange(BANDS, dtype=np.uint64) * _U(2) + _U(scheme)) * _PLACE[4])


def document_frequencies(docs: DataFrame, text_col: str = "text", words: int = SHINGLE) -> Idf:
    """The sketch of all whole texts: summed in each task, then by slices, of which the driver gets one each."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros((LINES, CELLS), np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            n += len(texts)
            for a, b in chunks(texts):
                hashes = Shingles(texts[a:b], words).hashes
                for line in range(LINES):
                    counts[line] += np.bincount(_cells(hashes, line), minlength=CELLS)
        slices = counts.reshape(-1, SLICE)
        at = np.flatnonzero(slices.any(axis=1))
        packed = [slices[i].astype(np.min_scalar_type(slices[i].max())) for i in at] + [np.array([n], np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([x.itemsize for x in packed], pa.int32()), pa.array([x.tobytes() for x in packed], pa.binary())], ["slice", "width", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, width, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                counts = np.frombuffer(packed, f"<u{width}").astype(np.int64)
                held[at] = held[at] + counts if at in held else counts
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["slice", "counts"])

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(counted, "slice int, width int, counts binary")
    got = to_driver(parts.repartition("slice").mapInArrow(summed, "slice int, counts binary"))  # LINES * CELLS / SLICE + 1 rows
    counts, n = np.zeros((LINES * CELLS // SLICE, SLICE), np.int64), 0
    for at, packed in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
        if at < 0:
            n = int(np.frombuffer(packed, np.int64)[0])
        else:
            counts[at] = np.frombuffer(packed, np.int64)
    return Idf(counts.reshape(LINES, CELLS), n)


def _lists(values: np.ndarray, has: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list a row of the values that it has."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(has.sum(axis=1)))), pa.int32()), pa.array(values[has], kind))


def _key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """128 bits by which a row's id and text are told apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.xxhash64(F.col(id_col), text), F.xxhash64(F.lit(1), text, F.col(id_col))]


def signatures(docs: DataFrame, idf, id_col: str, text_col: str, words: int = SHINGLE) -> DataFrame:  # noqa: ANN001
    """id, k1 and k2 (of id and text), fp (of the words), size (bytes), bands, and the samples by either scheme (empty where it does not apply)."""
    k1, k2 = _key(docs, id_col, text_col)
    kept = docs.select(F.col(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).cast("string").alias("text"))
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts):
                s = Shingles(texts[a:b], words)
                one, two, whole, dealt = samples(s, idf.value)
                has = np.repeat(np.stack((whole, dealt), axis=1), BANDS, axis=1)
                bands = np.concatenate((_bands(one, 0), _bands(two, 1)), axis=1).view(np.int64)
                drawn = [_lists((x & _U(0xFFFFFFFF)).astype(np.uint32).view(np.int32), np.repeat(h[:, None], SAMPLES, axis=1), pa.int32()) for x, h in ((one, whole), (two, dealt))]
                own = [batch.column(c).slice(a, b - a) for c in ("id", "k1", "k2")]
                size = np.diff(s.words.text_starts) - 1
                yield pa.RecordBatch.from_arrays([*own, pa.array(s.fingerprints(texts[a:b]), pa.binary()), pa.array(size, pa.int64()), _lists(bands, has, pa.int64()), *drawn], ["id", "k1", "k2", "fp", "size", "bands", "first", "second"])

    return kept.mapInArrow(run, f"id {kind}, k1 bigint, k2 bigint, fp binary, size bigint, bands array<bigint>, first array<int>, second array<int>")


def _texts(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(fp, text) of nodes (fp, k1, k2), a row each, kept."""
    nodes = settled(nodes)
    nodes = F.broadcast(nodes) if nodes.count() <= SENT else nodes
    k1, k2 = _key(docs, id_col, text_col)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return settled(rows.join(nodes, ["k1", "k2"]).groupBy("fp").agg(F.first("text").alias("text")))


def _verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, idf, id_col: str, text_col: str, threshold: float, words: int) -> DataFrame:  # noqa: ANN001
    """The pairs (a, b) of nodes whose weighted Jaccard similarity is `threshold` or more."""
    ends = [nodes.select(F.col("fp").alias(s), F.col("first").alias(f"first_{s}"), F.col("second").alias(f"second_{s}")) for s in "ab"]

    def agree(x: str) -> Column:
        return F.aggregate(F.zip_with(f"{x}_a", f"{x}_b", lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda n, y: n + y)

    both = pairs.join(ends[0], "a").join(ends[1], "b")
    both = settled(both.where((agree("first") >= AGREEING) | (agree("second") >= AGREEING)).select("a", "b"))
    sought = both.select(F.col("a").alias("fp")).unionByName(both.select(F.col("b").alias("fp"))).distinct()
    texts = _texts(nodes.select("fp", "k1", "k2").join(sought, "fp"), docs, id_col, text_col)
    full = both.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("text_a", "text_b"))
            good: list[bool] = []
            for lo, hi in chunks([x + y for x, y in zip(a, b, strict=True)]):
                at = {x: i for i, x in enumerate(dict.fromkeys(a[lo:hi] + b[lo:hi]))}
                s = Shingles(list(at), words)
                w = s.weights(idf.value)
                known = [(s.hashes[p:q], w[p:q], w[p:q].sum()) for p, q in zip(s.bounds[:-1], s.bounds[1:], strict=True)]
                for x, y in zip(a[lo:hi], b[lo:hi], strict=True):
                    (h, v, m), (k, u, n) = known[at[x]], known[at[y]]
                    _, i, j = np.intersect1d(h, k, assume_unique=True, return_indices=True)
                    shared = np.minimum(v[i], u[j]).sum()
                    good.append(bool(shared >= threshold * (m + n - shared) - _SLACK))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return full.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def similar(s: Shingles, weights: np.ndarray, lo: int, hi: int, threshold: float) -> np.ndarray:
    """Which of the texts lo to hi are near duplicates of which, by exact weighted Jaccard similarity, as a matrix.

    What two texts share is summed shingle by shingle; of a shingle that stands in a text several times, each time counts
    as one of its own. Frequent ones are summed by products of matrices, rare ones pair by pair.
    """
    n = hi - lo
    at = slice(s.bounds[lo], s.bounds[hi])
    owner, times = s.owner[at] - lo, s.times[at]
    mass = np.bincount(owner, weights[at], n)
    again = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    owner, unit = np.repeat(owner, times), np.repeat(weights[at] / times, times)
    _, column, count = np.unique(np.repeat(s.hashes[at], times) + again.astype(np.uint64) * _PLACE[7], return_inverse=True, return_counts=True)
    shared = np.zeros((n, n))

    pick = np.flatnonzero(count[column] > LISTED)
    if len(pick):
        by = pick[np.argsort(column[pick], kind="stable")]
        _, own = np.unique(column[by], return_inverse=True)
        step = max(1, (1 << 22) // n)
        cuts = np.searchsorted(own, np.arange(0, own[-1] + step + 1, step))
        for k, (p, q) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if p < q:
                flat = np.zeros((n, min(step, own[-1] + 1 - k * step)))
                value = np.zeros(flat.shape[1])
                flat[owner[by[p:q]], own[p:q] - k * step] = 1
                value[own[p:q] - k * step] = unit[by[p:q]]
                shared += (flat * value) @ flat.T

    pick = np.flatnonzero((count[column] > 1) & (count[column] <= LISTED))
    by = pick[np.argsort(column[pick], kind="stable")]
    for d in range(1, LISTED):
        p = by[:-d][column[by[:-d]] == column[by[d:]]] if len(by) > d else by[:0]
        if not len(p):
            break
        q = by[d:][column[by[:-d]] == column[by[d:]]]
        np.add.at(shared, (owner[p], owner[q]), unit[p])
        np.add.at(shared, (owner[q], owner[p]), unit[p])
    return shared >= threshold * (mass[:, None] + mass[None, :] - shared) - _SLACK


def _tree(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that hold together what the matrix links."""
    seen, out = np.zeros(len(linked), bool), []
    for i in range(len(linked)):
        if not seen[i]:
            seen[i], open_ = True, [i]
            while open_:
                u = open_.pop()
                new = np.flatnonzero(linked[u] & ~seen)
                seen[new] = True
                out += [(u, v) for v in new.tolist()]
                open_ += new.tolist()
    return out


def _blocks(star: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, g, h, fp, root): the nodes of buckets of several components, each with the pairs of blocks it belongs to.

    A bucket's leader is left out, for all have been compared with it. The nodes of the largest component are dealt to
    blocks of their own and meet only those of the others, which meet each other too: g is a block of the others, h a
    further one or one of the largest component.
    """
    placed = settled(star.join(roots, F.col("fp") == F.col("node"), "left").select("bucket", "fp", "size", F.coalesce("root", "fp").alias("root")))
    held = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    many = lambda n, size: F.ceil(F.greatest(n / BLOCK_NODES, size / BLOCK_BYTES, F.lit(1.0))).cast("int")
    top = F.max(F.struct("size", "root", "n")).alias("top")
    several = held.groupBy("bucket").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum("size").alias("size"), top).where("roots > 1")
    several = settled(several.select("bucket", F.col("top.root").alias("most"), many(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("p"), many(F.col("top.n"), F.col("top.size")).alias("q")))
    rows = placed.join(several, "bucket")
    dealt = F.xxhash64("fp")
    mine = F.when(F.col("root") == F.col("most"), F.pmod(dealt, F.col("q"))).otherwise(F.pmod(dealt, F.col("p"))).cast("int")
    rows = rows.withColumn("own", mine)
    others = F.sequence(F.lit(0), F.col("p") - 1)
    pair = lambda g, h: F.struct(g.alias("g"), h.alias("h"))
    of_most = F.transform(others, lambda g: pair(g, F.col("p") + F.col("own")))
    of_rest = F.concat(
        F.transform(F.filter(others, lambda j: j != F.col("own")), lambda j: pair(F.least(j, F.col("own")), F.greatest(j, F.col("own")))),
        F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda j: pair(F.col("own"), F.col("p") + j)),
    )
    met = F.explode(F.when(F.col("root") == F.col("most"), of_most).otherwise(of_rest)).alias("met")
    return rows.select("bucket", "fp", "root", met).select("bucket", "met.g", "met.h", "fp", "root")


def _across(met: DataFrame, nodes: DataFrame, docs: DataFrame, idf, id_col: str, text_col: str, threshold: float, words: int) -> DataFrame:  # noqa: ANN001
    """Links (a, b) between the components of the rows of _blocks(): within each pair of blocks a tree of them at most."""
    met = settled(met)
    texts = _texts(nodes.select("fp", "k1", "k2").join(met.select("fp").distinct(), "fp"), docs, id_col, text_col)
    rows = met.join(texts, "fp").repartition("bucket", "g", "h").sortWithinPartitions("bucket", "g", "h")

    def links(group: pa.Table) -> pa.RecordBatch:
        """Of whole groups in order."""
        keys = [group.column(c).to_numpy() for c in ("bucket", "g", "h")]
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        bounds = np.concatenate(([0], cut, [group.num_rows])).tolist()
        texts, root = group.column("text").to_pylist(), group.column("root").to_pylist()
        a, b, k = [], [], 0
        while k < len(bounds) - 1:
            end = k + 1
            while end < len(bounds) - 1 and sum(map(len, texts[bounds[k] : bounds[end + 1]])) <= 1 << 20:
                end += 1
            begin = bounds[k]
            s = Shingles(texts[begin : bounds[end]], words)
            w = s.weights(idf.value)
            for lo, hi in zip(bounds[k:end], bounds[k + 1 : end + 1], strict=True):
                for u, v in _tree(similar(s, w, lo - begin, hi - begin, threshold)):
                    if root[lo + u] != root[lo + v]:
                        a.append(min(root[lo + u], root[lo + v]))
                        b.append(max(root[lo + u], root[lo + v]))
            k = end
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in ("bucket", "g", "h")]
            last = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
            at = int(last[-1]) + 1 if len(last) else 0  # where the last group of the batch begins
            same = held and all(held[-1].column(c)[-1] == batch.column(c)[0] for c in ("bucket", "g", "h"))
            if held and (at or not same):
                yield links(pa.Table.from_batches([*held, *([batch.slice(0, at)] if at else [])]))
                held = [batch.slice(at)]
            elif at:
                yield links(pa.Table.from_batches([batch.slice(0, at)]))
                held = [batch.slice(at)]
            else:
                held.append(batch)
        if held:
            yield links(pa.Table.from_batches(held))

    return rows.select("bucket", "g", "h", "root", "text").mapInArrow(run, "a binary, b binary").distinct()


def _rooted(docs: DataFrame, id_col: str, text_col: str, threshold: float, words: int) -> DataFrame:
    """(id, k1, k2, root) a row of docs: the key of id and text, and the class."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(document_frequencies(docs, text_col, words))
    rows = settled(signatures(docs, idf, id_col, text_col, words))
    own = F.min(F.struct("id", "k1", "k2"))
    nodes = settled(rows.groupBy("fp").agg(own.alias("own"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("first").alias("first"), F.first("second").alias("second")).select("fp", "own.k1", "own.k2", "size", "bands", "first", "second"))
    buckets = nodes.select("fp", "size", F.explode("bands").alias("bucket"))
    held = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "fp")).alias("y")).where("n > 1")
    held = held.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"))
    buckets = settled(buckets.join(held.select("bucket", "n"), "bucket"))
    # the node that shares most buckets with most others leads: in a group of copies, the one nearest to all
    central = buckets.groupBy("fp").agg(F.sum("n").alias("central"))
    buckets = settled(buckets.join(central, "fp").select("bucket", "fp", "size", "central", "n"))
    near = settled(nodes.join(buckets.select("fp").distinct(), "fp").select("fp", "k1", "k2", "first", "second"))
    led = settled(buckets.groupBy("bucket").agg(F.max(F.struct("central", "fp"))["fp"].alias("lead")))
    star = settled(buckets.join(led, "bucket").where("lead != fp").select("bucket", "fp", "size", "lead", "n"))
    pairs = settled(star.select(F.least("lead", "fp").alias("a"), F.greatest("lead", "fp").alias("b")).distinct())
    roots = components(settled(_verify(pairs, docs, near, idf, id_col, text_col, threshold, words)))
    more = settled(_across(_blocks(star.where("n > 2"), roots), near, docs, idf, id_col, text_col, threshold, words))
    named = rows.select("id", "k1", "k2", "fp").join(roots, F.col("fp") == F.col("node"), "left").select("id", "k1", "k2", F.coalesce("root", "fp").alias("root"))
    if more.take(1):
        again = components(more).select(F.col("node").alias("root"), F.col("root").alias("whole"))
        named = named.join(again, "root", "left").select("id", "k1", "k2", F.coalesce("whole", "root").alias("root"))
    return settled(named)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = SHINGLE) -> DataFrame:
    """One row a row of docs: the id, class_id (the least id of its class) and n_class (rows in the class).

    Texts are near duplicates if the weighted Jaccard similarity of their shingles is `threshold` or more, and so are those
    linked by others. Case and what is not a word do not count; a text of fewer words than a shingle is one shingle; texts
    without a word, null among them as empty, are only like equal ones. Rows may repeat, also with one id and other texts;
    null ids are kept, and name no class unless all its ids are null. Texts are taken whole; other columns are not read;
    an empty table gives no rows.
    """
    named = _rooted(docs, id_col, text_col, threshold, words)
    names = settled(named.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("n_class")))
    return named.join(names, "root").select(F.col("id").alias(id_col), "class_id", "n_class")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = SHINGLE) -> DataFrame:
    """The rows of docs of which each class keeps one, that of the least id; see classes(). Columns may have any names."""
    named = _rooted(docs, id_col, text_col, threshold, words)
    best = settled(named.groupBy("root").agg(F.min(F.struct("id", "k1", "k2")).alias("best")))
    again = named.groupBy("k1", "k2").count().where("count > 1").limit(1).count()  # rows of equal id and text
    gone = named.join(best, "root").where((F.col("k1") != F.col("best.k1")) | (F.col("k2") != F.col("best.k2")))
    free = lambda x: next(n for n in (x + "_" * i for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    k, g = [free("k1"), free("k2")], [free("g1"), free("g2")]
    gone = gone.select(F.col("k1").alias(g[0]), F.col("k2").alias(g[1])).distinct()
    kept = docs.withColumns(dict(zip(k, _key(docs, id_col, text_col), strict=True)))
    kept = kept.join(gone, (F.col(k[0]) == F.col(g[0])) & (F.col(k[1]) == F.col(g[1])), "left_anti")
    return (kept.dropDuplicates(k) if again else kept).drop(*k)
