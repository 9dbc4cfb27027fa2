"""Language-model scoring by context-tree weighting over bytes, beside a unigram score of words.

The model is a tree of contexts of up to three preceding bytes. Each node holds, for each of the 255 binary decisions of
a byte, a Krichevsky-Trofimov estimator; the estimates of all depths along a context are mixed by their posterior
weights. All contexts that were counted are nodes, so that the model grows with what the input holds: a row of 256 numbers
a context, of which text has far fewer than 256 ** 3. Word counts stay distributed: the most frequent HEAVY words are sent to every executor, the rest of a
text's words are joined with their counts by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import SPACED, Words, chunks, settled

#: Words, at most, whose counts are sent to every executor (16 bytes each).
HEAVY = 1 << 19
#: Distinct keys that a task holds before it passes its counts on.
HELD = 1 << 20
_PAD = b"\0\0\0"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD, _GRAM, _TOTAL = 0, 1, 2


def _padded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, A-Z as a-z, each after three zero bytes; where each begins and ends."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = _FOLD[np.frombuffer(_PAD + _PAD.join(raw), np.uint8)]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(lengths + 3)
    return data, ends - lengths, ends


class _Counter:
    """Counts by key that are merged now and then."""

    def __init__(self):
        self.keys, self.counts, self.waiting = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.waiting += len(keys)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(at, np.concatenate(self.counts), len(keys)).astype(np.int64)
        self.keys, self.counts, self.waiting = [keys], [counts], 0
        return keys, counts

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.merged()
        self.__init__()
        return out


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, key, n) summed over all whole texts: words by hash, four-byte runs by code, and totals (0 tokens, 1 texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams, tokens, n = _Counter(), _Counter(), 0, 0

        def batch_of(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind), pa.int8()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["kind", "key", "n"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            n += len(texts)
            for a, b in chunks(texts):
                w = Words(texts[a:b], SPACED)
                tokens += len(w.hashes)
                words.add(*np.unique(w.hashes.view(np.int64), return_counts=True))
                data, begins, ends = _padded(texts[a:b])
                if len(data) > 3:
                    wide = data.astype(np.uint32)
                    code = (wide[:-3] << np.uint32(24)) | (wide[1:-2] << np.uint32(16)) | (wide[2:-1] << np.uint32(8)) | wide[3:]
                    own = np.zeros(len(data) + 1, np.int8)
                    np.add.at(own, begins, 1)
                    np.add.at(own, ends, -1)
                    keys, counts = np.unique(code[np.cumsum(own[:-1])[3:] > 0], return_counts=True)
                    grams.add(keys.astype(np.int64), counts)
                for kind, held in ((_WORD, words), (_GRAM, grams)):
                    if held.waiting > HELD and len(held.merged()[0]) > HELD // 2:
                        yield batch_of(kind, *held.taken())
        yield batch_of(_WORD, *words.taken())
        yield batch_of(_GRAM, *grams.taken())
        yield batch_of(_TOTAL, np.array([0, 1]), np.array([tokens, n]))

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "kind tinyint, key bigint, n bigint")
    return parts.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 0.5, by Stirling's series eight further on."""
    z = x + 8
    series = (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return series - sum(np.log(x + i) for i in range(8))


class Tree:
    """The context tree: a row of log10 probabilities of the 256 bytes for each context that scoring tells apart."""

    def __init__(self, three: tuple[np.ndarray, np.ndarray], four: tuple[np.ndarray, np.ndarray]):
        """Counts of (two bytes, next) by code, and of (three bytes, next) for the contexts that are nodes."""
        code, n = three
        pairs, at2 = np.unique(code >> 8, return_inverse=True)
        count2 = self._dense(at2, code & 255, n, len(pairs))
        firsts, at1 = np.unique(pairs & 255, return_inverse=True)
        count1 = np.zeros((len(firsts), 256))
        np.add.at(count1, at1, count2)
        count0 = count1.sum(axis=0, keepdims=True)
        code, n = four
        order = np.argsort(code >> 8, kind="stable")
        code, n = code[order], n[order]
        triples, at3 = np.unique(code >> 8, return_inverse=True)
        above = np.searchsorted(pairs, triples & 0xFFFF)
        rest = count2.copy()
        np.subtract.at(rest, (above[at3], code & 255), n)

        # weights: from the leaves up, log of the weighted and of the estimated probability at each decision
        parts2 = self._estimate(self._decisions(rest))
        step = 2048
        bounds = np.searchsorted(at3, np.arange(0, len(triples) + step, step))
        dense = lambda i: self._dense(at3[bounds[i] : bounds[i + 1]] - i * step, (code & 255)[bounds[i] : bounds[i + 1]], n[bounds[i] : bounds[i + 1]], min(step, len(triples) - i * step))
        blocks = range(len(bounds) - 1) if len(triples) else range(0)
        for i in blocks:
            np.add.at(parts2, above[i * step : (i + 1) * step], self._estimate(self._decisions(dense(i))))
        stop2, whole2 = self._weigh(self._decisions(count2), parts2)
        parts1 = np.zeros((len(firsts), 255))
        np.add.at(parts1, at1, whole2)
        stop1, whole1 = self._weigh(self._decisions(count1), parts1)
        stop0, _ = self._weigh(self._decisions(count0), whole1.sum(axis=0, keepdims=True))

        # predictions: from the root down
        blend = lambda p, stop, kt: p[0] + p[1] * stop * kt
        kt0, kt1, kt2 = (self._next(self._decisions(c)) for c in (count0, count1, count2))
        p0, left0 = stop0 * kt0, 1 - stop0
        p1 = p0 + left0 * stop1 * kt1
        left1 = left0 * (1 - stop1)
        p2 = blend((p1[at1], left1[at1]), stop2, kt2)
        left2 = left1[at1] * (1 - stop2)
        rows = [self._logs(p0 + left0 / 2), self._logs(p1 + left1 / 2), self._logs(p2 + left2 * self._next(self._decisions(rest)))]
        for i in blocks:
            up = above[i * step : (i + 1) * step]
            rows.append(self._logs(p2[up] + left2[up] * self._next(self._decisions(dense(i)))))
        self.table = np.concatenate(rows)
        # rows: 0 for contexts whose last byte is new, then those of one byte, of two, of three
        seen = np.unique(np.concatenate((pairs & 255, pairs >> 8, triples >> 16, [0])))
        self.place = np.zeros(256, np.int32)
        self.place[seen] = np.arange(1, len(seen) + 1)
        size = len(seen) + 1
        self.size = size
        where = np.zeros((size, size, size), np.int32)  # of (b3, b2, b1)
        where[:, :, self.place[firsts]] = 1 + np.arange(len(firsts), dtype=np.int32)
        where[:, self.place[pairs >> 8], self.place[pairs & 255]] = 1 + len(firsts) + np.arange(len(pairs), dtype=np.int32)
        where[self.place[triples >> 16], self.place[triples >> 8 & 255], self.place[triples & 255]] = 1 + len(firsts) + len(pairs) + np.arange(len(triples), dtype=np.int32)
        self.where = where.reshape(-1)

    @staticmethod
    def _dense(row: np.ndarray, byte: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
        return np.bincount(row * 256 + byte, n, rows * 256).reshape(rows, 256)

    @staticmethod
    def _decisions(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Zeros and ones at each of the 255 decisions, highest bit first."""
        zeros, ones = [], []
        for level in range(8):
            halves = count.reshape(len(count), 1 << level, 2, 128 >> level).sum(axis=3)
            zeros.append(halves[:, :, 0])
            ones.append(halves[:, :, 1])
        return np.concatenate(zeros, axis=1), np.concatenate(ones, axis=1)

    @staticmethod
    def _estimate(d: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """log of the Krichevsky-Trofimov probability of the decisions made."""
        zeros, ones = d
        return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - np.log(np.pi)

    @classmethod
    def _weigh(cls, d: tuple[np.ndarray, np.ndarray], below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior weight of stopping at each node, and log of its weighted probability."""
        own = cls._estimate(d)
        whole = np.logaddexp(own, below) - np.log(2)
        return np.exp(own - np.log(2) - whole), whole

    @staticmethod
    def _next(d: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The probability that the next decision is a one."""
        return (d[1] + 0.5) / (d[0] + d[1] + 1)

    @staticmethod
    def _logs(one: np.ndarray) -> np.ndarray:
        """log10 probability of each byte from its decisions'."""
        one = np.clip(one, 1e-30, 1 - 1e-12)
        byte, out = np.arange(256), np.zeros((len(one), 256))
        for level in range(8):
            node = (1 << level) - 1 + (byte >> (8 - level))
            bit = (byte >> (7 - level)) & 1
            p = one[:, node]
            out += np.log10(np.where(bit, p, 1 - p))
        return out.astype(np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """log10 probability of each whole text."""
        data, begins, ends = _padded(texts)
        place = self.place[data].astype(np.int64)
        context = (place[:-3] * self.size + place[1:-2]) * self.size + place[2:-1]
        value = self.table.reshape(-1)[self.where[context].astype(np.int64) * 256 + data[3:]]
        total = np.concatenate((np.zeros(4), np.cumsum(value, dtype=np.float64)))
        return total[ends] - total[begins]


def tree(grams: DataFrame) -> Tree:
    """The tree from (key, n) of four-byte codes: all of them come to the driver, as the model they make does."""
    three = grams.groupBy(F.col("key").bitwiseAND(0xFFFFFF).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    four = grams.select("key", "n").toArrow()
    return Tree(*((t.column("key").to_numpy(), t.column("n").to_numpy()) for t in (three, four)))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text, null as empty, leaves 2 by 7."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 7 == 2


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """One row a row of docs: the id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    Learns from the rows that are not held out. Null text counts as empty: one token, the end, score 0, no bits. Repeated
    rows give a row each; a null id counts as an empty one; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    counts = settled(counted(own.where(~F.col("held_out"))))
    totals = {r["key"]: r["n"] for r in counts.where(F.col("kind") == _TOTAL).collect()}  # two rows
    ended = totals.get(1, 0)
    words = counts.where(F.col("kind") == _WORD).select("key", "n")
    size = F.floor(F.log2("n") * 4).alias("size")
    by_size = sorted(((r["size"], r["count"]) for r in words.groupBy(size).count().collect()), reverse=True)  # 256 rows at most
    seen, least = 0, None
    for s, c in by_size:
        if seen + c > heavy:
            break
        seen, least = seen + c, s
    distinct = sum(c for _, c in by_size) + (ended > 0)
    tokens = totals.get(0, 0) + ended
    log_all = float(np.log10(tokens + distinct + 1))
    is_heavy = size >= (least if least is not None else 1 << 20)
    often = words.where(is_heavy).toArrow()  # `heavy` rows at most
    keys, n = often.column("key").to_numpy(), often.column("n").to_numpy()
    order = np.argsort(keys)
    known = spark.sparkContext.broadcast((np.append(keys[order], np.iinfo(np.int64).max), np.append(n[order], 0)))
    model = spark.sparkContext.broadcast(tree(counts.where(F.col("kind") == _GRAM).select("key", "n")))
    kind = own.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = known.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out: list[list] = [[] for _ in range(7)]
            for a, b in chunks(texts):
                w = Words(texts[a:b], SPACED)
                owner = np.repeat(np.arange(b - a), w.counts)
                distinct, back = np.unique(w.hashes.view(np.int64), return_inverse=True)
                at = np.searchsorted(keys, distinct)
                count = np.where(keys[at] == distinct, n[at], 0)[back]
                found = count > 0
                out[0].append(w.counts + 1)
                out[1].append(np.bincount(owner, found, b - a).astype(np.int64))
                out[2].append(np.bincount(owner, np.where(found, np.log10(count + 1) - log_all, 0), b - a))
                rare_owner, rare = owner[~found], w.hashes.view(np.int64)[~found]
                out[3].append(np.searchsorted(rare_owner, np.arange(b - a)))
                out[4].append(rare)
                out[5].append(model.value.score(texts[a:b]))
                out[6].append(np.diff(w.text_starts) - 1)
            flat = [np.concatenate(x) if x else np.zeros(0) for x in out]
            shift = np.repeat(np.cumsum([0, *map(len, out[4])])[:-1], list(map(len, out[3]))) if out[3] else np.zeros(0)
            offsets = np.append(flat[3] + shift, len(flat[4])).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[4].astype(np.int64)))
            size = flat[6]
            bits = [(-s / np.log10(2) / z if z else None) for s, z in zip(flat[5], size, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(flat[0].astype(np.int64)), pa.array(flat[1].astype(np.int64)), pa.array(flat[2].astype(np.float64)), rare, pa.array(flat[5].astype(np.float64)), pa.array(bits, pa.float64())],
                ["id", "held_out", "n_tokens", "n_heavy", "heavy", "rare", "score", "bits_per_byte"],
            )

    rows = own.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens bigint, n_heavy bigint, heavy double, rare array<bigint>, score double, bits_per_byte double")
    rows = settled(rows.withColumn("row", F.monotonically_increasing_id()))
    # a text's rare words are summed per (row, word) before they meet their counts
    rare = rows.select("row", F.explode("rare").alias("key")).groupBy("key", "row").agg(F.count("*").alias("times"))
    rare = rare.join(words.where(~is_heavy), "key", "left")
    term = F.log10(F.coalesce("n", F.lit(0)) + 1) - log_all
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_rare"), F.sum(F.col("times") * term).alias("rare"))
    end = float(np.log10(ended + 1)) - log_all
    return (
        rows.drop("rare")
        .join(rare, "row", "left")
        .select(
            F.col("id").alias(id_col),
            "held_out",
            "n_tokens",
            (F.col("n_heavy") + F.coalesce("n_rare", F.lit(0)) + int(ended > 0)).cast("bigint").alias("n_known"),
            F.lit(tokens).cast("bigint").alias("train_tokens"),
            (F.col("heavy") + F.coalesce("rare", F.lit(0.0)) + end).alias("base_score"),
            "score",
            "bits_per_byte",
        )
    )
