"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. A bucket for each merge rank holds the places whose pair has that rank; a bitmap
of two levels tells which buckets hold any, so that the lowest rank is two find-first-set steps away. Places whose pair
has changed meanwhile are stale and skipped. The work on a pre-token of n bytes is O(n log n), also for very long ones.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import chunks

#: Bytes, as estimated, of the parts of texts that a worker remembers with their ids; beyond that it forgets all.
REMEMBERED = 80 << 20
#: Characters of the texts of a block; a longer text makes a block of its own.
BLOCK = 1 << 22
#: Parts of texts whose ids are put together at a time.
GATHERED = 1 << 17
#: Fixed value: the pattern whose pre-tokens parts() may cut at spaces; with any other, texts are split by the pattern alone.
CUT_AT_SPACES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a pre-token, at most, that is coded together with others; a longer one has the queue to itself.
SHORT = 48
_SHIFT = 8
_MASK = (1 << _SHIFT) - 1
#: Where white space stands on both sides of a space, or on one side at the end.
_RUN = regex.compile(r"\s \s|\s \Z")


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each length, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class _Runs:
    """Runs of numbers by index, held end to end."""

    def __init__(self):
        self.flat, self.begins, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> range:
        """More runs; their indexes."""
        first, at = self.n, int(self.begins[self.n])
        while at + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while first + len(lengths) + 1 > len(self.begins):
            self.begins = np.concatenate((self.begins, np.zeros_like(self.begins)))
        self.flat[at : at + len(flat)] = flat
        self.begins[first + 1 : first + 1 + len(lengths)] = at + np.cumsum(lengths)
        self.n += len(lengths)
        return range(first, self.n)

    def lengths(self, index: np.ndarray) -> np.ndarray:
        return self.begins[index + 1] - self.begins[index]

    def of(self, index: np.ndarray) -> np.ndarray:
        """The runs of these indexes, one after the other."""
        return self.flat[_ragged(self.begins[index], self.lengths(index))]


def _table(runs: list[bytes]) -> _Runs:
    out = _Runs()
    out.flat = np.zeros(1, np.uint8)
    out.add(np.frombuffer(b"".join(runs), np.uint8), np.fromiter(map(len, runs), np.int64, len(runs)))
    return out


class Bpe:
    """Encoder and decoder over merge ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = {n: b for b, n in ranks.items()}
        compiled = regex.compile(pattern)
        self.split = compiled.findall if not compiled.groups else lambda text: [m[0] for m in compiled.finditer(text)]
        self.cuts = pattern == CUT_AT_SPACES
        self.leaves = [0] * ((max(ranks.values(), default=0) >> _SHIFT) + 1)
        self.buckets: dict[int, list[int]] = {}
        self.forget()
        self.size = max(ranks.values(), default=0) + 1
        self.spelled = _table([self.token.get(i, b"") for i in range(self.size)])
        self.decimals = _table([b"%d," % i for i in range(self.size)])
        self.byte_ids = np.fromiter((ranks[bytes([i])] for i in range(256)), np.int32, 256)
        joined = {ranks[x] * self.size + ranks[y]: n for b, n in ranks.items() for k in range(1, len(b)) if (x := b[:k]) in ranks and (y := b[k:]) in ranks}
        keys = np.fromiter(joined, np.int64, len(joined))
        by = np.argsort(keys)
        self.pair_keys = np.concatenate((keys[by], [np.iinfo(np.int64).max]))
        self.pair_values = np.concatenate((np.fromiter(joined.values(), np.int32, len(joined))[by], [-1])).astype(np.int32)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        n, leaves, buckets, root = len(piece), self.leaves, self.buckets, 0
        after = list(range(1, n + 2))  # where the part that begins at i ends, which is where the next begins
        before = list(range(-1, n))
        pair: list[int | None] = [get(piece[i : i + 2]) for i in range(n)]  # rank of the part at i with its next
        pair[n - 1] = None
        for i, r in enumerate(pair):
            if r is not None:
                if r in buckets:
                    buckets[r].append(i)  # in order, so a heap
                else:
                    buckets[r] = [i]
                    leaves[r >> _SHIFT] |= 1 << (r & _MASK)
                    root |= 1 << (r >> _SHIFT)
        while root:
            leaf = (root & -root).bit_length() - 1
            bits = leaves[leaf]
            r = (leaf << _SHIFT) + (bits & -bits).bit_length() - 1
            bucket = buckets[r]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[r]
                bits &= bits - 1
                leaves[leaf] = bits
                if not bits:
                    root &= root - 1
            if pair[i] != r:
                continue  # stale
            gone = after[i]
            end = after[i] = after[gone]
            pair[gone] = None
            if end < n:
                before[end] = i
                r = pair[i] = get(piece[i : after[end]])
                if r is not None:
                    if r in buckets:
                        heappush(buckets[r], i)
                    else:
                        buckets[r] = [i]
                        leaves[r >> _SHIFT] |= 1 << (r & _MASK)
                        root |= 1 << (r >> _SHIFT)
            else:
                pair[i] = None
            at = before[i]
            if at >= 0:
                r = pair[at] = get(piece[at:end])
                if r is not None:
                    if r in buckets:
                        heappush(buckets[r], at)
                    else:
                        buckets[r] = [at]
                        leaves[r >> _SHIFT] |= 1 << (r & _MASK)
                        root |= 1 << (r >> _SHIFT)
        out, i = [], 0
        while i < n:
            end = after[i]
            out.append(get(piece[i:end]))
            i = end
        return out

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many short pre-tokens at once, and how many each has: one linked list over all their bytes, and one rank queue.

        A step takes the lowest rank's bucket and merges the leftmost live place of each pre-token that it holds, so
        each pre-token sees the very order that it would see alone.
        """
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        n = len(raw)
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        token = self.byte_ids[raw]
        after = np.arange(1, n + 2, dtype=np.int32)
        before = np.arange(-1, n, dtype=np.int32)
        pair = np.full(n + 1, -1, np.int32)
        if n > 1:
            pair[: n - 1] = self.pair_ranks(token[:-1], token[1:])
        pair[ends - 1] = -1
        live = np.ones(n, dtype=bool)
        last = np.zeros(n + 1, dtype=bool)  # where a pre-token's list stops
        last[ends] = True
        first = np.zeros(n, dtype=bool)
        first[ends - lengths] = True

        order = np.argsort(pair[:n], kind="stable")
        order = order[np.searchsorted(pair[order], 0) :]
        ranks, begins = np.unique(pair[order], return_index=True)
        buckets = {r: [x] for r, x in zip(ranks.tolist(), np.split(order, begins[1:]), strict=True)} if len(ranks) else {}
        leaves, root = [0] * len(self.leaves), 0
        for r in buckets:
            leaves[r >> _SHIFT] |= 1 << (r & _MASK)
            root |= 1 << (r >> _SHIFT)

        while root:
            leaf = (root & -root).bit_length() - 1
            r = (leaf << _SHIFT) + (leaves[leaf] & -leaves[leaf]).bit_length() - 1
            held = buckets.pop(r)
            leaves[leaf] &= leaves[leaf] - 1
            if not leaves[leaf]:
                root &= root - 1
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[pair[at] == r]  # the others are stale
            if not len(at):
                continue
            more: list[tuple[int, np.ndarray]] = []
            if len(at) > 1:
                own = owner[at]
                lead = np.ones(len(at), dtype=bool)
                np.not_equal(own[1:], own[:-1], out=lead[1:])
                if not lead.all():
                    more.append((r, at[~lead]))
                    at = at[lead]
            gone = after[at]
            end = after[gone]
            after[at] = end
            token[at] = r
            live[gone] = False
            pair[gone] = -1
            goes_on = ~last[end]
            pair[at] = -1
            begun = ~first[at]
            left = np.concatenate((at[goes_on], before[at[begun]]))
            right = np.concatenate((end[goes_on], at[begun]))
            before[end[goes_on]] = at[goes_on]
            if len(left):
                found = self.pair_ranks(token[left], token[right])
                pair[left] = found
                hit = found >= 0
                if hit.any():
                    found, left = found[hit], left[hit]
                    by = np.argsort(found, kind="stable")
                    found, left = found[by], left[by]
                    cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
                    more += zip(found[np.concatenate(([0], cuts))].tolist(), np.split(left, cuts), strict=True)
            for r, places in more:
                if r in buckets:
                    buckets[r].append(places)
                else:
                    buckets[r] = [np.sort(places)]
                    leaves[r >> _SHIFT] |= 1 << (r & _MASK)
                    root |= 1 << (r >> _SHIFT)
        return token[live], np.add.reduceat(live, ends - lengths, dtype=np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens joined, or -1."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_values[at], -1)

    def parts(self, text: str | None) -> list[str]:
        """The text cut before its spaces, where no pre-token crosses such a cut: unless white space stands on both sides
        of the space, or on one at the end, or the pattern is another; then the text's pre-tokens."""
        text = text or ""
        if not self.cuts or " " not in text or _RUN.search(text):
            return self.split(text)
        out = [" " + x for x in text.split(" ")]
        if text[0] == " ":
            return out[1:]
        out[0] = out[0][1:]
        return out

    def learn(self, missing: set[str]) -> None:
        """Code the parts, which are not remembered yet."""
        split = {}
        for part in missing:
            word = part[1:] if part[:1] == " " else part
            if not self.cuts:
                split[part] = [part]
            elif word.isalpha():
                split[part] = [part]
            elif word[-1:] in (".", ",") and word[:-1].isalpha():
                split[part] = [part[:-1], part[-1]]
            else:
                split[part] = self.split(part)
        unseen = set(chain.from_iterable(split.values())).difference(self.pieces)
        short, raws = [], []
        for p in unseen:
            x = p.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(x)
            if whole is not None:
                self.pieces[p] = self.coded_pieces.add(np.array([whole], np.int32), np.ones(1, np.int64))[0]
            elif len(x) > SHORT:
                ids = self.merge(x)
                self.pieces[p] = self.coded_pieces.add(np.array(ids, np.int32), np.array([len(ids)]))[0]
            else:
                short.append(p)
                raws.append(x)
        self.pieces.update(zip(short, self.coded_pieces.add(*self.merge_all(raws)), strict=True))
        own = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(split.values())), np.int64)
        counts = np.fromiter(map(len, split.values()), np.int64, len(split))
        sizes = np.concatenate(([0], np.cumsum(self.coded_pieces.lengths(own))))
        ends = np.cumsum(counts)
        self.known.update(zip(split, self.coded_parts.add(self.coded_pieces.of(own), sizes[ends] - sizes[ends - counts]), strict=True))

    def forget(self) -> None:
        """Hold no parts of texts any more."""
        self.known: dict[str, int] = {}
        self.pieces: dict[str, int] = {}
        self.coded_parts, self.coded_pieces, self.held = _Runs(), _Runs(), 0

    def coded(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of the texts of a block, some texts at a time: all their ids, and where each text's end."""
        if self.held > REMEMBERED:
            self.forget()
        on = gc.isenabled()
        gc.disable()  # a block makes many strings and no cycles
        try:
            missing: set[str] = set()
            for text in texts:
                missing.update(self.parts(text))
            missing.difference_update(self.known)
            self.held += sum(250 + 3 * len(x) for x in missing)
            self.learn(missing)
            index, counts = array("i"), []
            for text in texts:
                parts = self.parts(text)
                counts.append(len(parts))
                index.extend(map(self.known.__getitem__, parts))
        finally:
            if on:
                gc.enable()
        index, ends = np.array(index, np.int64), np.cumsum(counts, dtype=np.int64)
        begun = 0
        while begun < len(texts):
            first = ends[begun - 1] if begun else 0
            stop = max(begun + 1, int(np.searchsorted(ends, first + GATHERED)))
            own = index[first : ends[stop - 1]]
            sizes = np.concatenate(([0], np.cumsum(self.coded_parts.lengths(own))))
            yield self.coded_parts.of(own), sizes[ends[begun:stop] - first]
            begun = stop

    def encode_all(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each whole text."""
        for a, b in chunks(texts, BLOCK):
            for ids, ends in self.coded(texts[a:b]):
                begun = 0
                for end in ends.tolist():
                    yield ids[begun:end].tolist()
                    begun = end

    def encode(self, text: str | None) -> list[int]:
        """The ids of one whole text."""
        return next(self.encode_all([text]))

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        return self.spelled.of(np.asarray(ids, np.int64)).tobytes()


def _digests(runs: _Runs, ids: np.ndarray, ends: np.ndarray, less: int) -> list[str]:
    """SHA-256 of what the ids of each text are spelled as, without the last `less` bytes."""
    at = np.concatenate(([0], np.cumsum(runs.lengths(ids))))[np.concatenate(([0], ends))].tolist()
    spelled = memoryview(np.ascontiguousarray(runs.of(ids)))
    return [hashlib.sha256(spelled[a : max(a, b - less)]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Bpe:
    """A coder from a file of lines "base64 rank"; kept by the worker between tasks."""
    with open(path, "rb") as lines:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, forget: bool = False) -> DataFrame:
    """One row a row of docs: the id, n_tokens, ids (if keep_ids), and SHA-256 of the ids and of the bytes they decode to.

    Null counts as empty: no ids, the digests of nothing. Repeated rows give a row each; ids may be null; other columns
    are not read. Texts are coded whole, each in one task. `path` must name the vocabulary on every executor.
    Workers remember parts of texts between tasks, unless they are to forget them, for what runs in them afterwards.
    """
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = kept.schema["id"].dataType.simpleString()

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path, pattern)
        for batch in batches:
            block = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy()) // BLOCK
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), batch.num_rows]
            begun = 0
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for ids, ends in coder.coded(batch.column("text").slice(a, b - a).to_pylist()):
                    wide = ids.astype(np.int64)
                    columns = [batch.column("id").slice(begun, len(ends)), pa.array(np.diff(ends, prepend=0), pa.int64())]
                    columns += [pa.array(_digests(runs, wide, ends, less), pa.string()) for runs, less in ((coder.decimals, 1), (coder.spelled, 0))]
                    if keep_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names)
                    begun += len(ends)
        if forget:
            coder.forget()

    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return kept.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(coded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id and the bytes of each row's ids; null ids give empty bytes."""
    kept = coded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([coder.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())], ["id", "bytes"])

    return kept.mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)
