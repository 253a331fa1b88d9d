"""Byte-level BPE with a hierarchical-bitmap rank queue.

Merge candidates wait in one bucket per merge rank: linked-list positions. Three levels of 64-bit
words tell which buckets hold entries; two find-first-set steps below the top word give the least
rank. Entries are never removed when a neighbour is merged away: one whose position no longer
starts a pair of that rank is stale and is skipped. A bucket is merged as a whole by array
operations, and the new pre-tokens of many texts share a queue, so that buckets are large. A
pre-token of n bytes takes O(n log n) time and some 60 n bytes of memory, so texts without any white
space do no harm.

A worker numbers the distinct pre-tokens that it meets and remembers the ids of the most used
ones; a text is then a sequence of numbers, and ids, decimal digits and decoded bytes are looked
up by arrays, in parts of bounded size.

Null and empty texts have no tokens. Equal texts give equal rows; rows are never merged. An empty
table gives an empty one. Columns of documents named like an added one are an error of Spark's,
so `carry` has to leave them out.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoquilt.llm.common import give_back

#: Unicode's White_Space property, which the pattern's \s stands for.
SPACE = "\t-\r \x85\xa0  -     　"
#: Distinct pre-tokens that a worker remembers at most; how many of them, the most used, remain
#: when there are more, and the characters of the longest that may.
REMEMBERED, KEPT, LONGEST = 300_000, 120_000, 64
#: Characters of texts whose new pre-tokens are merged together, and bytes of new pre-tokens that
#: share a queue (one that is longer has its own).
GROUP, QUEUED = 6_000_000, 1 << 20
#: Bucket size from which array operations are faster than single steps.
MANY = 48
#: Pre-tokens and ids that are looked up at once.
PART = 1 << 19


class RankQueue:
    """Buckets of linked-list positions by merge rank, and the bitmaps that find the least."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int | np.ndarray]] = {}

    def put(self, rank: int, positions: int | np.ndarray) -> None:
        """One position or several."""
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def put_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Each position into the bucket of its rank."""
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        ends = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        begin = 0
        for rank, end in zip(ranks[np.r_[0, ends]].tolist(), [*ends.tolist(), len(ranks)], strict=True):
            self.put(rank, positions[begin:end])
            begin = end

    def take(self) -> tuple[int, np.ndarray] | None:
        """Removes the bucket of the least rank; its positions in ascending order."""
        top = self.top
        if not top:
            return None
        i = (top & -top).bit_length() - 1
        mid = self.mid[i]
        i = i << 6 | (mid & -mid).bit_length() - 1
        low = self.low[i]
        rank = i << 6 | (low & -low).bit_length() - 1
        self.low[i] = low = low & (low - 1)
        if not low:
            self.mid[i >> 6] = mid = mid & (mid - 1)
            if not mid:
                self.top = top & (top - 1)
        bucket = self.buckets.pop(rank)
        if len(bucket) == 1:
            return rank, np.sort(np.atleast_1d(bucket[0]))
        one = [x for x in bucket if isinstance(x, int)]
        return rank, np.sort(np.concatenate([np.array(one, np.int64), *(x for x in bucket if not isinstance(x, int))]))


class _Numbers(dict):
    """Pre-tokens by number, in order of appearance."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... up to size of them, for each in turn."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


class Codec:
    """Encodes and decodes by a table of byte strings and their ranks."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {}
        for line in rank_file.splitlines():
            if line:
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.size = max(self.ranks.values()) + 1
        # pairs of ranks whose tokens together are a token, in order of left << 32 | right
        pairs = np.array(
            [
                (left << 32 | right, rank)
                for token, rank in self.ranks.items()
                for cut in range(1, len(token))
                if (left := self.ranks.get(token[:cut])) is not None and (right := self.ranks.get(token[cut:])) is not None
            ],
            np.int64,
        ).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.pairs, self.merged = np.append(pairs[:, 0], -1), np.append(pairs[:, 1], -1).astype(np.int32)
        self.known = len(pairs)
        self.one = dict(zip(pairs[:, 0].tolist(), pairs[:, 1].tolist(), strict=True))
        #: Ranks whose token may make a pair of a lower rank with a neighbour.
        self.backward = np.zeros(self.size, bool)
        for part in (pairs[:, 0] >> 32, pairs[:, 0] & 0xFFFFFFFF):
            self.backward[part[pairs[:, 1] < part]] = True
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.first = np.full((256, 256), -1, np.int32)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.first[token[0], token[1]] = rank
        # tokens and decimal ids by rank
        parts = sorted((rank, token) for token, rank in self.ranks.items())
        at = np.array([rank for rank, _ in parts])
        self.blob = np.frombuffer(b"".join(token for _, token in parts), np.uint8)
        self.sizes, self.starts = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        self.sizes[at] = [len(token) for _, token in parts]
        self.starts[at] = np.cumsum(self.sizes[at]) - self.sizes[at]
        width = len(str(self.size)) + 1
        digits = b"".join(f"{rank} ".encode().ljust(width, b"\0") for rank in range(self.size))
        self.digits = np.frombuffer(digits, np.uint8).reshape(-1, width)
        explicit = _explicit_space(pattern)
        self.whole = regex.compile(explicit)
        self.plane = re.compile(_explicit_classes(explicit))
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.ids, self.start = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.used = np.zeros(0, np.int64)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks that neighbours of given ranks merge to; -1 where they don't."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pairs[: self.known], wanted)
        return np.where(self.pairs[at] == wanted, self.merged[at], np.int32(-1))

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them each piece has) of non-empty pre-tokens, which share one linked
        list and one queue: a gap, the first piece, a gap, the second and so on. No pair spans a
        gap, so that pieces don't meet; in each of them the least rank goes first, the leftmost
        of equals."""
        if not pieces:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begins = np.cumsum(sizes) - sizes
        head = begins + np.arange(1, len(pieces) + 1)  # the cell of each piece's first byte
        place = np.arange(1, len(data) + 1)
        place += np.repeat(np.arange(len(pieces)), sizes)
        gap = np.int32(0x7FFFFFFF)
        ids = np.full(len(data) + len(pieces) + 1, gap)
        ids[place] = self.bytes[data]
        waits = self.first[data[:-1], data[1:]]
        waits[begins[1:] - 1] = -1
        pending = np.full(len(ids), -1, np.int32)
        pending[place[:-1]] = waits
        after = np.arange(1, len(ids) + 1)
        before = np.arange(-1, len(ids) - 1)
        queue = RankQueue(self.size)
        some = waits >= 0
        queue.put_all(waits[some], place[:-1][some])
        del waits, some, place
        links = memoryview(ids), memoryview(pending), memoryview(after), memoryview(before)
        while taken := queue.take():
            rank, at = taken
            if len(at) < MANY:
                self._merge_few(rank, at.tolist(), queue, *links)
                continue
            at = at[pending[at] == rank]  # others are stale
            every, at = at, _apart(at, after)
            while len(at):
                j = after[at]
                k = after[j]
                joined = np.append(k[:-1] == at[1:], False)  # the right neighbour is merged too
                other = ids[k]
                right = self._pair(np.full(len(at), rank), np.where(joined, rank, other))
                alone = ~np.append(False, joined[:-1])  # the left one isn't, or not in this bucket
                h = before[at]
                left = np.where(alone, self._pair(ids[h], np.full(len(at), rank)), np.int32(-1))
                if self.backward[rank]:
                    low = ((right >= 0) & (right < rank)) | ((left >= 0) & (left < rank))
                    if joined.any():
                        early = self._pair(np.full(len(at), rank), other)
                        low |= joined & (early >= 0) & (early < rank)
                    if low.any():  # the lower rank goes first in its piece
                        piece = np.searchsorted(head, at, "right")
                        stop, where = np.unique(piece[low], return_index=True)
                        last = np.full(len(head) + 1, len(ids))
                        last[stop] = at[np.flatnonzero(low)[where]]
                        now = at <= last[piece]
                        if not now.all():
                            wait = every > last[np.searchsorted(head, every, "right")]
                            queue.put(rank, every[wait])
                            at, every = at[now], every[~wait]
                            continue
                ids[at], ids[j], pending[j] = rank, -1, -1
                after[at], before[k] = k, at
                pending[at] = right
                h, left = h[alone], left[alone]
                pending[h] = left
                more, new = right >= 0, left >= 0
                queue.put_all(np.concatenate((right[more], left[new])), np.concatenate((at[more], h[new])))
                break
        ids = np.where(ids == gap, np.int32(-1), ids)
        here = ids >= 0
        counts = np.add.reduceat(here, head, dtype=np.int64)
        return ids[here], counts

    def _merge_few(self, rank: int, at: list[int], queue: RankQueue, ids, pending, after, before) -> None:
        """One small bucket, position by position."""
        pair, put = self.one.get, queue.put
        for done, i in enumerate(at):
            if pending[i] != rank:
                continue  # stale
            j = after[i]
            k = after[j]
            h = before[i]
            ids[i], ids[j], pending[j] = rank, -1, -1
            after[i], before[k] = k, i
            pending[i] = right = pair(rank << 32 | ids[k], -1)
            if right >= 0:
                put(right, i)
            pending[h] = left = pair(ids[h] << 32 | rank, -1)
            if left >= 0:
                put(left, h)
            if 0 <= right < rank or 0 <= left < rank:  # the lower rank goes first
                if rest := at[done + 1 :]:
                    put(rank, np.array(rest))
                return

    def _learn(self) -> None:
        """The ids of the pre-tokens that were numbered since the last call."""
        new, self.numbers.new = self.numbers.new, []
        if not new:
            return
        encoded = [piece.encode() for piece in new]
        single = np.fromiter((self.ranks.get(piece, -1) for piece in encoded), np.int64, len(new))
        rest = [encoded[i] for i in np.flatnonzero(single < 0).tolist()]
        counts, parts, begin = np.ones(len(new), np.int64), [], 0
        sizes = np.cumsum([len(piece) for piece in rest])
        while begin < len(rest):
            base = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, base + QUEUED, "right")))
            parts.append(self.merge(rest[begin:end]))
            begin = end
        if parts:
            counts[single < 0] = np.concatenate([n for _, n in parts])
        start = np.cumsum(counts) - counts
        ids = np.empty(int(counts.sum()), np.int32)
        ids[start[single >= 0]] = single[single >= 0]
        if parts:
            ids[_ranges(start[single < 0], counts[single < 0])] = np.concatenate([x for x, _ in parts])
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(counts)))
        self.ids = np.concatenate((self.ids, ids))
        self.used = np.concatenate((self.used, np.zeros(len(new), np.int64)))

    def _trim(self) -> None:
        """Keeps the most used pre-tokens, of equals the first, once there are too many."""
        if len(self.numbers) <= REMEMBERED and len(self.ids) <= 8 * REMEMBERED:
            return
        pieces = list(self.numbers)
        short = np.fromiter(map(len, pieces), np.int64, len(pieces)) <= LONGEST
        best = np.lexsort((np.arange(len(pieces)), -self.used * short))[:KEPT]
        best = np.sort(best[short[best]])
        sizes = np.diff(self.start)[best]
        self.ids = self.ids[_ranges(self.start[best], sizes)]
        self.start = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
        self.used = self.used[best] // 2
        self.numbers = _Numbers()
        for i in best.tolist():
            self.numbers[pieces[i]] = len(self.numbers)

    def _split(self, text: str) -> np.ndarray:
        """Numbers of a text's pre-tokens."""
        find = self.plane if text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text) else self.whole
        number = self.numbers.__getitem__
        if len(text) <= GROUP:
            found = find.findall(text)
            return np.fromiter(map(number, found), np.int32, len(found))
        return np.fromiter((number(m.group()) for m in find.finditer(text)), np.int32)

    def _parts(self, numbers: np.ndarray) -> Iterator[np.ndarray]:
        for at in range(0, len(numbers), PART):
            some = numbers[at : at + PART]
            yield self.ids[_ranges(self.start[some], self.start[some + 1] - self.start[some])]

    def encode_all(self, texts: list[str]) -> Iterator[Iterator[np.ndarray]]:
        """The ids of each text in turn, in parts, which have to be taken before the next text;
        the new pre-tokens of texts of GROUP characters are merged together."""
        begin = 0
        while begin < len(texts):
            held, split = 0, []
            while begin < len(texts) and held < GROUP:
                split.append(self._split(texts[begin]))
                held += len(texts[begin])
                begin += 1
            self._learn()
            for numbers in split:
                self.used += np.bincount(numbers, minlength=len(self.used)) if len(numbers) > len(self.used) // 64 else 0
                yield self._parts(numbers)
            self._trim()

    def encode(self, text: str) -> list[int]:
        return [i for parts in self.encode_all([text]) for part in parts for i in part.tolist()]

    def decode(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        return self.blob[_ranges(self.starts[ids], self.sizes[ids])].tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """Each id in digits and a space."""
        wide = self.digits[ids].ravel()
        return wide[wide != 0].tobytes()


def _explicit_space(pattern: str) -> str:
    """Writes out \\s and \\S, of which engines have different notions."""
    out, depth, i = [], 0, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(SPACE if depth else f"[{SPACE}]")
        elif two == r"\S" and not depth:
            out.append(f"[^{SPACE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            depth += (two[0] == "[") - (two[0] == "]")
            out.append(two[0])
            i -= 1
        i += 2
    return "".join(out)


def _explicit_classes(pattern: str) -> str:
    """Writes out \\p{L} and \\p{N} for the characters of two bytes, as the library that knows
    these classes tells them; the standard one, which is faster, doesn't."""
    every = "".join(map(chr, (i for i in range(1 << 16) if not 0xD800 <= i < 0xE000)))
    members = {}
    for name in "LN":
        codes = np.array([ord(c) for c in regex.findall(rf"\p{{{name}}}", every)])
        first = codes[np.r_[True, np.diff(codes) > 1]]
        last = codes[np.r_[np.diff(codes) > 1, True]]
        members[name] = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(first, last, strict=True))
    out, depth, i = [], 0, 0
    while i < len(pattern):
        if found := re.match(r"\\p\{([LN])\}", pattern[i:]):
            out.append(members[found[1]] if depth else f"[{members[found[1]]}]")
            i += len(found[0])
        elif pattern[i] == "\\":
            out.append(pattern[i : i + 2])
            i += 2
        else:
            depth += (pattern[i] == "[") - (pattern[i] == "]")
            out.append(pattern[i])
            i += 1
    return "".join(out)


def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of ascending positions whose pairs overlap, every second of each run, from the left."""
    if len(at) < 2:
        return at
    chained = after[at[:-1]] == at[1:]
    if not chained.any():
        return at
    nth = np.arange(len(at))
    begin = np.maximum.accumulate(np.where(np.append(True, ~chained), nth, 0))
    return at[(nth - begin) % 2 == 0]


@lru_cache(maxsize=2)
def _codec(name: str, pattern: str) -> Codec:
    with open(SparkFiles.get(name), "rb") as f:
        return Codec(f.read(), pattern)


def _worker(name: str, pattern: str, with_ids: bool):
    def encoded(codec: Codec, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [text for batch in batches for text in batch.column("__text").to_pylist()]
        results = codec.encode_all(texts)
        for batch in batches:
            counts, hashes, decoded, all_ids = [], [], [], []
            for _ in range(batch.num_rows):
                count, digits, back = 0, hashlib.sha256(), hashlib.sha256()
                for ids in next(results):
                    decimal = codec.decimal(ids)
                    digits.update(b" " + decimal[:-1] if count else decimal[:-1])
                    back.update(codec.decode(ids))
                    count += len(ids)
                    if with_ids:
                        all_ids.append(ids)
                counts.append(count)
                hashes.append(digits.hexdigest())
                decoded.append(back.hexdigest())
            keep = batch.drop_columns(["__text"])
            columns = [*keep.columns, pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            fields = [*keep.schema.names, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                offsets = pa.array(np.cumsum([0, *counts]), pa.int32())
                flat = np.concatenate(all_ids) if all_ids else np.empty(0, np.int32)
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())))
                fields.append("token_ids")
            yield pa.RecordBatch.from_arrays(columns, names=fields)
        for _ in results:  # so that the last group is trimmed
            pass

    def run(batches):
        codec = _codec(name, pattern)
        waiting, held = [], 0
        for batch in batches:
            waiting.append(batch)
            held += batch.column("__text").nbytes
            if held >= GROUP:
                yield from encoded(codec, waiting)
                waiting, held = [], 0
        yield from encoded(codec, waiting)
        del waiting
        give_back()

    return run


def encode_documents(
    spark: SparkSession, docs: DataFrame, rank_file: str, pattern: str, carry: list[str], with_ids: bool = True
) -> DataFrame:
    """The columns `carry` of docs, then n_tokens, ids_sha256, decoded_sha256 and, on request,
    token_ids. One row for each row of docs; no shuffle. rank_file is a path on the driver; its
    copy travels to the executors with the job."""
    spark.sparkContext.addFile(rank_file)
    name = rank_file.rsplit("/", 1)[-1]
    rows = docs.select(*carry, F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    fields = [
        *(f for f in rows.schema.fields if f.name != "__text"),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    if with_ids:
        fields.append(T.StructField("token_ids", T.ArrayType(T.IntegerType())))
    return rows.mapInArrow(_worker(name, pattern, with_ids), T.StructType(fields))
