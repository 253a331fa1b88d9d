"""Benchmark decontamination by a distributed positional inverted index.

The index holds every word of the training texts and knows nothing of the tests, so that one
stored index serves any number of benchmarks. It is sharded by document: each worker turns about
a million words at a time into one row with the shard's terms and their positions. Positions
run through a shard with a free one after each document, so that no match spans two.

A query takes a window of test words and starts from the term with the shortest list of the
shard; its positions less the term's offset are the candidate starts. The other terms' lists,
by length, are intersected with these, each by its own offset. What is left are the exact
occurrences. Windows with a term that the shard lacks are gone at once.

Test items go in blocks of a bounded number of words, so that what is broadcast does not grow
with them. Each block finds the rows of training texts that it hits; a row is known by its shard
and place, and the blocks' hits meet by these, one path for any number of blocks.

Null and empty texts have no words; such items match nothing. Item rows without an id count
under the empty name. Every document row gives one row, repeated ids and null ids included. No
items hit nothing, and an empty table of documents gives an empty one. Other columns of both
tables are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquilt.llm.common import remove, stored

WINDOW = 10
SHARD_WORDS = 1 << 20
#: Words of test items whose plan is broadcast at once (some 200 bytes each).
BLOCK_WORDS = 200_000
#: Candidate positions of a shard that are looked up at once.
CANDIDATES = 2_000_000

#: ASCII letters to lower case; of the rest of ASCII, all but digits become spaces.
_TOKENS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)
)

#: Hit documents up to which their rows are broadcast (some 100 bytes each).
BROADCAST_HITS = 100_000

INDEX = "shard long, doc_id array<long>, n_words array<long>, start array<long>, terms binary, first binary, steps binary"
#: Runs of hit words and items by row.
HITS = "shard long, nth int, runs array<array<long>>, items array<string>"


def words(text: str) -> list[bytes]:
    return text.encode().translate(_TOKENS).split()


@dataclass
class Plan:
    """Test items in numbers: windows of equal length as rows of terms."""

    vocabulary: dict[bytes, int]
    names: list[str]
    #: (item of each window, its offset in the item, its terms)
    windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, items: list[tuple[str, str]], window: int = WINDOW) -> Plan:
        vocabulary: dict[bytes, int] = {}
        by_length: dict[int, list[tuple[int, int, list[int]]]] = {}
        for item, (_, text) in enumerate(items):
            terms = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
            size = min(window, len(terms))
            for at in range(len(terms) - size + 1 if size else 0):
                by_length.setdefault(size, []).append((item, at, terms[at : at + size]))
        windows = [
            (np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), np.array([x[2] for x in rows]))
            for rows in by_length.values()
        ]
        return cls(vocabulary, [name for name, _ in items], windows)


class _Terms(dict):
    """Words by number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _indexed(batches):
    from pyspark import TaskContext

    # a retried task makes the same shards of the same partition
    number = TaskContext.get().partitionId() << 32

    def shard():
        sizes = np.array([len(part) for part in parts], np.int64)
        start = np.cumsum(sizes + 1) - sizes - 1
        term = np.concatenate(parts)
        position = np.arange(len(term)) + np.repeat(np.arange(len(parts)), sizes)
        order = np.argsort(term, kind="stable")
        first = np.searchsorted(term[order], np.arange(len(terms)))
        steps = np.diff(position[order], prepend=0).astype("<i4").tobytes()
        columns = [[number], [list(ids)], [sizes], [start], [b"\n".join(terms)], [first.astype("<i4").tobytes()], [steps]]
        kinds = [pa.int64()] + [pa.list_(pa.int64())] * 3 + [pa.binary()] * 3
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in INDEX.split(", ")]
        )

    ids, parts, terms, held = [], [], _Terms(), 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("__text").to_pylist(), strict=True):
            found = words(text)
            ids.append(doc_id)
            parts.append(np.fromiter(map(terms.__getitem__, found), np.int32, len(found)))
            held += len(found)
            if held >= SHARD_WORDS:
                yield shard()
                number += 1
                ids, parts, terms, held = [], [], _Terms(), 0
    if ids:
        yield shard()


class Shard:
    """Postings of one index row, of a plan's terms."""

    def __init__(self, row: dict, vocabulary: dict[bytes, int]):
        self.number, self.doc_id, self.n_words = row["shard"], row["doc_id"], np.array(row["n_words"], np.int64)
        self.start = np.array(row["start"], np.int64)
        position = np.cumsum(np.frombuffer(row["steps"], "<i4"), dtype=np.int64)
        first = np.append(np.frombuffer(row["first"], "<i4"), len(position)).astype(np.int64)
        known = row["terms"].split(b"\n") if row["terms"] else []
        number = np.fromiter(map(vocabulary.get, known, repeat(-1)), np.int64, len(known))
        there = np.flatnonzero(number >= 0)
        there = there[np.argsort(number[there])]
        term, sizes = number[there], np.diff(first)[there]
        self.position = position[_ranges(first[there], sizes)]
        self.count = np.zeros(len(vocabulary), np.int64)
        self.first = np.zeros(len(vocabulary), np.int64)
        self.count[term] = sizes
        self.first[term] = np.cumsum(sizes) - sizes
        #: Ascending: term by term, each in order of position.
        self.key = np.repeat(term, sizes) << 40 | self.position

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros(len(position), bool)
        wanted = term << 40 | np.maximum(position, 0)
        at = np.searchsorted(self.key, wanted)
        return (position >= 0) & (self.key[np.minimum(at, len(self.key) - 1)] == wanted)

    def candidates(self, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(windows, positions of their rarest terms, order of each window's terms by list
        length) for the rows of terms of which none is missing here, in parts of about
        CANDIDATES positions."""
        order = np.argsort(self.count[terms], axis=1, kind="stable")
        rarest = terms[np.arange(len(terms)), order[:, 0]]
        times = self.count[rarest]
        part = np.cumsum(times) // CANDIDATES
        for k in np.unique(part[times > 0]):
            chosen = np.flatnonzero((part == k) & (times > 0))
            n = times[chosen]
            yield np.repeat(chosen, n), self.position[_ranges(self.first[rarest[chosen]], n)], order

    def phrases(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its first word) of every exact occurrence."""
        found = []
        for window, at, order in self.candidates(terms):
            start = at - order[window, 0]
            for step in range(1, terms.shape[1]):
                offset = order[window, step]
                there = self.has(terms[window, offset], start + offset)
                window, start = window[there], start[there]
            found.append((window, start))
        return _joined(found)

    def near(self, terms: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its rarest word) where all its words are in one document
        within `reach` words of that position, in any order."""
        found = []
        for window, at, order in self.candidates(terms):
            for step in range(1, terms.shape[1]):
                term = terms[window, order[window, step]]
                doc = np.searchsorted(self.start, at, "right") - 1
                low = np.maximum(at - reach, self.start[doc])
                high = np.minimum(at + reach, self.start[doc] + self.n_words[doc] - 1)
                i = np.searchsorted(self.key, term << 40 | low)
                there = self.key[np.minimum(i, len(self.key) - 1)] <= (term << 40 | high)
                there &= i < len(self.key)
                window, at = window[there], at[there]
            found.append((window, at))
        return _joined(found)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... up to size of them, for each in turn."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    one, two = zip(*parts, strict=True)
    return np.concatenate(one), np.concatenate(two)


def _shards(plan: Plan, batches) -> Iterator[Shard]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Shard(row, plan.vocabulary)


def _matches(plan: Plan, reach: int | None):
    def run(batches):
        for shard in _shards(plan, batches):
            for item, offset, terms in plan.windows:
                window, at = shard.phrases(terms) if reach is None else shard.near(terms, reach)
                doc = np.searchsorted(shard.start, at, "right") - 1
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shard.doc_id[d] for d in doc], pa.int64()),
                            pa.array([plan.names[i] for i in item[window]], pa.string()),
                            pa.array(offset[window], pa.int64()),
                            pa.array(at - shard.start[doc], pa.int64()),
                        ],
                        names=["doc_id", "item", "item_word", "doc_word"],
                    )

    return run


def _hits(plan: Plan):
    """(shard, nth, runs, items) of the rows that are hit."""

    def run(batches):
        for shard in _shards(plan, batches):
            edges, doc_item = np.zeros(int(shard.start[-1] + shard.n_words[-1]) + 2, np.int64), []
            for item, _, terms in plan.windows:
                window, at = shard.phrases(terms)
                np.add.at(edges, at, 1)
                np.add.at(edges, at + terms.shape[1], -1)
                doc = np.searchsorted(shard.start, at, "right") - 1
                doc_item.append(np.unique(doc * len(plan.names) + item[window]))
            hit = np.diff((np.cumsum(edges) > 0).astype(np.int8), prepend=0)
            low, high = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
            runs: dict[int, list[list[int]]] = {}
            for a, b in zip(low.tolist(), high.tolist(), strict=True):
                d = int(np.searchsorted(shard.start, a, "right")) - 1
                runs.setdefault(d, []).append([a - int(shard.start[d]), b - int(shard.start[d])])
            items: dict[int, set[str]] = {}
            for x in np.concatenate(doc_item).tolist() if doc_item else ():
                items.setdefault(x // len(plan.names), set()).add(plan.names[x % len(plan.names)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard.number] * len(runs), pa.int64()),
                    pa.array(list(runs), pa.int32()),
                    pa.array(list(runs.values()), pa.list_(pa.list_(pa.int64()))),
                    pa.array([sorted(items[d]) for d in runs], pa.list_(pa.string())),
                ],
                names=["shard", "nth", "runs", "items"],
            )

    return run


def _digest(batches):
    for batch in batches:
        n_hit, n_items, sha = [], [], []
        for runs, items in zip(batch.column("runs").to_pylist(), batch.column("items").to_pylist(), strict=True):
            end = total = 0
            for a, b in sorted(runs):
                total += max(0, b - max(a, end))
                end = max(end, b)
            names = sorted(set(items))
            n_hit.append(total)
            n_items.append(len(names))
            sha.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("shard"), batch.column("nth"), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string())],
            names=["shard", "nth", "n_hit", "n_items", "items_sha256"],
        )


def plans(items: DataFrame, window: int = WINDOW) -> Iterator[Plan]:
    """Plans of blocks of the test items (item_id, text); one block is on the driver at a time."""
    block, held = [], 0
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    for name, text in rows.toLocalIterator():
        block.append((name, text))
        held += len(words(text))
        if held >= BLOCK_WORDS:
            yield Plan.of(block, window)
            block, held = [], 0
    yield Plan.of(block, window)


def build_index(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """The stored postings of all words of docs (doc_id, text), and their path."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("__text"))
    return stored(spark, rows.mapInArrow(_indexed, INDEX), "postings", compression="zstd")


def _query(spark: SparkSession, index: DataFrame, plan: Plan, make, schema: str) -> DataFrame:
    shared = spark.sparkContext.broadcast(plan)

    def run(batches):
        return make(shared.value)(batches)

    return index.mapInArrow(run, schema)


def matches(spark: SparkSession, index: DataFrame, plan: Plan, reach: int | None = None) -> DataFrame:
    """(doc_id, item, item_word, doc_word) of every window's exact occurrence or, with `reach`,
    of every place whose neighbourhood of so many words has all its words."""
    schema = "doc_id long, item string, item_word long, doc_word long"
    return _query(spark, index, plan, lambda p: _matches(p, reach), schema)


def index_hits(spark: SparkSession, index: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs that
    build_index() has put into the index, by the test items (item_id, text)."""
    hits, scratch = None, []
    for plan in plans(items):
        found, path = stored(spark, _query(spark, index, plan, _hits, HITS), "hits")
        scratch.append(path)
        hits = found if hits is None else hits.unionByName(found)
    # a row's hits are few: runs of words of one text
    merged = hits.groupBy("shard", "nth").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
    merged, path = stored(
        spark, merged.mapInArrow(_digest, "shard long, nth int, n_hit long, n_items long, items_sha256 string"), "digests"
    )
    scratch.append(path)
    if merged.count() <= BROADCAST_HITS:
        merged = F.broadcast(merged)
    every = index.select("shard", F.posexplode(F.arrays_zip("doc_id", "n_words")).alias("nth", "row"))
    rows = every.select("shard", "nth", "row.*").join(merged, ["shard", "nth"], "left")
    none = hashlib.sha256(b"").hexdigest()
    result = rows.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    ).checkpoint()
    for path in scratch:
        remove(spark, path)
    return result


def document_hits(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """index_hits() of an index that is built for the occasion."""
    index, path = build_index(spark, docs)
    result = index_hits(spark, index, items)
    remove(spark, path)
    return result
