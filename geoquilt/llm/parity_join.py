"""Jaccard self-join of word-shingle sets by parity sketches, and its connected classes.

A document's sketch is a bit vector into which every shingle's hash toggles one bit. Bits that
differ between two sketches come from shingles in one set only, so their number is at most the
sets' symmetric difference; a Jaccard similarity s of sets of a <= b shingles bounds that by
(1 - s)(a + b) / (1 + s). The vector is cut into pieces, whose count goes with the size band
(sizes [lo, 2 lo)); it is as wide as a piece needs to be told from others, and only its set
bits are kept. By the pigeonhole, two linked documents agree on all but D non-empty pieces, so
that they share one of the first D + 1 in any order that all documents follow. The order puts
rare pieces first: passages that thousands of documents share would only meet unrelated
documents. What meets is verified on the whole sets.

Documents with equal sets are one class, which takes part once and is a vertex of the link graph.
A document id that several rows give different texts links their classes.

Work in groups: each bucket of equal pieces names its members to its least class. Such a pair
first compares folded sketches (XOR of halves keeps the bound), whose Hamming distance rules
out most of what is not linked, then the whole sets. The verified links are contracted. Pairs
that met in a bucket without its least class are among the members of that class's group: where
a group is still in several parts, the sketches of its members are compared in blocks of bounded
size, and only pairs of different parts within the bound are verified. No pair that meets in a
bucket escapes both. A piece of shingles that very many documents share makes a bucket without
bound; its least class is then found by partial minima and joined back, so that no task holds
the bucket.

Exact up to collisions of 64-bit hashes (sizes below 64 get a piece per shingle; in larger
ones, over two thirds of the pieces would have to fall together for the pigeonhole to fail).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoquilt.llm.components import components
from geoquilt.llm.common import forget_codecs, remove, stored

WORDS = 5
SIMILARITY = Fraction(3, 4)
#: Word hashes that a worker remembers; characters of texts whose words are hashed at once.
REMEMBERED, CHARACTERS = 200_000, 1_000_000
#: Shingles of one worker that are counted at once, and the least count that it reports.
CHUNK, SEEN = 2_000_000, 2
#: Shingles reported often enough go last in the order of pieces; this many at most. The bound
#: costs candidates beyond it, no links: any common order is right.
COMMON, MOST_COMMON = 12, 300_000
#: Documents that share a piece's rarest shingle from which its bucket is dealt to many tasks.
HOT = 20_000
#: Bits of a folded sketch per shingle, about; members of a group that are compared at once.
FOLD, BLOCK = 4, 512
#: Pairs of one class that a task joins with its sketch or text; what has more goes to several.
DEALT = 512
#: Rows up to which a list of ids is broadcast (8 bytes each); beyond, Spark joins by shuffle.
BROADCAST_IDS = 2_000_000

_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    np.uint64,
)
_STEPS = _MULTIPLIERS * np.arange(1, 6, dtype=np.uint64)


class _Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], hashes: _Words, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of `words` words, lower-cased in A-Z; of the
    whole sequence if it is shorter. bytes.split() parts at the six white-space bytes alone."""
    parts = [text.encode().lower().split() for text in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    known = hashes.__getitem__
    h = np.fromiter(map(known, chain.from_iterable(parts)), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    # the runs of `words` of all texts at once; those that span two texts are not looked at
    runs = max(len(h) - words + 1, 0)
    total = np.full(runs, words, np.uint64)
    for i in range(words if runs else 0):
        total += _mixed(h[i : runs + i] + _STEPS[i % 5])
        total *= _MULTIPLIERS[4]
    total = _mixed(total)
    out = []
    for n, end in zip(sizes.tolist(), ends.tolist(), strict=True):
        if n >= words:
            tokens = np.sort(total[end - n : end - words + 1])
            out.append(tokens[np.append(True, tokens[1:] != tokens[:-1])])
        else:
            out.append(_short(h[end - n : end]))
    return out


def _short(h: np.ndarray) -> np.ndarray:
    """The one shingle of a text of fewer words than a shingle has; none without words."""
    k = len(h)
    total = np.full(min(k, 1), k, np.uint64)
    for i in range(k):
        total += _mixed(h[i : i + 1] + _STEPS[i % 5])
        total *= _MULTIPLIERS[4]
    return _mixed(total)


def shingles(text: str, hashes: _Words, words: int = WORDS) -> np.ndarray:
    return shingle_sets([text], hashes, words)[0]


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[list[str]]:
    """The texts of a batch, in parts of a bounded number of characters."""
    part, held = [], 0
    for text in batch.column(column).to_pylist():
        part.append(text)
        held += len(text)
        if held >= CHARACTERS:
            yield part
            part, held = [], 0
    if part:
        yield part


def class_of(tokens: np.ndarray) -> int:
    """The number of a set: equal sets have the same."""
    sums = tokens.sum(dtype=np.uint64), _mixed(tokens ^ _MULTIPLIERS[1]).sum(dtype=np.uint64), np.uint64(len(tokens))
    return int(_mixed(np.array([sums[0]]) ^ _mixed(sums[1] ^ _mixed(sums[2:]))).view(np.int64)[0])


def most_differing(n: int, s: Fraction = SIMILARITY) -> int:
    """Largest symmetric difference of a set of n with one that it links to: the other has at
    most n / s members, and (1 - s)(a + b) / (1 + s) = n (1 - s) / s."""
    return int(n * (1 - s) / s)


def _bands(n: int, s: Fraction = SIMILARITY) -> list[tuple[int, int]]:
    """(pieces, band) that a document of n shingles joins: its own size band and, if smaller
    partners can lie in the band below, that one."""
    own = n.bit_length() - 1
    out = [own]
    if own and n * s < (1 << own):
        out.append(own - 1)
    return [((1 << 40) if b < 6 else (2 << b), b) for b in out]


def piece_keys(tokens: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pieces under which a document of these shingles is looked up, and how often
    the rarest shingle of each is known to occur."""
    n = len(tokens)
    out, times = [], []
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        often = np.where(common[at] == tokens, counts[at], 0)
    else:
        often = np.zeros(n, np.int64)
    for pieces, band in _bands(n):
        # The sketch has pieces * 2**24 bits; a position is (piece, bit).
        piece = (tokens >> np.uint64(24)) % np.uint64(pieces)
        bit = piece << np.uint64(24) | tokens & np.uint64((1 << 24) - 1)
        order = np.argsort(bit)
        bit, piece, rare = bit[order], piece[order], often[order]
        if (bit[1:] == bit[:-1]).any():  # toggled twice: not set
            first = np.flatnonzero(np.append(True, bit[1:] != bit[:-1]))
            odd = np.diff(np.append(first, n)) % 2 == 1
            bit, piece, rare = bit[first][odd], piece[first][odd], rare[first][odd]
        if not len(bit):
            continue
        key, rarest = _mixed(bit ^ _mixed(np.array([band + 1], np.uint64))), rare
        start = np.append(True, piece[1:] != piece[:-1])
        if not start.all():
            start = np.flatnonzero(start)
            key, rarest = np.bitwise_xor.reduceat(key, start), np.minimum.reduceat(rare, start)
        least = most_differing(n) + 1
        if least < len(key):
            # rare pieces first, of equals by the key's upper bits: an order that all documents share
            place = np.minimum(rarest, (1 << 20) - 1).astype(np.uint64) << np.uint64(44) | key >> np.uint64(20)
            taken = place <= np.partition(place, least - 1)[least - 1]
            key, rarest = key[taken], rarest[taken]
        out.append(key)
        times.append(rarest)
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(out), np.concatenate(times)


def folded_sketch(tokens: np.ndarray) -> bytes:
    """The sketch folded to a power of two of bits: FOLD a shingle or more, 256 at least."""
    width = max(256, 1 << (FOLD * len(tokens) - 1).bit_length())
    bits = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded_to(sketches: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words folded to fewer; positions are taken modulo the width."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _profile(batches):
    """Rows of documents (doc_id, n, c, sketch), and rows of shingles met in several of this
    worker's documents (token, seen)."""
    forget_codecs()
    hashes, waiting, held = _Words(), [], 0
    sets_seen: set[int] = set()
    names = ["doc_id", "n", "c", "sketch", "token", "seen"]

    def counted():
        values, times = np.unique(np.concatenate(waiting), return_counts=True)
        values, times = values[times >= SEEN], times[times >= SEEN]
        none = pa.nulls(len(values), pa.int64())
        return pa.RecordBatch.from_arrays(
            [none, none, none, pa.nulls(len(values), pa.binary()), pa.array(values.view(np.int64)), pa.array(times)],
            names=names,
        )

    for batch in batches:
        rows = []
        for texts in _texts(batch, "__text"):
            for tokens in shingle_sets(texts, hashes):
                c = class_of(tokens)
                rows.append((len(tokens), c, folded_sketch(tokens)))
                if len(tokens) and c not in sets_seen:  # copies count once
                    sets_seen.add(c)
                    waiting.append(tokens)
                    held += len(tokens)
            if held >= CHUNK:
                yield counted()
                waiting, held = [], 0
                sets_seen.clear()
        none = pa.nulls(len(rows), pa.int64())
        columns = [pa.array([r[i] for r in rows], pa.int64() if i < 2 else pa.binary()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns, none, none], names=names)
    if waiting:
        yield counted()


def _keys(common: np.ndarray, counts: np.ndarray, hot: int):
    def run(batches):
        forget_codecs()
        hashes = _Words()
        for batch in batches:
            for texts in _texts(batch, "__text"):
                classes, keys, times = [], [], []
                for tokens in shingle_sets(texts, hashes):
                    if len(tokens):
                        found, often = piece_keys(tokens, common, counts)
                        classes.append(np.full(len(found), class_of(tokens)))
                        keys.append(found)
                        times.append(often)
                if classes:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(keys).view(np.int64)),
                            pa.array(np.concatenate(classes)),
                            pa.array(np.concatenate(times) >= hot),
                        ],
                        names=["key", "id", "hot"],
                    )

    return run


def _within(n: np.ndarray, m: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Whether sizes and Hamming distances leave room for a link."""
    s = SIMILARITY
    top, low = s.denominator, s.numerator
    sizes = (np.minimum(n, m) * top >= np.maximum(n, m) * low)
    return sizes & (distance * (top + low) <= (n + m) * (top - low))


def _words_of(sketch: bytes) -> np.ndarray:
    return np.frombuffer(sketch, np.uint64)


def _near(batches):
    """Pairs (a, b) of rows (a, b, n_a, n_b, sketch_a, sketch_b) that may be linked."""
    for batch in batches:
        left, right = ([_words_of(x) for x in batch.column(c).to_pylist()] for c in ("sketch_a", "sketch_b"))
        n, m = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_a", "n_b"))
        distance = np.zeros(len(left), np.int64)
        for i, (x, y) in enumerate(zip(left, right, strict=True)):
            words = min(len(x), len(y))
            if max(len(x), len(y)) > 2 * words:  # sizes too far apart
                distance[i] = 1 << 40
                continue
            x, y = (folded_to(z[None], words)[0] if len(z) > words else z for z in (x, y))
            distance[i] = int(np.bitwise_count(x ^ y).sum())
        keep = pa.array(_within(n, m, distance))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])


def _open_pairs(key, table):
    """Pairs of different classes, within the bound, of one block of members or of two (the
    blocks that the key names). Sizes are sorted, so that each member meets a range of them."""
    one, two = key[1].as_py(), key[2].as_py()
    n = table.column("n").to_numpy().astype(np.int64)
    order = np.argsort(n, kind="stable")
    n = n[order]
    ids, c, block = (table.column(x).to_numpy()[order] for x in ("id", "c", "block"))
    sketches = table.column("sketch").to_pylist()
    sketches = [_words_of(sketches[i]) for i in order]
    width = np.array([len(x) for x in sketches])
    # equal widths are neighbours, as widths go with sizes
    classes = {w: np.vstack([x for x in sketches if len(x) == w]) for w in np.unique(width)}
    begin = {w: int(np.searchsorted(width, w)) for w in classes}
    s = SIMILARITY
    out_a, out_b = [], []
    for i in range(len(ids)):
        w = width[i]
        end = int(np.searchsorted(n, n[i] * s.denominator // s.numerator, "right"))
        for v, rows in classes.items():
            low, high = max(i + 1, begin[v]), min(end, begin[v] + len(rows))
            if v < w or v > 2 * w or low >= high:
                continue
            other = (c[low:high] != c[i]) & ((block[low:high] != block[i]) if one != two else True)
            if not other.any():
                continue
            at = low + np.flatnonzero(other)
            near = folded_to(rows[at - begin[v]], w) ^ sketches[i][None]
            distance = np.bitwise_count(near).sum(1, dtype=np.int64)
            at = at[_within(np.full(len(at), n[i]), n[at], distance)]
            out_a += [int(ids[i])] * len(at)
            out_b += ids[at].tolist()
    return pa.table([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def _linked(batches):
    forget_codecs()
    hashes, last, left = _Words(), None, None
    for batch in batches:
        out_a, out_b = [], []
        columns = [batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")]
        for a, b, text_a, text_b in zip(*columns, strict=True):
            if (a, text_a) != last:
                last, left = (a, text_a), shingles(text_a, hashes)
                own = class_of(left) == a
            if not own:
                continue  # another text of the same id
            right = shingles(text_b, hashes)
            both = len(np.intersect1d(left, right, assume_unique=True))
            similar = both * SIMILARITY.denominator >= SIMILARITY.numerator * (len(left) + len(right) - both)
            if similar and class_of(right) == b:
                out_a.append(a)
                out_b.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["u", "v"])


def _few(ids: DataFrame) -> DataFrame:
    """Marked for broadcast if the counted rows are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def with_sides(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """pairs (a, b) with the other columns of values (id, ...) for both, named ..._a and ..._b.

    Comes in order of a. A class that is the `a` of many pairs, as the least of a large group is,
    has its pairs dealt to tasks by b, and its row of values repeated for each of those.
    """
    names = [c for c in values.columns if c != "id"]
    left, right = (values.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in names]) for s in "ab")
    heavy = pairs.groupBy("a").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("parts")).where("parts > 1")
    heavy = _few(heavy)
    last = F.coalesce("parts", F.lit(1)) - 1
    left = left.join(heavy, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), last))).drop("parts")
    part = F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0))
    pairs = pairs.join(heavy, "a", "left").withColumn("part", part).drop("parts")
    return pairs.join(right, "b").join(left, ["a", "part"]).drop("part")


def verified(rows: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (a, b) of classes whose whole sets are similar enough, as edges (u, v).
    classes: (c, rep), the document whose text stands for the class."""
    needed = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
    needed = needed.join(classes, "c").select("c", F.col("rep").alias("doc_id"))
    texts = rows.join(_few(needed), "doc_id").select(F.col("c").alias("id"), F.col("__text").alias("text"))
    both = with_sides(pairs, texts).select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_linked, "u long, v long")


def near_duplicates(spark: SparkSession, docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every doc_id of docs (doc_id, text).

    n_shingles is the size of the document's set of five-word shingles; component_id the least
    doc_id that links of similarity 0.75 or more lead to. Null and empty texts have no shingles
    and link with nothing. Rows that repeat a doc_id give one row: the greatest n_shingles and
    the least component_id, and what links to one of their texts is linked to all. Rows without
    a doc_id are kept, one row each, without component. An empty table gives an empty one; other
    columns of docs are not read, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("__text"))
    scratch = []

    def keep(df: DataFrame, tag: str) -> DataFrame:
        table, path = stored(spark, df, tag)
        scratch.append(path)
        return table

    profile = keep(rows.mapInArrow(_profile, "doc_id long, n long, c long, sketch binary, token long, seen long"), "profile")
    sets = profile.where("token is null").select("doc_id", "n", "c")
    often = (
        profile.where("token is not null")
        .groupBy("token")
        .agg(F.sum("seen").alias("seen"))
        .where(F.col("seen") >= COMMON)
        .orderBy(F.desc("seen"), "token")
        .limit(MOST_COMMON)
        .toPandas()
    )
    values = often["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    common = spark.sparkContext.broadcast((values[order], often["seen"].to_numpy(np.int64)[order]))

    # The least document of a class stands for it; rows that can't are left out.
    named = sets.where("doc_id is not null and n > 0")
    classes = keep(named.groupBy("c").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")), "classes")
    several = _few(classes.where("size > 1"))
    copies = named.join(several, "c").where("doc_id <> rep").select("doc_id").distinct()
    repeated = keep(
        named.groupBy("doc_id").agg(F.count("*").alias("size"), F.min("c").alias("low"), F.max("c").alias("high")).where("size > 1"),
        "repeated",
    )
    named_rows = rows.where("doc_id is not null")
    if not repeated.isEmpty():
        again = _few(repeated.select("doc_id"))
        copies = copies.join(_few(repeated.where("low < high").select("doc_id")), "doc_id", "left_anti")
        once = named_rows.join(again, "doc_id", "left_anti")
        named_rows = once.union(named_rows.join(again, "doc_id", "left_semi").distinct())
    distinct = named_rows.join(_few(keep(copies, "copies")), "doc_id", "left_anti")

    def keys(batches):
        return _keys(*common.value, hot)(batches)

    # (p, id): id shares a bucket of which p is the least class
    salt = F.when(F.col("hot"), F.col("id")).otherwise(F.lit(0))
    dealt = distinct.mapInArrow(keys, "key long, id long, hot boolean").withColumn("salt", salt)
    met = dealt.withColumn("p", F.min("id").over(W.partitionBy("key", "salt"))).where("hot or id <> p")
    met = keep(met.select("key", "id", "hot", "p"), "met")
    large = met.where("hot").select("key", "id")
    least = large.groupBy("key").agg(F.min("id").alias("p"))
    large = large.join(_few(least), "key").where("id <> p").select("p", "id")
    groups = keep(met.where("not hot").select("p", "id").union(large).distinct(), "groups")
    sketches = (
        profile.where("token is null and doc_id is not null and n > 0")
        .groupBy(F.col("c").alias("id"))
        .agg(F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    )
    stars = with_sides(groups.toDF("a", "b"), sketches).mapInArrow(_near, "a long, b long")
    links = keep(verified(named_rows, classes, keep(stars, "stars")), "links")
    # the texts of one id link their classes
    same = named.join(repeated.where("low < high"), "doc_id").where("c <> low").select(F.col("c").alias("u"), F.col("low").alias("v"))
    at_first = components(links.union(same)).toDF("id", "c")

    # What the stars left open: groups of three members or more that are in several parts.
    classed = (
        groups.union(groups.select("p", F.col("p").alias("id")).distinct())
        .join(at_first, "id", "left")
        .withColumn("c", F.coalesce("c", "id"))
    )
    mixed = classed.groupBy("p").agg(F.count("*").alias("size"), F.min("c").alias("low"), F.max("c").alias("high"))
    mixed = mixed.where("size > 2 and low < high").select("p", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    members = (
        classed.join(_few(keep(mixed, "mixed")), "p")
        .join(sketches, "id")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("p", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "id", "n", "sketch", "c", "block")
    )
    open_pairs = members.groupBy("p", "one", "two").applyInArrow(_open_pairs, "a long, b long").distinct()
    edges = at_first.toDF("u", "v").union(verified(named_rows, classes, keep(open_pairs, "open")))
    whole = keep(components(edges).select(F.col("u").alias("c"), F.col("v").alias("root")), "whole")

    # the least document of a component is that of one of its classes
    joined = whole.union(whole.select(F.col("root").alias("c"), "root").distinct()).join(classes.select("c", "rep"), "c")
    joined = keep(joined, "joined")
    component = joined.join(joined.groupBy("root").agg(F.min("rep").alias("component")), "root").select("c", "component")
    placed = (
        sets.join(_few(classes.where("size > 1").select("c", "rep")), "c", "left")
        .join(_few(component), "c", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
    )
    nameless = placed.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long"))
    result = placed.where("doc_id is not null").groupBy("doc_id").agg(
        F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id")
    )
    result = result.unionByName(nameless.select(*result.columns)).checkpoint()
    for path in scratch:
        remove(spark, path)
    return result
