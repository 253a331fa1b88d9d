"""Near duplicates and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("geoquilt.llm")
from geoquilt.llm import decontam, parity_join, queries
from geoquilt.llm.common import prepare
from geoquilt.llm.components import components

LOWER = {i: i + 32 for i in range(65, 91)}


def brute_groups(rows):
    """Ids may repeat, with other texts: each of an id's texts links it."""
    sets = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            both = len(a & b)
            if both and 100 * both >= 75 * len(a | b):
                u, v = sorted((root(i), root(j)))
                parent[v] = u
    return {i: (max(len(a) for j, a in sets if j == i), root(i)) for i in parent}


def corpus(seed, n=120):
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows, texts = [], []
    for i in range(n):
        kind = r.random()
        if texts and kind < 0.45:  # a near or exact copy, at varied distance
            w = list(r.choice(texts))
            for _ in range(r.randrange(0, max(1, len(w) // 25) + 1)):
                w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
            if r.random() < 0.3:
                w = w[: max(1, int(len(w) * r.uniform(0.7, 1)))]
        else:
            w = [f"w{r.randrange(3000)}" for _ in range(r.choice([1, 2, 3, 4, 5, 6, 8, 15, 40, 63, 64, 65, 130, 300]))]
            if kind > 0.75:
                at = r.randrange(len(w) + 1)
                w[at:at] = passage
        texts.append(w)
        rows.append((i * 3 + 1, r.choice([" ", "\t", "\n", "  "]).join(w)))
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(1, parity_join.HOT), (2, 2), (3, 0)])
def test_near_duplicates_equal_brute_force(spark, seed, hot):
    """hot: 0 deals all buckets to many tasks."""
    prepare(spark)
    rows = corpus(seed) + [(0, None), (2, ""), (5, " \t\n"), (6, "one"), (8, "ONE"), (9, "one two"), (11, "É"), (12, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.near_duplicates(spark, df, hot).collect()}
    assert got == brute_groups(rows)


def test_ids_with_several_texts(spark):
    """What is like one of an id's texts is linked to what is like another."""
    prepare(spark)
    r = random.Random(9)
    one, two, long = (" ".join(f"{x}{r.randrange(10**6)}" for _ in range(n)) for x, n in (("a", 90), ("b", 120), ("c", 20_000)))
    rows = [(3, one), (5, one), (5, two), (9, two), (7, two + " more"), (11, None), (11, two), (13, ""), (13, "x y"), (2, "x y"), (5, two)]
    rows += [(20, long), (21, long + " end"), (21, "other words of the same id that nothing else has")]
    rows += [(i, f"{t} {i}") for i, (_, t) in enumerate(corpus(4, 40), 4) for _ in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in parity_join.near_duplicates(spark, df).collect()}
    assert got == brute_groups(rows) and got[7][1] == got[9][1] == got[3][1]


@pytest.mark.parametrize("dealt", [parity_join.DEALT, 7])
def test_near_duplicates_of_a_large_group_and_odd_rows(spark, monkeypatch, dealt):
    """dealt: 7 makes the group's pairs go to many tasks."""
    monkeypatch.setattr(parity_join, "DEALT", dealt)
    prepare(spark)
    r = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):  # mutual near copies
        w = list(base)
        w[r.randrange(200)] = f"x{i}"
        rows.append((i + 10, " ".join(w)))
    rows += [(500 + i, "same words in every copy of this") for i in range(50)]
    rows += [(10, rows[0][1]), (None, rows[0][1]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = parity_join.near_duplicates(spark, df).collect()
    got = {x.doc_id: x.component_id for x in out if x.doc_id is not None}
    assert len(out) == len(got) + 2 and len(got) == 200
    assert {got[i + 10] for i in range(150)} == {10} and {got[500 + i] for i in range(50)} == {500}
    assert parity_join.near_duplicates(spark, df.limit(0)).count() == 0


def test_pairs_of_one_class_are_dealt(spark, monkeypatch):
    """Each pair once, whatever its class's number of pairs; no (a, part) has many more than DEALT."""
    monkeypatch.setattr(parity_join, "DEALT", 10)
    pairs = [(1, i) for i in range(2, 202)] + [(2, 3), (5, 7), (5, 8)]
    values = spark.createDataFrame([(i, f"t{i}") for i in range(1, 202)] + [(7, "again")], "id long, text string")
    out = parity_join.with_sides(spark.createDataFrame(pairs, "a long, b long"), values)
    got = sorted((r.a, r.b, r.text_a, r.text_b) for r in out.collect())
    twice = [(1, 7, "t1", "again"), (5, 7, "t5", "again")]
    assert got == sorted([(a, b, f"t{a}", f"t{b}") for a, b in pairs] + twice)
    assert parity_join.with_sides(spark.createDataFrame([], "a long, b long"), values).count() == 0


def test_sketch_pieces_bound_the_difference():
    """The first D + 1 pieces of linked sets meet, whatever the order of rarity."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 4, 7, 31, 32, 33, 63, 64, 65, 120, 127, 128, 129, 700):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            common = np.sort(rng.choice(a, max(1, len(a) // 2), replace=False))
            drop = int(rng.integers(0, len(a) // 4 + 1))
            b = np.sort(rng.permutation(a)[drop:])
            grow = int(len(a) * 4 / 3) - len(a) if not drop else 0
            b = np.unique(np.r_[b, rng.integers(0, 1 << 63, grow).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if 4 * both >= 3 * (len(a) + len(b) - both):
                counts = rng.integers(1, 9, len(common))
                keys = [set(parity_join.piece_keys(x, common, counts)[0].tolist()) for x in (a, b)]
                assert keys[0] & keys[1], (n, drop, grow)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(1, 51)} | {x: 100 for x in range(101, 140)} | {201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_hits(text, items):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        v = words(item)
        k = min(10, len(v))
        for s in range(len(v) - k + 1 if k else 0):
            for p in range(len(w) - k + 1):
                if w[p : p + k] == v[s : s + k]:
                    hit |= set(range(p, p + k))
                    names.add(str(name) if name is not None else "")
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def leaky(seed):
    r = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(25)] + ["été", "Ärger", "x1"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 9, 10, 11, 30])))) for i in range(12)]
    items += [(3, "a repeated id here"), (None, "nameless item"), (40, None), (41, "same same same same same same same same same same same same")]
    docs = []
    for i in range(60):
        w = [r.choice(vocabulary) for _ in range(r.randrange(0, 80))]
        if r.random() < 0.5:
            v = r.choice(items)[1] or ""
            at = r.randrange(len(w) + 1)
            w[at:at] = v.upper().split()[r.randrange(3) :]
        docs.append((i, r.choice([" ", ", ", "--"]).join(w)))
    docs += [(60, None), (61, ""), (62, " same" * 30), (62, " same" * 30), (None, "nameless item"), (63, "t1\x00t2")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_document_hits_equal_brute_force(spark, seed):
    prepare(spark)
    docs, items = leaky(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    tests = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.document_hits(spark, frame, tests).collect()
    got = sorted((r.doc_id or -1, *r[1:]) for r in rows)
    assert got == sorted((i or -1, *brute_hits(t, items)) for i, t in docs)
    assert decontam.document_hits(spark, frame.limit(0), tests).count() == 0
    none = decontam.document_hits(spark, frame, tests.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)


@pytest.mark.parametrize("words_of_a_block", [1, 20, 200_000])
def test_blocks_of_items_merge(spark, monkeypatch, words_of_a_block):
    """Repeated rows and rows without an id stay apart, whatever the number of blocks."""
    prepare(spark)
    docs, items = leaky(3)
    docs += [(None, "clean text"), (None, "t1 t2"), (None, None), (62, " clean" * 30), (70, "long " * 200_000 + items[11][1])]
    items = items if words_of_a_block > 1 else items[8:]
    monkeypatch.setattr(decontam, "BLOCK_WORDS", words_of_a_block)
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int").repartition(3)
    tests = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    got = sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in decontam.document_hits(spark, frame, tests).collect())
    assert got == sorted((-1 if i is None else i, *brute_hits(t, items)) for i, t in docs)


def test_one_index_serves_several_benchmarks(spark):
    prepare(spark)
    docs, items = leaky(4)
    index, _ = decontam.build_index(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(2))
    for some in (items[:6], items[6:]):
        tests = spark.createDataFrame(some, "item_id long, text string")
        got = sorted((r.doc_id or -1, *r[1:]) for r in decontam.index_hits(spark, index, tests).collect())
        assert got == sorted((i or -1, *brute_hits(t, some)) for i, t in docs)


def test_phrase_and_proximity_matches(spark):
    prepare(spark)
    docs = [(1, "zero alpha beta gamma end"), (2, "gamma x beta y alpha"), (3, "alpha beta"), (4, "gamma")]
    plan = decontam.Plan.of([("i", "Alpha beta, gamma")])
    index, _ = decontam.build_index(spark, spark.createDataFrame(docs, "doc_id long, text string"))
    exact = [(r.doc_id, r.item, r.item_word, r.doc_word) for r in decontam.matches(spark, index, plan).collect()]
    assert exact == [(1, "i", 0, 1)]
    near = {r.doc_id for r in decontam.matches(spark, index, plan, reach=4).collect()}
    assert near == {1, 2}
    assert {r.doc_id for r in decontam.matches(spark, index, plan, reach=1).collect()} <= {1}


def test_registered_sql_is_there():
    assert {"op3_parity_sketch_join", "op4_positional_index_decontamination"} <= set(queries.oracle_sql())
