"""Round trips: token ids, media files, archives, shard stores, page texts, the pipeline."""

import base64
import gzip
import hashlib
import random
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("geoquilt.llm")
import public_tokenizers
import tiktoken

from geoquilt.llm import bpe, compaction, html_consensus, matroska, queries, warc
from geoquilt.llm.common import prepare, workspace

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "\n\n  \n", "a" * 5000, "ab" * 4000, "!" * 3000, "é中😀" * 400, "don't we'll  I'M 12 34", "\x00\x1c\x85\xa0x"]


@pytest.fixture(scope="module")
def both():
    raw = open(RANKS, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.Codec(raw, public_tokenizers.PATTERN), own


def test_ids_equal_the_library(both):
    codec, library = both
    r = random.Random(7)
    signs = "abcdeABC  '''stvremll  \t\n\r\x0b\x0c\x1c\x1d\x1f\x85\xa0 　​0123½²éÉñ中文字😀ا٣́\x00\x7f!!??..--#$%"
    texts = [t or "" for t in ODD] + ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(3000)]
    for text, parts in zip(texts, codec.encode_all(texts), strict=True):
        ids = [i for part in parts for i in part.tolist()]
        assert ids == library.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()


def test_queue_gives_ranks_in_order():
    r = random.Random(1)
    queue = bpe.RankQueue(50_000)
    want = sorted(r.sample(range(50_000), 500))
    for rank in r.sample(want, 500):
        queue.put(rank, np.array([7, 1]))
    for rank in want[::2]:
        queue.put(rank, 3)
    for i, rank in enumerate(want):
        found, at = queue.take()
        assert found == rank and at.tolist() == ([1, 7] if i % 2 else [1, 3, 7])
    assert queue.take() is None


def _plain_merge(piece, ranks):
    """The least rank first, the leftmost of equals, by search of the whole list."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("many", [0, 4, 48])
def test_ranks_in_any_order(monkeypatch, many):
    """Also where a merge makes a pair of a lower rank, as vocabularies that weren't trained do."""
    monkeypatch.setattr(bpe, "MANY", many)
    r = random.Random(many)
    for _ in range(30):
        tokens = {"".join(r.choices("abc", k=r.randrange(2, 7))).encode() for _ in range(60)}
        order = [bytes([b]) for b in range(256)] + r.sample(sorted(tokens), len(tokens))
        ranks = {t: i for i, t in enumerate(order)}
        raw = b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in ranks.items())
        codec = bpe.Codec(raw, public_tokenizers.PATTERN)
        pieces = ["".join(r.choices("abc", k=r.randrange(1, 60))).encode() for _ in range(40)]
        ids, counts = codec.merge(pieces)
        want = [_plain_merge(p, ranks) for p in pieces]
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_memory_of_a_worker_is_bounded(monkeypatch, both):
    codec, library = both
    for name, value in (("REMEMBERED", 500), ("KEPT", 100), ("GROUP", 2000), ("QUEUED", 300), ("PART", 16)):
        monkeypatch.setattr(bpe, name, value)
    codec.forget()
    r = random.Random(5)
    texts = [" ".join("".join(r.choices("etaoinshr", k=r.randrange(1, 9))) for _ in range(r.randrange(700))) for _ in range(60)]
    for text, parts in zip(texts, codec.encode_all(texts), strict=True):
        assert [i for part in parts for i in part.tolist()] == library.encode_ordinary(text)
    assert len(codec.numbers) <= 500
    codec.forget()


def test_long_text_without_white_space(both):
    codec, library = both
    text = "".join(random.Random(3).choices("etaoinshrdlu", k=1_000_000))
    assert codec.encode(text) == library.encode_ordinary(text)


def test_encode_documents(spark, both):
    prepare(spark)
    _, library = both
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, "x"), (1, "")], "doc_id long, text string")
    rows = bpe.encode_documents(spark, df, RANKS, public_tokenizers.PATTERN, ["doc_id"]).collect()
    assert len(rows) == len(ODD) + 2
    for row in rows:
        text = "x" if row.doc_id is None else ODD[row.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert row.token_ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(spark, df.limit(0), RANKS, public_tokenizers.PATTERN, ["doc_id"]).count() == 0


# media


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 576 * 8, 576 * 9 + 3, 576 * 300 + 100])
def test_media_round_trip(size):
    data = random.Random(size).randbytes(size)
    media = matroska.write(data)
    movie = matroska.parse(media)
    assert matroska.read(media, movie) == data
    assert movie.tracks[1]["codec"] == "A_PCM/INT/LIT"
    assert [c[2] for c in movie.cues] == [c[0] for c in movie.clusters]
    stamps = [p[1] for p in movie.packets]
    assert stamps == [matroska.FRAME_MS * i for i in range(len(stamps))]


@pytest.mark.parametrize("mode", [matroska.XIPH, matroska.EBML])
def test_lacing_of_uneven_frames(mode):
    r = random.Random(mode)
    frames = [r.randbytes(n) for n in (0, 1, 254, 255, 256, 600, 3, 70000, 5)]
    e = matroska._element
    content = matroska.block(1, 0, frames, mode)
    track = e(matroska.TRACKS, e(matroska.ENTRY, e(matroska.NUMBER, b"\x01")))
    unknown = matroska._id(matroska.CLUSTER) + b"\x01" + b"\xff" * 7  # ends with the segment
    group = e(matroska.GROUP, e(matroska.BLOCK, content))
    inside = track + unknown + e(matroska.TIME, b"\x05") + group + unknown + e(matroska.TIME, b"\x09") + e(matroska.SIMPLE, content)
    media = e(matroska.HEADER, b"") + matroska._id(matroska.SEGMENT) + b"\xff" + inside
    movie = matroska.parse(media)
    assert [media[p : p + s] for _, _, p, s, _, _ in movie.packets] == frames * 2
    assert {p[1] for p in movie.packets} == {5, 9}


def test_damaged_media_raise():
    media = matroska.write(b"x" * 2000)
    for cut in (10, 60, len(media) - 3):
        with pytest.raises((ValueError, IndexError, struct.error)):
            matroska.parse(media[:cut])


def test_media_query_and_packet_table(spark):
    prepare(spark)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(None, "x", 2), (0, None, 3)], "doc_id long, text string, n_bytes int")
    rows = matroska.stored_texts(spark, df, ["doc_id"]).collect()
    assert matroska.stored_texts(spark, df.limit(0), ["doc_id"]).count() == 0
    assert len(rows) == len(ODD) + 2
    for r in rows:
        text = ("x" if r.doc_id is None else ODD[r.doc_id] or "").encode()
        payload = text + b"\xff" * (max(576, -(-len(text) // 576) * 576) - len(text))
        assert (r.n_bytes, r.payload_bytes) == (len(text), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        media = matroska.write(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        level = dict(x.split("=") for x in r.feature.split(";"))
        assert int(level["sum"]) == sum(b - 128 for b in payload) and int(level["energy"]) == sum((b - 128) ** 2 for b in payload)
        assert int(level["packets"]) == len(payload) // 576 == sum(map(int, level["lacing"].split("/")))
    files = matroska.media_files(df.where("doc_id = 5"), ["doc_id"]).withColumnRenamed("doc_id", "file")
    packets = matroska.packet_table(files).orderBy("timestamp").collect()
    media = files.first().media
    assert b"".join(media[p.first_byte : p.first_byte + p.size] for p in packets).rstrip(b"\xff").decode() == ODD[5]
    assert all(p.cue for p in packets)


# archives


def test_normalised_members_open_alone():
    payloads = [b"", b"a\r\n\r\nb", bytes(range(256)) * 900, b"WARC/1.1\r\n\r\n"]
    whole = warc.deflated(b"".join(warc.record(i, "http://x/ \n", p, None) for i, p in enumerate(payloads)), 1)
    archive, index = warc.normalise(whole)
    assert [warc.read_record(archive, *at)["payload"] for at in index] == payloads
    assert sum(n for _, n in index) == len(archive)
    assert warc.normalise(archive)[1] == index
    with pytest.raises(ValueError):
        warc.normalise(whole[:-20])
    with pytest.raises((ValueError, KeyError)):
        list(warc.records(iter([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"])))


def test_archived_pages(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    html = [(5, "http://a/", "same"), (3, None, "same"), (9, "u", "same"), (1, "u", None), (2, "u", ""), (4, "é\r\n", "é" * 5000), (None, "u", "same"), (7, "u", "x"), (7, "u", "x"), (9, "u", "other")]
    df = spark.createDataFrame(html, "page_id long, url string, html string").repartition(2)
    rows = warc.archived_pages(spark, df).collect()
    digest = lambda t: warc.payload_digest((t or "").encode())
    want = []
    for page_id, _, text in html:
        same = [i for i, _, t in html if (t or "") == (text or "") and i is not None]
        first = min(same)
        again = page_id is not None and page_id != first
        want.append((page_id, len((text or "").encode()), digest(text), "revisit" if again else "response", first if again else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    assert warc.archived_pages(spark, df.limit(0)).count() == 0


def test_archive_files_open_by_offset_alone(spark, tmp_path):
    prepare(spark)
    rows = [(i, f"http://a/{i}", f"page {i // 2}" * 40) for i in range(30)] + [(None, "http://n/", "page 0" * 40), (50, "http://long/", "x" * 9_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    whole, _ = warc.write_archives(spark, df)
    members, _ = warc.normalise_archives(spark, whole)
    files = warc.write_files(members, f"file://{tmp_path}/warc").collect()
    assert sum(f.records for f in files) == len(rows) + len(files)  # and a warcinfo each
    seen = []
    for f in files:
        path = tmp_path / "warc" / f"{f.file}.warc.gz"
        plain = gzip.open(path).read()
        assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        assert plain.count(b"WARC-Record-ID: <urn:") == f.records
        for line in (tmp_path / "warc" / f"{f.file}.idx").read_text().splitlines():
            offset, length, kind, name = line.split("\t")
            with open(path, "rb") as one:
                one.seek(int(offset))
                record = gzip.decompress(one.read(int(length)))
            assert record.startswith(f"WARC/1.1\r\nWARC-Type: {kind}\r\n".encode()) and name.encode() in record
            seen.append(kind)
    assert seen.count("revisit") == 15 and seen.count("response") == len(rows) - 15
    assert sorted(p.name for p in (tmp_path / "warc").iterdir()) == sorted(f.file + s for f in files for s in (".idx", ".warc.gz"))


# shard store


def test_store_keeps_rows_and_versions(spark):
    schema = "doc_id long, text string, __arrival int"
    rows = [(i if i % 7 else None, None if i % 5 == 0 else "t" * (i * 3), i) for i in range(200)] + [(1, "x", 1)] * 3
    df = spark.createDataFrame(rows, schema).repartition(4)
    store = compaction.ShardStore(spark, workspace(spark, "store"))
    assert store.version() == 0
    parts = [df.where(F.pmod("__arrival", F.lit(3)) == i) for i in range(3)]
    assert [store.append(part) for part in parts] == [1, 2, 3]
    sizes = [len(store.shards(v)) for v in (1, 2, 3)]
    assert sizes == sorted(set(sizes)) and all(s.bytes > 0 for s in store.shards())
    key = lambda r: tuple(str(x) for x in r)
    before = len(store.shards())
    last = store.compact()
    assert last == 4 and len(store.shards()) == 1 < before
    assert sorted(map(tuple, store.read().collect()), key=key) == sorted(rows, key=key)
    assert sorted(map(tuple, store.read(3).collect()), key=key) == sorted(rows, key=key)
    with pytest.raises(compaction.Conflict):
        store.commit(3, [], df.schema)
    assert store.version() == 4
    assert store.vacuum() == before
    assert store.read().count() == len(rows)
    assert store.compact() == 4  # nothing is due


def test_store_with_two_writers(spark):
    path = workspace(spark, "store")
    one, two = compaction.ShardStore(spark, path), compaction.ShardStore(spark, path)
    one.append(spark.range(5))
    # a writer that has written and not committed keeps its files
    spark.range(5, 9).write.parquet(f"{path}/data/late")
    late = two._written(f"{path}/data/late")
    assert late and one.vacuum() == 0
    assert two.commit(1, two.shards(1) + late, spark.range(1).schema) == 2
    assert sorted(r.id for r in one.read().collect()) == list(range(9))
    # an arrival in the middle of a merge is kept, and of two merges one counts
    members = {s.file for s in one.shards()}
    spark.range(9).coalesce(1).write.parquet(f"{path}/data/merged")
    two.append(spark.createDataFrame([(100,), (None,), (100,)], "id long"))
    one._replace(members, one._written(f"{path}/data/merged"))
    two._replace(members, late)
    left = [r.id for r in one.read().collect()]
    assert sorted(x for x in left if x is not None) == [*range(9), 100, 100] and left.count(None) == 1
    # files of failed writers go when they are old; a commit of files that are gone fails
    spark.range(3).write.parquet(f"{path}/data/failed")
    failed = one._written(f"{path}/data/failed")
    assert one.vacuum(orphan_age=-10) >= len(failed)
    with pytest.raises(FileNotFoundError):
        one.commit(one.version(), one.shards() + failed, spark.range(1).schema)
    assert one.read().count() == 12


def test_store_of_very_long_rows(spark):
    store = compaction.ShardStore(spark, workspace(spark, "store"))
    for i in range(5):
        store.append(spark.createDataFrame([(i, "x" * 3_000_000)], "id long, text string"))
    store.compact(target=1 << 20)
    assert store.read().selectExpr("sum(length(text))").first()[0] == 15_000_000


def test_store_of_an_empty_table(spark):
    store = compaction.ShardStore(spark, workspace(spark, "store"))
    with pytest.raises(ValueError):
        store.read()
    store.append(spark.createDataFrame([], "a int"))
    store.compact()
    assert store.read().count() == 0 and store.read().columns == ["a"]


def test_tiers():
    s = lambda *sizes: [compaction.Shard(f"f{i}", n << 20) for i, n in enumerate(sizes)]
    assert compaction.due(s(20, 21, 22), 128 << 20) == []
    assert [len(g) for g in compaction.due(s(20, 21, 22, 23, 1), 128 << 20)] == [4]
    assert [len(g) for g in compaction.due(s(20, 21, 22, 23, 1, 1, 1, 1, 1), 128 << 20)] == [5, 4]
    assert compaction.due(s(100, 100, 120, 128, 500), 128 << 20) == []
    assert compaction.due(s(90, 90, 90, 90), 128 << 20) and compaction.files_of(s(90, 90, 90, 90), 128 << 20) == 3


# pages

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p><p>no</p>';</script></head><body>"
    "<div id=cookie-notice>We use cookies</div><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>"
    "<div class='wrap has-sidebar'><article class='post-12'><header><h1>Title &amp; co</h1></header><p>One &lt;b&gt;"
    "<p>Two <i>it</i>alic<br>line  with\n\tspace<ul><li>a<li>b</ul><!-- <p>comment --><div class=share>Share</div>"
    "<form><p>mail</form><div class='ad banner'>Buy</div></article><section id=comments><p>Nice post</section></div>"
    "<aside>side</aside><footer>&copy; x</footer></body></html>"
)


def test_page_text():
    text = html_consensus.parse(PAGE).text(None)
    assert text == "Title & co\nOne <b>\nTwo italic line with space\na\nb"


def test_text_of_unmarked_parts():
    links = "<div><a href=/a>One</a> <a href=/b>Two</a></div>"
    page = f"<body>{links}<div><p>{'first ' * 30}</div><div><p>{'second ' * 30}</div>{links}</body>"
    text = html_consensus.parse(page).text(html_consensus.path_of("html", "body", "div"))
    assert text == ("first " * 30).strip() + "\n" + ("second " * 30).strip()
    marked = (
        "<body><div class='page-header'><p>Site name</div><div class=content><h2>Head</h2><pre>a\n b</pre><table><tr><td>c<td>d</table>"
        "<div class='comment-list'><p>reader</div><article class=comment>me too</article><div role=alert>alert</div><p hidden>x<p>end</div>"
        "<div class='newsletter-box'>Join</div><div id=related-posts>More</div></body>"
    )
    assert html_consensus.parse(marked).text(None) == "Head\na b\nc\nd\nend"


@pytest.mark.parametrize("source", ["", "plain words", "<", "<p", "<p class='x", "</p></div>", "<script>x", "<!-- x", "<a" * 2000, "<div>" * 3000 + "x", "<p>" + "y " * 100_000])
def test_broken_pages(source):
    html_consensus.parse(source).text(None)


@pytest.mark.parametrize(
    "attributes",
    [
        'class="content" style="overflow:hidden"', 'title="Hidden gems"', 'data-hidden="false"', 'data-id="comments"',
        "data-role=search", "data-x='class=\"sidebar\"'", 'aria-label="hidden" my-class = "menu"', 'alt="id=comments" /',
    ],
)
def test_values_and_longer_names_hide_nothing(attributes):
    assert html_consensus.parse(f"<body><div {attributes}>Text of the article</div></body>").text(None) == "Text of the article"


@pytest.mark.parametrize(
    "attributes",
    ["hidden", "HIDDEN", 'title="x"hidden', "a=b hidden", 'Class = "x sidebar"', "id=comments", "ROLE='search'", 'aria-hidden="true"'],
)
def test_attributes_that_hide(attributes):
    assert html_consensus.parse(f"<body><p>Seen</p><div {attributes}>Not seen</div></body>").text(None) == "Seen"


@pytest.mark.parametrize("opening", ["<div>", '<div class="seventeen-letters">', "<p><button><div>", "<ul><li>", "<b>", "<table><tr><td>", "<header>"])
def test_deep_pages_take_linear_time(opening):
    began = time.perf_counter()
    html_consensus.parse(opening * 100_000 + "x" + "</div>" * 100_000).text(None)
    assert time.perf_counter() - began < 10


def test_consensus_of_a_host(spark):
    prepare(spark)
    page = lambda a, b: f"<body><div class=main>{a}</div><div class=more>{b}</div></body>"
    long, short = "<p>" + "word " * 60, "<p>Short."
    rows = [(i, "http://H.example/x", page(long, "<p>few")) for i in range(5)] + [(9, "http://h.example/y", page(short, long))]
    rows += [(10, None, None), (11, "u", ""), (12, "http://other/", page(short, long)), (9, "http://h.example/y", page(short, long))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_consensus.extract(df, ["page_id", "url"]).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[9].text == "Short." and by[9].n_chars == 6  # by consensus, not its own best
    assert by[12].text.startswith("word")
    assert by[10].text == by[11].text == "" and by[0].text == ("word " * 60).strip()
    assert html_consensus.extract(df.limit(0), ["page_id"]).count() == 0


# pipeline


def test_pipeline_steps(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = pipeline.run(spark, sf).collect()
    kept = docs
    for _, stage in pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf)
        assert after.columns == docs.columns
        left = after.select("doc_id").collect()
        assert len(left) <= kept.count()
        kept = spark.createDataFrame(after.collect(), docs.schema)
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept.collect()}


def test_pipeline_stages_on_odd_rows(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    schema = "doc_id long, text string, lang string, source string, n_chars long, __drop int, token_ids string"
    rows = [(1, None, None, None, None, 1, "c"), (2, "", "en", "s", 0, 1, "c"), (None, "free text", "en", "s", 9, 1, "c"), (None, leak, "en", "s", 9, 1, "c"), (3, leak, "en", "s", 9, 2, None), (4, "a b c d e f g h", "en", "s", 1, 3, "c"), (4, "a b c d e f g h", "en", "s", 1, 3, "c"), (5, "A b c d e f g h", "en", "s", 1, 3, "c")]
    df = spark.createDataFrame(rows, schema)
    assert sorted(r.doc_id or 0 for r in pipeline.distinct(spark, df, sf).collect()) == [0, 0, 1, 2, 3, 4]
    left = pipeline.decontaminated(spark, df, sf).collect()
    assert sorted((r.doc_id or 0) for r in left) == [0, 1, 2, 4, 4, 5]
    for _, stage in pipeline.STAGES:
        assert stage(spark, df.limit(0), sf).count() == 0
        assert stage(spark, df, sf).count() <= len(rows)


def test_queries_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 11)]
