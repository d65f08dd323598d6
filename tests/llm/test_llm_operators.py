import hashlib
import random
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, langid, minhash_dedup, mixing, pii, progressive_jpeg, quality, resharding, substring_dedup, warc

SCHEMA = "doc_id long, text string, lang string, source string"


def docs_of(spark, rows):
    """rows: (doc_id, text) or more; a column of a clashing name comes along."""
    full = [(*r, *[None] * (4 - len(r))) for r in rows]
    return spark.createDataFrame(full, SCHEMA).withColumn("key", F.lit("clash")).withColumn("comp", F.lit(1)).withColumn("size", F.lit("x")).repartition(3)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


ODD = [(None, "null id " * 30), (900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ÄÖÜ ß Straße été 漢字 🎉"), (905, "tie " * 200), (906, "tie " * 200), (907, "x" * 5000)]


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(5)
    rows = []
    for g in range(6):
        base = prose(rng, 60).split()
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
        rows.append((len(rows), " ".join(base).upper()))
    rows += [(len(rows) + i, prose(rng, rng.randrange(1, 40))) for i in range(30)]
    return rows + [(100 + i, "short one") for i in range(5)] + [r for r in ODD if r[0] is not None]


def test_minhash_matches_brute_force(spark, near_rows):
    for k in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs_of(spark, near_rows), k=k).collect()}
        assert got == brute.near(near_rows, k)


def test_minhash_odd_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "A B C D E"), (None, "a b c d e"), (3, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (3, 3, True)], key=str) or got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, 1, True), (3, 3, True)], key=str)
    assert minhash_dedup.near_duplicates(docs_of(spark, [])).count() == 0


def test_minhash_repeated_ids_link_by_any_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (2, a.upper()), (9, b + " more"), (9, c), (7, c), (8, "apart"), (5, None)]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in minhash_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert {k: v for k, v in got.items() if k[1]} == {(5, 37): 2, (2, 37): 2, (9, 38): 2, (9, 37): 2, (7, 37): 2, (8, 1): 8} and got[5, 0] == 5


def test_minhash_small_blocks_lose_nothing(spark, near_rows, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    rng = random.Random(8)
    base = prose(rng, 60).split()
    chain = []
    for i in range(60):
        base = list(base)
        base[i] = f"c{i}"
        chain.append((1000 + i, " ".join(base)))
    rows = near_rows + chain
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == brute.near(rows)


def test_minhash_tiles_bring_all_components_together(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    for comps in ([0] * 70 + [1] * 30 + list(range(2, 30)), list(range(60)), [0] * 50 + [1], [3, 3, 4]):
        rows = [(7, i, c, 10, b"x") for i, c in enumerate(comps)] + [(8, i, 1, 10, b"x") for i in range(40)]
        got = minhash_dedup._tiles(spark.createDataFrame(rows, "key long, head long, comp long, size long, sig binary")).collect()
        tiles = {}
        for r in got:
            tiles.setdefault(r.tile, []).append((r["head"], r["side"]))
        assert max(map(len, tiles.values())) <= 40
        met = {(a, b) for t in tiles.values() for a, x in t for b, y in t if x != y or x < 0}
        assert all((a, b) in met for a, x in enumerate(comps) for b, y in enumerate(comps) if x != y)


def test_minhash_bucket_of_many_unlike_sets(spark):
    """20,000 sets of which each two are 75 % alike: no link, and no task gets more than a tile at once."""
    import numpy as np

    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 63, 12, dtype=np.int64)
    sig = minhash_dedup.packed(minhash_dedup.minima([common.view(np.uint64)]))[0].tobytes()
    rows = [(7, i, i, 14, sig, [*common.tolist(), -2 * i - 1, -2 * i - 2]) for i in range(20_000)]
    df = spark.createDataFrame(rows, "key long, head long, comp long, size long, sig binary, common array<long>").repartition(8)
    tiles = minhash_dedup._by_tile(minhash_dedup._tiles(df)).select("tile", "head", "comp", "size", "side", "sig", "common")
    assert tiles.groupBy("tile").count().agg(F.max("count")).first()[0] < 3 * minhash_dedup.BLOCK
    few = tiles.filter(F.pmod("tile", F.lit(20)) == 0)  # a twentieth of the tiles, for time
    assert few.mapInArrow(minhash_dedup._exact(0.59, 80), "a long, b long").count() == 0
    linked = few.mapInArrow(minhash_dedup._exact(0.59, 75), "a long, b long")
    assert 0 < linked.count() < few.count()


def test_minhash_estimate():
    import numpy as np

    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:850], rng.integers(0, 1 << 63, 150, dtype=np.uint64)])
    s = minhash_dedup.packed(minhash_dedup.minima([a, b]))
    assert abs(minhash_dedup.estimate(s[0], s[1]) - 850 / 1150) < minhash_dedup.MARGIN


def test_substring_matches_brute_force(spark):
    rng = random.Random(9)
    passage = prose(rng, 60)
    rows = [(i, f"{prose(rng, rng.randrange(50))} {passage if i % 3 else ''} {prose(rng, 10)}") for i in range(40)]
    rows += [(100, "a " * 70), (101, passage + " " + passage), (102, "b c " * 30)] + [r for r in ODD if r[0] is not None]
    for size in (20, 5):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs_of(spark, rows), size).collect()}
        assert got == brute.repeats(rows, size)


def test_substring_sketch_of_every_size_loses_nothing(spark, monkeypatch):
    rng = random.Random(19)
    passage = prose(rng, 40)
    rows = [(i, f"{prose(rng, 60)} {passage if i % 5 == 0 else ''} {prose(rng, 30)}") for i in range(60)]
    want = brute.repeats(rows)
    plans = substring_dedup.plans
    windows = sum(len(t.split()) - 19 for _, t in rows)
    passed = []
    candidates = substring_dedup._candidates
    for least, most, passes in ((1 << 20, 1 << 29, 8), (1 << 12, 1 << 12, 1), (1 << 8, 1 << 8, 1), (1 << 11, 1 << 11, 3), (1 << 8, 1 << 8, 4)):
        monkeypatch.setattr(substring_dedup, "SEGMENTS", 16)
        monkeypatch.setattr(substring_dedup, "plans", lambda size, least=least, most=most, passes=passes: plans(size, least, most, passes))
        seen = spark.sparkContext.accumulator(0)

        def counted(*a, seen=seen):
            def run(batches):
                for b in candidates(*a)(batches):
                    seen.add(b.num_rows)
                    yield b

            return run

        monkeypatch.setattr(substring_dedup, "_candidates", counted)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs_of(spark, rows)).collect()}
        assert got == want
        passed.append(seen.value)
    # a roomy sketch lets little but repeats through, a full one nearly all
    assert passed[0] < 0.2 * windows < passed[2] and [len(plans(40_000_000, 1 << 20, m, 8)) for m in (1 << 29, 1 << 20)] == [1, 2]


def test_substring_odd_rows(spark):
    t = " ".join(map(str, range(30)))
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_removed) for r in substring_dedup.remove_repeats(docs_of(spark, [(1, t), (1, t), (None, t)])).collect())
    assert got == [(1, 0), (1, 0), (99, 30)]
    assert substring_dedup.remove_repeats(docs_of(spark, [])).count() == 0


def test_mixing_targets_and_sampling(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(1, 60)), None, rng.choice(["a", "b", "b", "b", "é", None, "z"])) for i in range(400)] + [(1000, None, None, "a"), (1001, "", None, "none"), (5, "again a", None, "a"), (None, "no id", None, "b")]
    got = mixing.mix(docs_of(spark, rows)).collect()
    want = brute.mix([(r[0], r[1], r[3]) for r in rows])
    assert len(got) == len(rows)
    by = {}
    source = {r[0]: r[3] for r in rows}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        by.setdefault(r.target, [r.source_size, 0])[1] += r.taken
    assert {round(t, 6) for t in by} == {round(t, 6) for t in want.values()}
    for t, (_, taken) in by.items():
        assert abs(taken - t) <= 60 * 3
    again = {(r.doc_id, r.size): r.taken for r in mixing.mix(docs_of(spark, rows).repartition(5)).collect()}
    assert again == {(r.doc_id, r.size): r.taken for r in got} and source
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(docs_of(spark, [(1, None), (2, " ")])).collect()] == [0, 0]


def test_resharding_flow_is_least():
    for seed in range(6):
        rng = random.Random(seed)
        blocks = [(o, k, n := rng.randrange(1, 3), n * rng.randrange(5, 50)) for o in range(3) for k in range(1)] + [(1, 7, 2, 30)]
        for shards in (2, 3):
            moves, cost = resharding.solve(blocks, shards)
            assert cost == brute.flow_cost(blocks, shards)
            assert sum(m.hi - m.lo for m in moves) == sum(b[2] for b in blocks)


def test_resharding_contract(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(80)), None, rng.choice("aaab")) for i in range(300)] + [(7, "again"), (None, None), (901, "")]
    old = F.when(F.col("source") == "a", 0).when(F.col("source") == "b", 30)
    got = resharding.reshard(docs_of(spark, rows), old, 24).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    counts = [len(s) for s in slots.values()]
    assert len(slots) == 24 and max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    assert sorted((r["size"], r.text_crc32) for r in got) == want and all(r.moved == (r.old_shard != r.shard) for r in got)
    assert resharding.reshard(docs_of(spark, []), F.lit(0), 24).count() == 0
    assert resharding.reshard(docs_of(spark, [(1, "a")]), F.lit(None), 24).count() == 1


def test_resharding_rewrites_only_what_it_must(spark, tmp_path):
    path = str(tmp_path / "t")
    base = spark.createDataFrame([(i, f"text {i}", "en", "s") for i in range(60)], SCHEMA)
    base.withColumn("shard", (F.col("doc_id") % 2 + F.when(F.col("doc_id") < 40, 0).otherwise(2)).cast("int")).repartition(1).write.partitionBy("shard").parquet(path)
    before = {p.parent.name: p.name for p in (tmp_path / "t").glob("*/part-*")}
    touched = resharding.rewrite_files(spark.read.parquet(path), path, 4)
    after = spark.read.parquet(path)
    assert after.count() == 60 and sorted(r[1] for r in after.groupBy("shard").count().collect()) == [15] * 4
    assert touched == [0, 1, 2, 3]
    again = resharding.rewrite_files(spark.read.parquet(path), path, 4)
    assert again == [] and before


def test_resharding_moves_the_smallest_rows_of_a_class(spark):
    rows = [(i, "x" * (70 + i * 37 % 50)) for i in range(50)]  # sizes 78 to 127: one class
    got = resharding.reshard(docs_of(spark, rows), F.lit(0), 5).collect()
    assert sorted(r["size"] for r in got if not r.moved) == list(range(118, 128))
    assert sum(r["size"] for r in got if r.moved) == sum(range(78, 118))


def test_resharding_query_reads_rewritten_files(spark, tmp_path, monkeypatch):
    from tessera.llm import queries

    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(60)), "en", rng.choice("aaab")) for i in range(200)] + [(7, "again", "en", "b"), (None, None, None, None)]
    docs_of(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    calls, rewrite = [], resharding.rewrite_files
    monkeypatch.setattr(resharding, "rewrite_files", lambda docs, path, *a: calls.append((path, rewrite(docs, path, *a))))
    got = queries.op5_resharding(spark, str(tmp_path)).collect()
    (path, touched), = calls
    assert touched and {r.shard: r.n for r in spark.read.parquet(path).groupBy("shard").agg(F.count("*").alias("n")).collect()} == {s: sum(r.shard == s for r in got) for s in range(24)}
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    assert sorted((r["size"], r.text_crc32) for r in got) == want and all(r.moved == (r.old_shard != r.shard) for r in got)
    for s in range(24):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (len(rows) // 24, len(rows) // 24 + 1)
    plan = resharding.reshard(spark.read.parquet(str(tmp_path / "documents.parquet")), queries.old_layout(), 24)
    assert sorted((r.old_shard, r["size"], r.text_crc32, r.shard) for r in plan.collect()) == sorted((r.old_shard, r["size"], r.text_crc32, r.shard) for r in got)
    assert resharding.through_files(docs_of(spark, []), F.lit(0), 24).count() == 0
    assert resharding.through_files(docs_of(spark, [(1, "a")]), F.lit(None), 24).count() == 1


def test_warc_round_trip_and_revisits(spark):
    html = "<p>é</p>"
    rows = [(5, "http://a", html), (2, "http://b\r\nX: y", html), (9, None, html), (3, "u", None), (4, "u", ""), (7, "u", "z" * 10000), (None, "u", html), (2, "http://b", html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash")).repartition(3)
    got = warc.round_trip(pages).collect()
    want = {2: ("response", None), 5: ("revisit", 2), 9: ("revisit", 2), 3: ("response", None), 4: ("revisit", 3), 7: ("response", None), None: ("revisit", 2)}
    assert len(got) == len(rows) and {r.page_id: (r.record_type, r.refers_to) for r in got} == want
    for r in got:
        data = next((h or "").encode() for p, _, h in rows if p == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(data), warc.digest(data))
    assert {r.record_type for r in warc.round_trip(pages, least=20_000).collect()} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_salvage():
    import gzip

    plain = [warc.record(i, f"http://{i}", bytes([65 + i]) * 50 + b"\r\n\r\nWARC/1.1\r\n fake \x1f\x8b\x08") for i in range(6)]
    for members in ([gzip.compress(p, mtime=0) for p in plain], plain):
        data = b"".join(members)
        assert [warc.page_of(r.headers["WARC-Record-ID"]) for r in warc.salvage(data)] == list(range(6))
        at = sum(map(len, members[:2])) + len(members[2]) // 2
        for broken, lost in ((data[:at] + b"\xff\xfe\xfd" + data[at + 3 :], {2}), (data[: at - 5] + data[at:], {2}), (data[:-7], {5}), (b"junk" * 9 + data, set()), (data[:at] + b"noise" + data[at:], {2})):
            found = list(warc.salvage(broken))
            records = [r for r in found if isinstance(r, warc.Record)]
            gaps = [g for g in found if isinstance(g, warc.Gap)]
            assert {warc.page_of(r.headers["WARC-Record-ID"]) for r in records} == set(range(6)) - lost and len(gaps) == 1 and gaps[0].reason
            spans = sorted((x.offset, x.offset + x.length) for x in found)
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)) and sum(b - a for a, b in spans) == len(broken)
    assert list(warc.salvage(b"")) == [] and len(list(warc.salvage(b"\x1f\x8b\x08"))) == 1


def test_warc_reads_in_linear_time_and_bounds_files(spark, tmp_path, monkeypatch):
    import gzip
    import time

    def took(n):
        data = b"".join(gzip.compress(warc.record(i, "u", random.Random(i).randbytes(8000)), 1) for i in range(n))
        start = time.perf_counter()
        assert sum(1 for _ in warc.salvage(data)) == n
        return time.perf_counter() - start

    took(100)
    assert took(4000) < 8 * max(took(1000), 0.05)
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    rng = random.Random(3)
    pages = spark.createDataFrame([(i, "u", "".join(chr(rng.randrange(33, 9000)) for _ in range(300 if i else 5000))) for i in range(40)], "page_id long, url string, html string").repartition(2)
    warc.write_archives(pages, str(tmp_path / "w"))
    sizes = sorted(p.stat().st_size for p in (tmp_path / "w").glob("part-*"))
    assert len(sizes) > 10 and sizes[-2] < 2200 and warc.read_archives(spark, str(tmp_path / "w")).filter("reason IS NULL").count() == 40


def test_warc_reader_logs_gaps(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(warc.record(1, "u", b"one") + b"@@@@" + warc.record(2, "u", b"two"))
    rows = sorted(warc.read_archives(spark, str(tmp_path)).collect(), key=lambda r: r.offset)
    assert [r.page_id for r in rows] == [1, None, 2] and rows[1].length == 4 and rows[1].reason and bytes(rows[2].payload) == b"two"


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, 12 + i, 5000)) for i in range(8)] + [(20, None), (21, "..."), (22, "two words"), (None, "x y z w v")]
    w = items[3][1].split()
    texts = [items[0][1], prose(rng, 30) + " " + items[1][1].upper().replace(" ", ", ") + " " + prose(rng, 900), " ".join(w[8:] + ["zz"] + w[:8]), " ".join(w[:5]), prose(rng, 200), None, "", "so Two. words!", items[5][1] + " " + items[4][1]]
    rows = list(enumerate(texts))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {r.doc_id: r for r in decontamination.find_leaks(docs_of(spark, rows), bench).collect()}
    assert {d: r.item_id for d, r in got.items() if r.contaminated} == {0: 0, 1: 1, 2: 3, 7: 22, 8: 4} and got[8].leaks == 2 and got[2].tiles == 2 and got[4].coverage == 0
    assert decontamination.find_leaks(docs_of(spark, []), bench).count() == 0
    assert not any(r.contaminated for r in decontamination.find_leaks(docs_of(spark, rows), bench.limit(0)).collect())


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, prose(rng, 15, 5000)) for i in range(30)]
    rows = [(i, prose(rng, 40) + " " + items[i % 30][1]) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontamination.find_leaks(docs_of(spark, rows), bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 100)
    assert sorted(map(tuple, decontamination.find_leaks(docs_of(spark, rows), bench).collect())) == one and sum(r[1] for r in one) == 40


def test_tiling_matches_plain_definition():
    import numpy as np

    for seed in range(150):
        rng = random.Random(seed)
        item = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 16))]
        text = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 30))]
        found = decontamination.tiles(np.array(item, np.uint64), np.array(text, np.uint64), 3)
        assert all(item[p : p + n] == text[t : t + n] and n >= 3 for p, t, n in found)
        used = [p + i for p, _, n in found for i in range(n)]
        assert len(used) == len(set(used))
        assert len(used) == brute.tiling(item, text, 3)


def test_tiling_in_pieces_and_of_repetitive_texts(monkeypatch):
    import time

    import numpy as np

    item, text = (np.array([1, 2] * n, np.uint64) for n in (2000, 8000))
    start = time.perf_counter()
    assert decontamination.tiles(item, text, 4) == [(0, 0, 4000)] and time.perf_counter() - start < 20
    rng = random.Random(1)
    cases = [[np.array([rng.randrange(1, 4) for _ in range(n)], np.uint64) for n in (40, 90)] for _ in range(40)]
    whole = [decontamination.tiles(a, b, 3) for a, b in cases]
    monkeypatch.setattr(decontamination, "HITS", 7)
    assert [decontamination.tiles(a, b, 3) for a, b in cases] == whole
    assert all(sum(t[2] for t in x) == brute.tiling(a.tolist(), b.tolist(), 3) for x, (a, b) in zip(whole, cases, strict=True))


def test_decontamination_matches_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    items = [(i, prose(rng, rng.randrange(3, 25), 12)) for i in range(12)]
    rows = [(i, " ".join(rng.choice(items)[1] if rng.random() < 0.3 else prose(rng, 6, 12) for _ in range(rng.randrange(1, 8)))) for i in range(60)] + [(70, "w1 " * 3000), (71, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for d, t in rows:
        share = {i: brute.tiling(x.split(), (t or "").split(), min(4, len(x.split()))) / len(x.split()) for i, x in items} if d != 70 else {}
        hit = {i: s for i, s in share.items() if s >= 0.6}
        want[d] = (len(hit), *(min((-s, i) for i, s in hit.items()) if hit else (0, None)))
    for hits in (decontamination.HITS, 5):
        monkeypatch.setattr(decontamination, "HITS", hits)
        got = {r.doc_id: (r.leaks, -r.coverage, r.item_id) for r in decontamination.find_leaks(docs_of(spark, rows), bench).collect()}
        assert got == want


def test_pii_base_matches_brute_force():
    rng = random.Random(1)
    bits = ["a@b.co", "x.y+z@mail.example.com", "@", "a@b", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+123", "12", ".", "-", "é", " ", " ", "+", "(", "0", "555-1234", "a@@b.c", "..@x.y", "+44 20 7946 0958 "]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert pii.strict(t) == brute.personal(t), t


def test_pii_long_runs_take_linear_time():
    import time

    n = 1_000_000
    for t in ("a" * n + "@x", "a@" * (n // 2), "1" * n + ".2.3", "1." * (n // 2), "0" * 5000 + ".1.2.3", "+" + "(" * n, "a" * n + " (at) x", "1 " * (n // 2), "[at]" * (n // 8) + "x", "+1 (743) 555-3824 " * 5000):
        start = time.perf_counter()
        pii.candidates(t)
        assert time.perf_counter() - start < 3, t[:20]
    assert pii.strict("0" * 5000 + ".1.2.3") == [(0, 1, 5006)]


def test_pii_loose_addresses_match_the_pattern():
    import re

    plain = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]+(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]+)+")
    rng = random.Random(2)
    bits = ["a", "b.c", "[at]", "(at)", " ", "[dot]", "(dot)", ".", "-", "com", "é", "("]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert list(pii._spelled(t)) == [m.span() for m in plain.finditer(t)], t


def test_pii_agreement_matches_plain_version():
    rng = random.Random(6)
    counts = {}
    for _ in range(40):
        v = tuple(rng.randrange(3) for _ in pii.LABELERS)
        counts[v] = rng.randrange(1, 200)
    code = lambda v: int("".join(map(str, v)), 3)
    for kind in range(4):
        post, _ = pii.estimate({(kind, code(v)): n for v, n in counts.items()})
        want = brute.agreement(counts, len(pii.LABELERS))
        assert all(abs(post[kind, code(v)] - p) < 1e-6 for v, p in want.items())


def test_pii_classifier_reaches_a_minimum():
    import math

    counts = {(k, c): 1 + (7 * c + k) % 13 for k in range(4) for c in range(0, 243, 11)}
    post = {x: (x[1] % 10) / 10 for x in counts}
    w = pii.train(counts, post, rounds=4000)
    total, ridge = sum(counts.values()), 0.05 / 100

    def gradient(i):
        out = ridge * w[i]
        for x, n in counts.items():
            f = pii.features(*x)
            out += n / total * (1 / (1 + math.exp(-sum(a * b for a, b in zip(f, w, strict=True)))) - post[x]) * f[i]
        return out

    assert max(abs(gradient(i)) for i in range(0, len(w), 7)) < 1e-3


def test_pii_query(spark):
    rows = [(i, f"mail a{i}@b.org call +1 (743) 555-3{i:03d} or (743) 555-1{i:03d} now 1.2.3.{i}") for i in range(50)] + [(60, None), (61, ""), (62, "card 4111 1111 1111 1111 4111 1111 1111 1111"), (63, "code 1234567812345678 and 9807915762804490")] + [(1, "x@y.z")]
    rows += [(100 + i, f"card 4111 1111 1111 1111 of {i}") for i in range(60)] + [(200 + i, f"ref 980791576280449{i % 10}") for i in range(60)]
    got = sorted(pii.find(docs_of(spark, rows)).collect(), key=lambda r: (r.doc_id, r.spans))
    by = {r.doc_id: r for r in got}
    for d, t in rows[1:]:
        if d == 1:
            continue
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute.personal(t or ""))
        assert by[d].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(by[d].spans.split(","))
    assert by[0].n_added == 1 and by[62].n_added == 2 and by[63].n_added == 0 and by[60].spans == "" and len(got) == len(rows)
    assert pii.find(docs_of(spark, [])).count() == 0


def test_langid_counts_and_training_match_plain_versions():
    import numpy as np
    import pyarrow as pa

    texts = ["Hello,  World! 12", "é ü 漢字 x", "", None, "ab" * 50, "  lead"]
    got = {}
    for i, j, row, term, n in langid.gram_counts(pa.array(texts)):
        for r, t, c in zip(row, term, n, strict=True):
            got.setdefault(i + int(r), {})[int(t)] = int(c)
    assert [got.get(i, {}) for i in range(len(texts))] == [brute.grams(t or "", langid.TERMS) for t in texts]

    rng = np.random.default_rng(4)
    rows = [(np.sort(rng.choice(30, 6, replace=False)), rng.random(6)) for _ in range(40)]
    y = np.array([int(r[0][0] > 3) + int(r[0][0] > 7) for r in rows])
    w, b = langid.ftrl(rows, y, 30, 3, epochs=2, seed=9)
    again = np.random.default_rng(9)
    order = [r for _ in range(2) for r in again.permutation(40)]
    want = brute.ftrl([dict(zip(map(int, t), map(float, v), strict=True)) for t, v in rows], y, 3, order, langid.ALPHA, langid.BETA, langid.L1, langid.L2)
    assert all(abs((b[c] if t is None else w[t, c]) - v) < 1e-5 for (t, c), v in want.items()) and (w == 0).any()


def test_langid_held_out_texts_teach_nothing(spark):
    rng = random.Random(3)
    words = {"aa": "the of and to in that".split(), "bb": "le la et les des une".split(), "cc": "der die und das ist nicht".split()}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(12)), g) for i, g in enumerate(rng.choice(sorted(words)) for _ in range(300))]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    other = [(i, "zz qq " * 40, "dd") if held(i) else (i, t, g) for i, t, g in rows]
    one, two = ({r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs_of(spark, x)).collect()} for x in (rows, other))
    assert all(one[i] == two[i] for i, *_ in rows if not held(i)) and not any(r[0] == "dd" for r in two.values())
    assert sum(one[i][0] == g for i, _, g in rows if held(i)) > 0.9 * sum(held(i) for i, *_ in rows)


def test_quality_vote_matches_plain_version():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    x = random.Random(2)
    texts = [prose(x, x.randrange(3, 60)) if i % 3 else " | ".join(prose(x, 20).upper().split()) for i in range(60)] + ["", None, "a"]
    (_, _, row, term, n), = quality.term_counts(pa.array(texts))
    vectors = rng.standard_normal((200, quality.RANK)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = (rng.random(200) < 0.5).astype(np.float32)
    m = quality.Model(rng.random(quality.TERMS).astype(np.float32), rng.standard_normal((quality.TERMS, quality.RANK)).astype(np.float32), vectors, labels, np.where(labels, 2, 3).astype(np.float32), 0.25)
    got = quality.vote(len(texts), row, term, n, m)
    for i in range(len(texts)):
        mine = {int(t): float(c) for r, t, c in zip(row, term, n, strict=True) if r == i}
        if not mine:
            assert got[i] == 0.25
            continue
        v = {t: c**0.5 * float(m.weight[t]) for t, c in mine.items()}
        z = sum(c * m.basis[t].astype(float) for t, c in v.items())
        cos = sorted(((float(vectors[j].astype(float) @ z / np.linalg.norm(z)), j) for j in range(200)), reverse=True)[: quality.NEIGHBOURS]
        w = [max(c, 0) ** quality.SHARPNESS * float(m.votes[j]) for c, j in cos]
        assert abs(got[i] - sum(a * labels[j] for a, (_, j) in zip(w, cos, strict=True)) / sum(w)) < 1e-3


def test_quality_space_is_the_leading_one():
    import numpy as np

    rng = np.random.default_rng(6)
    x = (rng.standard_normal((80, 20)) * (2.0 ** -np.arange(20)) @ rng.standard_normal((20, 300))).astype(np.float32)
    basis, (_, _, v) = quality.decompose(x, 5), np.linalg.svd(x, full_matrices=False)
    assert np.abs(np.abs(basis.T @ v[:5].T) - np.eye(5)).max() < 1e-2


def test_quality_of_contradicting_labels(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 30) if i % 2 else " !! ".join(prose(rng, 30).upper().split())) for i in range(80)]
    labels = [(i, i % 2) for i, _ in rows]
    more = [(i, 1) for i, _ in rows if i % 2 == 0]
    table = lambda x: spark.createDataFrame(x, "doc_id long, quality int")
    one, two = (sorted(map(tuple, quality.classify(docs_of(spark, rows), table(x)).collect())) for x in (labels, labels + more))
    assert one == two and [r[3] for r in one] == [i % 2 for i, _ in rows]


def test_jpeg_round_trip(spark):
    rows = [(i, "abc é " * i) for i in range(0, 200, 17)] + [(900, None), (901, "🎉" * 3000), (1, "same"), (2, "same")]
    got = {r.doc_id: r for r in progressive_jpeg.digests(progressive_jpeg.store_column(docs_of(spark, rows))).collect()}
    for d, t in rows:
        data = (t or "").encode()
        p = progressive_jpeg.pad(data)
        assert len(p) % 192 == 0 and p.startswith(data)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert got[1].feature == got[2].feature and got[1].media_sha256 == got[2].media_sha256
    assert progressive_jpeg.digests(progressive_jpeg.store_column(docs_of(spark, []))).count() == 0


def test_jpeg_tensors(spark):
    good = progressive_jpeg.store(progressive_jpeg.pad(b"hello"))
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(good[:200])), (3, None), (4, bytearray(b"\xff\xd8junk"))], "id long, media binary")
    got = {r.id: r for r in progressive_jpeg.tensors(df).collect()}
    assert (got[1].width, got[1].height, len(got[1].rgb)) == (16, 16, 768) and got[1].error is None and all(got[i].rgb is None and got[i].error for i in (2, 3, 4))


class Writer:
    """A general progressive encoder: bands, runs of blocks, long zero runs, refinement; all codes are of 8 bits."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> (n - 1 - i) & 1 for i in range(n)]

    def bytes(self):
        b = self.bits + [1] * (-len(self.bits) % 8)
        return bytes(sum(x << (7 - j) for j, x in enumerate(b[i : i + 8])) for i in range(0, len(b), 8)).replace(b"\xff", b"\xff\0")


def encode(comps, width, height, quant, restart=0):
    """comps: [(h, v, coefficients by block row and column)]. Scans: direct terms interleaved, then bands with two refinements."""
    seg = lambda k, b: bytes([255, k]) + (len(b) + 2).to_bytes(2) + b
    symbols = bytes(range(255))
    table = lambda c: bytes([c << 4, *([0] * 7), 255, *([0] * 8)]) + symbols
    out = b"\xff\xd8" + seg(0xDB, b"\0" + bytes(quant)) + seg(0xC2, b"\x08" + height.to_bytes(2) + width.to_bytes(2) + bytes([len(comps)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v, _) in enumerate(comps)))
    out += seg(0xC4, table(0)) + seg(0xC4, table(1))
    top_h, top_v = max(c[0] for c in comps), max(c[1] for c in comps)
    units = (-(-width // (8 * top_h)), -(-height // (8 * top_v)))
    size = lambda x: abs(x).bit_length()
    raw = lambda x: x if x > 0 else x + (1 << size(x)) - 1
    down = lambda x, s: (abs(x) >> s) * (1 if x > 0 else -1)
    for ah, al in ((0, 1), (1, 0)):
        w, last = Writer(), [0] * len(comps)
        for r in range(units[1]):
            for k in range(units[0]):
                for i, (h, v, c) in enumerate(comps):
                    for y in range(v):
                        for x in range(h):
                            value = int(c[r * v + y, k * h + x, 0])
                            if ah:
                                w.put(value & 1, 1)
                            else:
                                d = (value >> al) - last[i]
                                last[i] = value >> al
                                w.put(size(d), 8)
                                if d:
                                    w.put(raw(d), size(d))
        out += seg(0xDA, bytes([len(comps)]) + b"".join(bytes([i + 1, 0]) for i in range(len(comps))) + bytes([0, 0, ah << 4 | al])) + w.bytes()
    for i, (h, v, c) in enumerate(comps):
        across, deep = -(-(-(-width * h // top_h)) // 8), -(-(-(-height * v // top_v)) // 8)
        blocks = [c[r, k] for r in range(deep) for k in range(across)]
        for lo, hi in ((1, 9), (10, 63)):
            for ah, al in ((0, 2), (2, 1), (1, 0)):
                w, run, waiting = Writer(), 0, []

                def flush(w=w):
                    nonlocal run
                    if run:
                        n = run.bit_length() - 1
                        w.put(n << 4, 8)
                        w.put(run - (1 << n), n)
                        w.bits += waiting
                        waiting.clear()
                        run = 0

                for b in blocks:
                    ends = [at for at in range(lo, hi + 1) if abs(int(b[at])) >> al == 1 or not ah and abs(int(b[at])) >> al]
                    end = max(ends, default=lo - 1)
                    zeros, held = 0, []
                    for at in range(lo, hi + 1):
                        a = abs(int(b[at])) >> al
                        if at > end:
                            held += [a & 1] * (ah and a > 1)
                        elif a == 0:
                            zeros += 1
                        elif ah and a > 1:
                            held.append(a & 1)
                        else:
                            flush()
                            # a long run may pass values known before, whose bits follow its code
                            while zeros > 15:
                                w.put(0xF0, 8)
                                at0, n = w_at, 0
                                bits = []
                                while n < 16:
                                    q = abs(int(b[at0])) >> al
                                    if q > 1 and ah:
                                        bits.append(q & 1)
                                    else:
                                        n += 1
                                    at0 += 1
                                w.bits += bits
                                held = held[len(bits) :]
                                zeros -= 16
                                w_at = at0
                            x = down(int(b[at]), al)
                            w.put(zeros << 4 | (1 if ah else size(x)), 8)
                            w.put((1 if x > 0 else 0) if ah else raw(x), 1 if ah else size(x))
                            w.bits += held
                            zeros, held = 0, []
                            w_at = at + 1
                            continue
                        if at == lo:
                            w_at = lo
                    if end < hi:
                        run += 1
                        waiting += held
                        if run == 0x7FFF:
                            flush()
                flush()
                out += seg(0xDA, bytes([1, i + 1, 0, lo, hi, ah << 4 | al])) + w.bytes()
    return out + b"\xff\xd9"


def test_jpeg_general_scans():
    import numpy as np

    rng = np.random.default_rng(7)
    for density in (0.02, 0.3, 0.9):
        for layout in (((2, 2), (1, 1), (1, 1)), ((1, 1), (1, 1), (1, 1)), ((1, 1),)):
            width, height = 45, 37
            th, tv = max(h for h, _ in layout), max(v for _, v in layout)
            units = (-(-width // (8 * th)), -(-height // (8 * tv)))
            comps = []
            for h, v in layout:
                c = np.where(rng.random((units[1] * v, units[0] * h, 64)) < density, rng.integers(-60, 61, (units[1] * v, units[0] * h, 64)), 0)
                comps.append((h, v, c))
            image = progressive_jpeg.read(encode(comps, width, height, [1 + i % 7 for i in range(64)]))
            for got, (h, v, c) in zip(image.comps, comps, strict=True):
                # blocks outside a component's own bounds carry direct terms only
                own = c.copy()
                own[got.down :, :, 1:] = 0
                own[:, got.across :, 1:] = 0
                assert (got.coef == own).all()
            t = progressive_jpeg.rgb(image)
            assert t.shape == (height, width, 3)


def test_jpeg_transform():
    import numpy as np

    rng = np.random.default_rng(3)
    image = progressive_jpeg.read(progressive_jpeg.store(bytes(rng.integers(0, 256, 384, dtype=np.uint8))))
    for c, plane in zip(image.comps, progressive_jpeg.planes(image), strict=True):
        f = np.zeros(64)
        f[progressive_jpeg.ZIGZAG] = c.coef[0, 0] * image.quant[c.table]
        f = f.reshape(8, 8)
        k = np.arange(8)
        a = np.where(k == 0, np.sqrt(0.5), 1)
        want = np.array([[sum(a[u] * a[v] / 4 * f[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)]) + 128
        step = 2 if c.h == 1 else 1
        assert np.abs(plane[: 8 * step : step, : 8 * step : step] - want).max() < 0.05


def test_fast_and_general_scans_agree():
    import random as R

    for n in (1, 2, 5, 33):
        data = bytes(R.Random(n).randrange(256) for _ in range(192 * n))
        m = progressive_jpeg.store(data)
        a, b = progressive_jpeg.read(m), progressive_jpeg.read(m, fast=False)
        assert progressive_jpeg.payload(a) == progressive_jpeg.payload(b) == data


def _style(rng, good):
    w = [prose(rng, 1) for _ in range(rng.randrange(20, 60))]
    return " ".join(w).capitalize() + "." if good else " | ".join(x.upper() + "!!" for x in w)


def test_quality(spark):
    rng = random.Random(6)
    rows = [(i, _style(rng, i % 4 != 0)) for i in range(400)] + [r for r in ODD if r[0] is not None]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)] + [(None, 1), (3, 1)], "doc_id long, quality int")
    out = quality.classify(docs_of(spark, rows), labels).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [i for i in range(400) if got[i].held_out]
    assert sum(got[i].predicted == (i % 4 != 0) for i in held) >= 0.97 * len(held) > 50
    assert got[901].score == got[902].score == got[900].score
    assert quality.classify(docs_of(spark, []), labels).count() == 0
    assert {r.score for r in quality.classify(docs_of(spark, rows), labels.limit(0)).collect()} == {0.5}


def test_language(spark):
    rng = random.Random(7)
    parts = {"en": "th er on an re he in ed nd ha".split(), "de": "sch ung keit ein der ich ä ö ver".split(), "fr": "eau oi é è ion que eux ou".split()}
    make = lambda k: " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randrange(1, 4))) for _ in range(40))
    rows = [(i, make(k), k) for i in range(300) for k in [("en", "de", "fr")[i % 3]]] + [(900, None, "en"), (901, "", None), (902, "123 ... 4", "de"), (903, "ein schein", None), (904, "漢字", None)]
    out = langid.identify(docs_of(spark, rows)).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[904].lang_pred != "und"
    held = [i for i in range(300) if got[i].held_out]
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == got[i].held_out for i in range(300))
    assert sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.97 * len(held) > 40
    assert langid.identify(docs_of(spark, [])).count() == 0
    assert {r.lang_pred for r in langid.identify(docs_of(spark, [(1, "abc"), (2, "d")])).collect()} == {"und"}


def test_langid_model_is_sparse_and_calibrated():
    import numpy as np

    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 400)
    rows = []
    for c in y:
        at = np.unique(np.concatenate([rng.integers(0, 300, 20), rng.choice(np.arange(300 + 20 * c, 320 + 20 * c), 5)]))
        rows.append((at, np.full(len(at), len(at) ** -0.5)))
    w, b = langid.ftrl(rows[:300], y[:300], 400, 3)
    logits = np.array([v @ w[at] + b for at, v in rows[300:]])
    assert (logits.argmax(1) == y[300:]).mean() > 0.95 and (w == 0).mean() > 0.1
    noisy = np.where(rng.random(100) < 0.2, (y[300:] + 1) % 3, y[300:])
    assert abs(langid.calibrate(logits * 7, noisy) / langid.calibrate(logits, noisy) - 7) < 0.2
