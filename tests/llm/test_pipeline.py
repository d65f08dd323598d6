import random

import brute
import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small corpus with every case a stage decides on."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [(i, text(20)) for i in range(5)]
    docs, labels = [], []
    for i in range(240):
        kind = i % 8
        t = text(rng.randrange(20, 80))
        if kind == 0:
            t = " | ".join(x.upper() + "!!" for x in t.split())
        elif kind == 1 and i > 8:
            t = docs[i - 4][1] if docs[i - 4][1][0] != "|" else t
        elif kind == 2:
            t = f"{t} {items[i % 5][1]} {text(10)}"
        docs.append((i, t, "en", f"s{rng.choice([0, 0, 0, 1, 2])}", len(t)))
        labels.append((i, int(kind != 0), 0))
    docs.append((500, None, None, None, None))
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").selectExpr("*", "1 AS score", "'x' AS size", "2 AS coverage", "3 AS kind").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, docs, items


def test_stages_against_plain_versions(spark, tables):
    root, docs, items = tables
    now = spark.read.parquet(f"{root}/documents.parquet")
    columns = now.columns
    results = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, root)
        path = f"{root}/stage{i}"
        out.write.parquet(path)
        now = spark.read.parquet(path)
        results.append([tuple(r) for r in now.collect()])
        if i < 4:
            assert now.columns == columns
    first, second, third, fourth, last = results
    # quality: what was written in capitals goes, the rest stays
    low = {d[0] for d in docs if d[1] and "!!" in d[1]}
    assert {r[0] for r in first} == {d[0] for d in docs} - low
    # near duplicates, by brute force over what was kept
    comp = brute.near([(r[0], r[1]) for r in first], 5)
    assert {r[0] for r in second} == {d for d, (_, c) in comp.items() if c == d}
    # decontamination
    assert {r[0] for r in third} == {r[0] for r in second if not any(t in (r[1] or "") for _, t in items)}
    # mixing: targets by brute force, near by a document
    want = brute.mix([(r[0], r[1], r[3]) for r in third])
    for s, t in want.items():
        taken = sum(len((r[1] or "").split()) for r in fourth if r[3] == s)
        assert abs(taken - t) <= 120
    assert {r[0] for r in fourth} <= {r[0] for r in third}
    # sharding: all rows, evenly
    assert sorted(map(str, (r[:9] for r in last))) == sorted(map(str, fourth))
    counts = [sum(r[9] == s for r in last) for s in range(24)]
    assert max(counts) - min(counts) <= 1


def test_run(spark, tables):
    from pathlib import Path

    shared = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(shared.iterdir())
    out = corpus_pipeline.run(spark, tables[0])
    # of all that stages wrote, only what the last one reads is left
    assert {p.name.split("-")[0] for p in set(shared.iterdir()) - before} == {"stage3", "rows"}
    assert out.count() > 100 and {"shard", "slot"} <= set(out.columns)
