import zlib

from lodestone.llm import sharding

TEXTS = [None, "", "ä", "日本" * 9, "x" * 5000]


def docs(spark, n=400):
    rows = [(i, TEXTS[i % 5] if i % 5 < 4 or i % 35 == 4 else "y" * (i % 97), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, shard long")


def test_law_of_bytes(spark):
    rows, df = docs(spark)
    placed, slot_map = sharding.shard(df, 4, n_slots=256)
    got = placed.collect()
    assert sorted(r.doc_id for r in got) == [i for i, *_ in rows]
    texts = {i: (t or "").encode() for i, t, _ in rows}
    assert all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in got)
    load = {s: sum(r.size for r in got if r.shard == s) for s in range(4)}
    assert max(load.values()) - min(load.values()) <= max(len(t) for t in texts.values()) + 1
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.version for r in slot_map.collect()} == {1}


def test_rebalancing_edits_the_map(spark):
    _, df = docs(spark, 2000)
    _, first = sharding.shard(df, 4, n_slots=256)
    old = {r.virtual_slot: r for r in first.collect()}
    for n in (5, 3):
        new = {r.virtual_slot: r for r in sharding.rebalance(first, n).collect()}
        assert new.keys() == old.keys() and {r.version for r in new.values()} == {2}
        load = [sum(r.bytes for r in new.values() if r.shard == s) for s in range(n)]
        assert max(load) < 1.2 * sum(load) / n
        moved = sum(r.bytes for k, r in new.items() if r.shard != old[k].shard)
        assert moved < 0.45 * sum(load)


def test_defined_cases(spark):
    empty, _ = sharding.shard(spark.createDataFrame([], "doc_id long, text string"), 16)
    assert empty.collect() == []
    same, _ = sharding.shard(spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id long, text string"), 2, n_slots=8)
    got = same.collect()
    assert len(got) == 3 and len({(r.shard, r.slot) for r in got}) == 3
