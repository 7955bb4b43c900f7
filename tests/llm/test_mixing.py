import pytest

from lodestone.llm import mixing


def test_one_period_meets_every_deadline():
    for shares in ({"a": 1}, {"a": 3, "b": 2, "c": 2}, {"a": 500, "b": 1, "c": 499}, {f"s{i}": 7 * i + 1 for i in range(20)}, {None: 2, "": 3}):
        period = sum(shares.values())
        table = mixing.one_period(shares)
        assert len(table) == period
        done = dict.fromkeys(shares, 0)
        for slot, (s, i, release, deadline) in enumerate(table):
            done[s] += 1
            assert done[s] == i and release <= slot < deadline
            assert (release, deadline) == ((i - 1) * period // shares[s], -(-i * period // shares[s]))
            assert all(abs(done[x] - q * (slot + 1) / period) < 1 for x, q in shares.items())
        assert done == shares


def rows(spark, counts, extra=""):
    data = [(k, s, "c") for k, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    return spark.createDataFrame(data, "doc_id long, source string, slot string")


@pytest.mark.parametrize("counts", [{"a": 700, "b": 100, "c": 33, None: 5}, {"only": 20}])
def test_rows_against_a_slot_by_slot_replay(spark, counts):
    got = mixing.mix(rows(spark, counts), block=4, period=50).collect()
    assert sorted(r.row.doc_id for r in got) == list(range(sum(counts.values())))
    assert len({r.position for r in got}) == len(got)
    blocks = sorted({(r.slot, r.source, r.block, r.phase, r.release, r.deadline, r.weight) for r in got})
    assert [b[0] for b in blocks] == list(range(len(blocks)))
    assert all(b[4] <= b[0] < b[5] for b in blocks)
    start = dict.fromkeys((b[3] for b in blocks), None)
    for phase in start:
        own = [b for b in blocks if b[3] == phase]
        for s in {b[1] for b in own}:
            w = next(b[6] for b in own if b[1] == s)
            assert all(abs(sum(b[1] == s for b in own[: k + 1]) - w * (k + 1)) < 1 for k in range(len(own)))
    left = {s: -(-n // 4) for s, n in counts.items()}
    for b in blocks:
        assert b[2] == -(-counts[b[1]] // 4) - left[b[1]]
        left[b[1]] -= 1
    assert not any(left.values())


def test_weights_and_order(spark):
    df = rows(spark, {"a": 300, "b": 300})
    got = sorted(mixing.mix(df, {"a": 3, "b": 1}, block=1, period=4).collect(), key=lambda r: r.position)
    assert sum(r.source == "a" for r in got[:200]) == 150
    ordered = mixing.in_order(df, weights={"a": 3, "b": 1}, block=1, period=4)
    assert ordered.columns == df.columns
    assert [r.doc_id for r in ordered.collect()] == [r.row.doc_id for r in got]


def test_defined_cases(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string")).collect() == []
    same = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, source string")
    assert sorted(r.position // mixing.BLOCK for r in mixing.mix(same).collect()) == [0, 0, 1]
    with pytest.raises(KeyError):
        mixing.mix(same, {"a": 1.0})


def test_many_sources_of_few_blocks():
    blocks = {f"s{i}": 1 + i % 3 for i in range(300)}
    spans, slots = mixing.phases(blocks, mixing.parts(mixing.tempered(blocks)))
    assert len(slots) <= sum(blocks.values()) == sum(n for _, _, _, n, *_ in spans)


def test_map_columns_and_equal_ids(spark):
    rows = [(1, "a", {"k": i}) for i in range(5)] + [(2, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, row map<string,int>")
    first, again = (sorted((r.position, str(r.row)) for r in mixing.mix(x).collect()) for x in (df, df.orderBy("row.k").repartition(3)))
    assert first == again and len({p for p, _ in first}) == 6
