"""The ring against a row-by-row walk, the laws of balance, and the movement when a shard is added."""

import zlib
from collections import Counter

import pytest

from casebook.llm import sharding
from tests.llm.helpers import clash, docs


def walk(places, shards, virtual_nodes, ring_places, room):
    """Rows one at a time: homes in ring order, then the rest clockwise from their home until a shard has room."""
    nodes = sharding.ring(shards, virtual_nodes, ring_places)
    at = sorted(nodes)
    loads, homeless = Counter(), Counter()
    for place in sorted(places):
        home = next((p for p in at if p >= place), at[0])
        if loads[nodes[home]] < room[nodes[home]]:
            loads[nodes[home]] += 1
        else:
            homeless[home] += 1
    waiting = 0
    for i in range(2 * len(at)):
        place = at[i % len(at)]
        shard = nodes[place]
        taken = min(waiting, room[shard] - loads[shard])
        loads[shard] += taken
        waiting += (homeless[place] if i < len(at) else 0) - taken
    assert not waiting
    return loads


@pytest.mark.parametrize("rows,slack", [(0, 0), (1, 0), (15, 0), (16, 0), (1000, 0), (4321, 0.05), (4321, 0.5)])
def test_plan(rows, slack):
    import random

    rng = random.Random(rows)
    places = [min(rng.randrange(256), rng.randrange(256)) for _ in range(rows)]
    steps = sharding.plan(Counter(places), 16, 4, 256, slack)
    got = Counter()
    for _, low, high, shard, _ in steps:
        got[shard] += high - low
    room = sharding.capacities(rows, 16, slack)
    assert sum(got.values()) == rows and all(got[s] <= room[s] for s in range(16))
    assert got == walk(places, 16, 4, 256, room)
    for place, n in Counter(places).items():
        ranks = sorted(r for p, low, high, _, _ in steps if p == place for r in range(low, high))
        assert ranks == list(range(n))


def test_assignment(spark):
    texts = [None, "", "é", "copy", "copy", "x" * 100_000, *(f"text {i}" for i in range(700))]
    frame = clash(docs(spark, [*texts, "null id", "null id"], [*range(len(texts) - 1), 5, None, None]), "shard", "slot", "place", "size", "point", "at")
    got = sharding.by_rows(frame).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == len(texts) + 2 and set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    by_id = {r.doc_id: r for r in got}
    for i, t in enumerate(texts[:5]):
        raw = (t or "").encode()
        assert (by_id[i].size, by_id[i].text_crc32, by_id[i].law, by_id[i].grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    again = {(r.doc_id, r.text_crc32): r.shard for r in sharding.by_rows(frame.repartition(7)).collect() if r.doc_id != 5}
    assert all(again[(r.doc_id, r.text_crc32)] == r.shard for r in got if r.doc_id not in (5, None))


def test_slack_limits_movement(spark):
    frame = docs(spark, [f"t{i}" for i in range(4000)])
    few = {r.doc_id: r.shard for r in sharding.assign(frame, 16, slack=0.25).collect()}
    more = {r.doc_id: r.shard for r in sharding.assign(frame, 17, slack=0.25).collect()}
    assert max(Counter(few.values()).values()) <= -(-int(4000 * 1.25) // 16)
    assert sum(few[d] != more[d] for d in few) < 0.25 * len(few)


def test_fewer_rows_than_shards(spark):
    frame = docs(spark, ["a", "b", "c"])
    assert sorted(r.slot for r in sharding.by_rows(frame).collect()) == [0, 0, 0]
    assert sharding.by_rows(frame.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = sharding.by_rows(docs(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
