import zlib
from collections import defaultdict

from llm.fixtures import awkward, awkward_rows, prose
from pagesearch.llm import sharding


def test_longest_first_equals_a_plain_search():
    jobs = {i: (i * 7919) % 101 + 1 for i in range(60)} | {1000: 900}
    loads, want = [0] * 5, {}
    for job in sorted(jobs, key=lambda j: (-jobs[j], j)):
        shard = min(range(5), key=lambda s: (loads[s], s))
        loads[shard] += jobs[job]
        want[job] = shard
    assert sharding.longest_first(jobs, 5) == want


def test_groups_stay_together_and_sizes_are_near(spark):
    import random
    rng = random.Random(4)
    given = awkward_rows() + [(2000 + i, "copied text " * 20, "en", "s", 0) for i in range(300)]
    given += [(3000 + i, prose(rng, rng.randint(1, 90)), "en", "s", 0) for i in range(900)]
    out = sharding.op5_lpt_sharding(awkward(spark, given)).collect()
    assert sorted((r.size, r.text_crc32) for r in out) == sorted(
        (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in given)
    shards, loads, slots = defaultdict(set), defaultdict(int), defaultdict(list)
    for r in out:
        shards[r.text_crc32].add(r.shard)
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # one group of copies is as large as a shard; the others share the rest evenly
    rest = sorted(loads.values())[:-1]
    assert len(loads) == 8 and rest[-1] - rest[0] <= 0.05 * rest[-1]
    assert sharding.op5_lpt_sharding(awkward(spark).limit(0)).count() == 0
