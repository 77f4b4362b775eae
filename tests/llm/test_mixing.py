import random
from collections import defaultdict
from fractions import Fraction

from llm.fixtures import awkward, awkward_rows, prose
from pagesearch.llm import mixing


def test_seats_are_the_highest_quotients(spark):
    rng = random.Random(1)
    parties, houses = [], []
    for house in range(6):
        n = rng.choice([1, 2, 7, 30])
        parties += [(house, p, float(rng.choice([0, 1, 1, 5, rng.randint(1, 10_000)]))) for p in range(n)]
        houses.append((house, rng.choice([0, 1, 5, 40, 1_000])))
    got = {(r.house, r.party): r.seats for r in mixing.sainte_lague(
        spark.createDataFrame(parties, "house int, party int, weight double"),
        spark.createDataFrame(houses, "house int, seats long")).collect()}
    for house, seats in houses:
        live = [(p, w) for h, p, w in parties if h == house and w > 0]
        won = defaultdict(int)
        for _ in range(seats if live else 0):
            p, _ = max(live, key=lambda x: (Fraction(int(x[1]), 2 * won[x[0]] + 1), -x[0]))
            won[p] += 1
        for p, _ in live:
            assert got[house, p] == won[p]


def brute_targets(sizes):
    """sizes: in order of the sources. Level by level, as the rule says it."""
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    goal, capped = 1.5 * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = goal - sum(2 * sizes[i] for i in capped)
        level = rest / sum(weights[i] for i in free) if free else 0
        over = {i for i in free if level * weights[i] > 2 * sizes[i]}
        if not over:
            return [2 * sizes[i] if i in capped else level * weights[i] for i in range(len(sizes))]
        capped |= over


def test_targets_and_taken_words(spark):
    rng = random.Random(3)
    given = awkward_rows() + [(1000 + i, prose(rng, rng.randint(5, 80)), "en", rng.choice(["big", "big", "É", "z", None, "B"]), 0)
                              for i in range(400)]
    docs = awkward(spark, given)
    first, again = (sorted(map(repr, mixing.op4_source_mixing(d).collect())) for d in (docs, docs.repartition(7)))
    assert first == again and len(first) == len(given)
    rows = mixing.mix(docs, ["doc_id", "source"]).collect()
    sizes = defaultdict(int)
    for _, text, _, source, _ in given:
        sizes[source] += len([w for w in __import__("re").findall("[^\x20\x09-\x0d]+", text or "")])
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = dict(zip(order, brute_targets([sizes[s] for s in order])))
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for source in order:
        assert abs(taken[source] - want[source]) <= 2


def test_mixed_documents_hold_the_taken_words(spark):
    docs = awkward(spark)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken = mixing.op4_source_mixing(docs).groupBy().sum("taken").first()[0]
    texts = [r.text for r in mixed.select("text").collect()]
    assert sum(len(__import__("re").findall("[^\x20\x09-\x0d]+", t)) for t in texts) == taken
    originals = {t or "" for _, t, *_ in awkward_rows()}
    assert all(any(o.startswith(t) for o in originals) for t in texts)
    assert mixing.mixed_documents(docs.limit(0)).count() == mixing.op4_source_mixing(docs.limit(0)).count() == 0


def test_a_tiny_source_of_many_shards_meets_its_target(spark):
    big = [(i, "a " * 100_000, "en", "big", 0) for i in range(35)]
    tiny = [(100 + i, "word", "en", "tiny", 0) for i in range(300)]
    # as many shards as 2 million rows have, and blocks of 5 words
    rows = mixing.mix(awkward(spark, big + tiny).repartition(8), ["doc_id", "source"], rows=2_000_000).collect()
    taken, target = defaultdict(int), {r.source: r.target for r in rows}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert target["tiny"] == 600
    assert all(abs(taken[source] - target[source]) <= 5 for source in target)
