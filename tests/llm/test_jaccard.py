import random
import re

import numpy as np
import pytest
from llm.fixtures import awkward, awkward_rows, prose
from pagesearch.llm import jaccard
from pagesearch.llm.components import components
from pagesearch.llm.count_tree import linked


def shingles(text, width=3):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + width]) for i in range(max(len(words) - width + 1, min(len(words), 1)))}


def brute(rows, percent=90, width=3):
    """Sorted (doc_id, n_shingles, component_id) of all rows."""
    sets = [shingles(text, width) for _, text, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(find(i), []).append(row[0])
    least = {k: min((d for d in ids if d is not None), default=None) for k, ids in groups.items()}
    return sorted(((d, len(s), least[find(i)]) for i, ((d, *_), s) in enumerate(zip(rows, sets))), key=repr)


def near_copies(seed, families=12, members=14):
    """Families with small edits at random places, so that similarities lie on both sides of 0.9."""
    rng, rows = random.Random(seed), []
    for family in range(families):
        words = prose(rng, rng.choice([9, 11, 12, 20, 33, 60, 150, 400])).split()
        for _ in range(members):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = f"edit{rng.randint(0, 10**6)}"
            if rng.random() < 0.3:
                copy.insert(rng.randrange(len(copy)), "inserted")
            rows.append((len(rows) + 1, " ".join(copy), "en", "s", 0))
    rng.shuffle(rows)
    return rows


def collected(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize("percent", [90, 80])
def test_components_equal_brute_force(spark, percent):
    rows = awkward_rows() + [(1000 + d, *rest) for d, *rest in near_copies(percent)]
    assert collected(jaccard.jaccard_components(awkward(spark, rows), percent)) == brute(rows, percent)


def test_clusters_beyond_one_task_give_the_same(spark):
    rows = near_copies(3, families=4, members=60)
    want = brute(rows)
    assert collected(jaccard.jaccard_components(awkward(spark, rows), block=2_000)) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_shingles_of_five_words_at_eighty_percent(spark, seed):
    rng = random.Random(seed)
    passage = prose(rng, 70)
    rows = [(d, f"{text} {passage}" if d % 3 else text, *rest) for d, text, *rest in near_copies(seed, 14, 20)]
    docs = awkward(spark, rows + awkward_rows())
    got = jaccard.labelled(docs, 80, width=5).select("doc_id", "n_shingles", "component_id")
    assert collected(got) == brute(rows + awkward_rows(), 80, 5)


def test_one_id_under_many_texts(spark):
    """Rows are told apart by id and text, so a repeated or null id is like any other."""
    rows = [(7 if d % 2 else None, *rest) for d, *rest in near_copies(9, 4, 10)]
    assert collected(jaccard.jaccard_components(awkward(spark, rows))) == brute(rows)


def test_one_of_each_component_stays(spark):
    rows = awkward_rows() + [(1000 + d, *rest) for d, *rest in near_copies(4, 5, 8)]
    docs = awkward(spark, rows)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    empty = sum(not shingles(text) for _, text, *_ in rows)
    groups = {(c, n > 0) for _, n, c in brute(rows) if n}
    # the two texts under id 15 are components of their own, and so is the row without an id
    assert kept.count() == empty + len(groups) + 1
    assert jaccard.one_of_each(docs.limit(0)).count() == jaccard.jaccard_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("percent, width, range_shingles, most_common", [
    (90, 3, 10_000, 0), (80, 5, 700, 0), (80, 5, 700, 40), (75, 2, 100_000, 1_000_000)])
def test_linking_sets_always_share_a_key(spark, percent, width, range_shingles, most_common):
    """Passages that many texts share, near copies and exact copies, and any list of common shingles."""
    rng = random.Random(percent + most_common)
    passage = prose(rng, 60)
    rows = [(d, text if rng.random() < 0.6 else f"{text} {passage}") for d, text, *_ in near_copies(percent)]
    rows += [(5000 + d, text) for d, text in rows[::3]] + [(9000, ""), (9001, None)]
    words = jaccard.Words()
    sets = {jaccard._set_id(s)[0]: s for s in (jaccard.shingle_set(text, words, width) for _, text in rows) if len(s)}
    seen, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    common = np.sort(seen[np.argsort(-counts, kind="stable")[:most_common]])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keys, given = {}, set()
    for a, key in jaccard.routing_keys(docs, common, int(counts.sum()), percent, width, range_shingles).collect():
        assert (a, key) not in given
        given.add((a, key))
        keys.setdefault(a, set()).add(key)
    linked_pairs, held = 0, list(sets.items())
    for i, (a, x) in enumerate(held):
        for b, y in held[:i]:
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                linked_pairs += 1
                assert keys.get(a, set()) & keys.get(b, set())
    assert linked_pairs > 20
    if not most_common:     # keys are what other sets have too, and a prefix of the set at most
        assert all(len(k) <= jaccard.prefix_size(len(sets[a]), percent) for a, k in keys.items())
        assert sum(map(len, keys.values())) < 0.5 * sum(map(len, sets.values()))


@pytest.mark.parametrize("percent", [90, 75])
def test_linking_sets_always_share_a_group(percent):
    rng = np.random.default_rng(percent)
    low, apart = jaccard.bands(percent, 4096)
    for _ in range(3000):
        n = int(rng.integers(1, 400))
        base = rng.integers(0, 2**63, size=n, dtype=np.uint64)
        drop = int(rng.integers(0, max(1, n // 8) + 1))
        other = np.concatenate([base[drop:], rng.integers(0, 2**63, size=int(rng.integers(0, max(1, n // 8) + 1)), dtype=np.uint64)])
        a, b = np.unique(base), np.unique(other)
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= percent * (len(a) + len(b) - common) and not np.array_equal(a, b):
            keys = [set(np.concatenate(jaccard.group_keys(s, percent, low, apart) or [np.empty(0)]).tolist()) for s in (a, b)]
            assert keys[0] & keys[1]


def test_lopsided_groups_still_meet():
    low, apart = jaccard.bands(90, 4096)
    a = np.arange(1, 41, dtype=np.uint64)       # all high bits zero: every shingle in the first group
    b = np.arange(1, 43, dtype=np.uint64)
    keys = [set(np.concatenate(jaccard.group_keys(s, 90, low, apart)).tolist()) for s in (a, b)]
    assert keys[0] & keys[1]


def test_places_grow_with_the_hash_and_fill_the_ranges():
    rng = np.random.default_rng(5)
    hashes = np.sort(rng.integers(0, 1 << 64, 50_000, dtype=np.uint64))
    for ranges in (1, 7, 1000):
        part, place = jaccard._places(hashes, ranges)
        whole = part.astype(object) * (1 << 32) + place
        assert (np.diff(part) >= 0).all() and all(x <= y for x, y in zip(whole, whole[1:]))
        assert [int(h) * ranges >> 64 for h in hashes[::97]] == part[::97].tolist()
        assert [(int(h) * ranges >> 32) % (1 << 32) for h in hashes[::97]] == place[::97].tolist()


def test_tree_equals_all_pairs():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(40):
        base = np.unique(rng.integers(0, 2**60, size=int(rng.integers(3, 120)), dtype=np.uint64))
        for _ in range(6):
            keep = base[rng.random(len(base)) > 0.04]
            sets.append(np.unique(np.append(keep, rng.integers(0, 2**60, size=2, dtype=np.uint64))))
    roots = linked(sets, 90)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 90 * (len(sets[i]) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    assert len({(find(i), int(roots[i])) for i in range(len(sets))}) == len(set(roots.tolist())) == len({find(i) for i in range(len(sets))})


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(1, 60)] + [(500, 500 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert len({got[i] for i in range(1, 61)}) == 1 and len({got[500 + i] for i in range(50)}) == 1
    assert len(got) == 110 and components(spark.createDataFrame([], "u long, v long")).count() == 0
