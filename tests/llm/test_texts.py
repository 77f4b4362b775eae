"""Toxicity, fingerprints and token counts."""

import hashlib
import random
import zlib

import numpy as np
from llm.fixtures import awkward, awkward_rows, prose
from pagesearch.llm import edit_embedding as ee
from pagesearch.llm import fingerprints, token_counts, toxicity
from pagesearch.llm.edit_distance import edit_distance, gram_counts, may_be_near, within
from pagesearch.llm.tokens import load
from pagesearch.session import FREED, freed_shuffles, materialize
from pyspark.sql import functions as F


def test_toxicity_is_learnt_and_held_out(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = prose(rng, rng.randint(10, 120)).split()
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vermin", "Rubbish,", "fool."]))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (5, None)]
    docs = awkward(spark, rows + [(10_000, "", "en", "s", 0), (10_001, None, None, None, None), (None, "fool", None, None, None)])
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.op6_toxicity(docs, marks).collect()
    assert len(out) == len(rows) + 3
    truth = dict(labels[:900])
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    bad, good = ([r.score for r in held if truth[r.doc_id] == label] for label in (1, 0))
    assert np.mean([b > g for b in bad for g in good]) > 0.98
    # labels of held-out rows change nothing
    flipped = spark.createDataFrame([(d, 1 - t) if d is not None and t is not None and zlib.crc32(str(d).encode()) % 5 == 0
                                     else (d, t) for d, t in labels], "doc_id long, toxic int")
    assert sorted(map(repr, out)) == sorted(map(repr, toxicity.op6_toxicity(docs, flipped).collect()))
    empty = toxicity.op6_toxicity(docs, marks.limit(0)).collect()
    assert {r.score for r in empty} == {0.5} and toxicity.op6_toxicity(docs.limit(0), marks).count() == 0


def walk(text):
    """One text, one step at a time."""
    codes, at, out = ee.char_codes(text), 0, []
    kept = set(ee.kept_steps(len(text)).tolist())
    for step in range(2 * len(text)):
        char = int(codes[at]) if at < len(codes) else 0
        if step in kept:
            out.append(char)
        at += int(ee._MOVES[step % ee.PERIOD, char])
    return out


def test_walks_side_by_side_equal_single_walks():
    rng = random.Random(7)
    texts = ["", "a", "é😀", *[prose(rng, rng.randint(1, 300)) for _ in range(20)], prose(rng, 2_000)]
    assert [m.tolist() for m in ee.fingerprints(texts)] == [walk(t) for t in texts]


def test_likeness_follows_edits():
    rng = random.Random(8)
    for n in (60, 128, 129, 700, 6_000):
        text = prose(rng, n)
        edited = text[:len(text) // 2] + "inserted " + text[len(text) // 2:]
        other = prose(rng, n)
        a, b, c = ee.fingerprints([text, edited, other])
        assert ee.likeness(len(text), a, len(text), a) == 1.0
        assert ee.likeness(len(text), a, len(edited), b) > 0.7 > 0.3 > ee.likeness(len(text), a, len(other), c)


def test_edited_texts_follow_the_next_document(spark):
    given = [row for row in awkward_rows() if row[0] != 15 and row[0] is not None]
    given = list({row[0]: row for row in given}.values())
    for buckets in (2_000, 4):
        fingerprints.ROWS_PER_BUCKET = buckets
        out = {r.doc_id: r for r in fingerprints.op7_edit_fingerprints(awkward(spark, given)).collect()}
        order = sorted((d, t or "") for d, t, *_ in given)
        assert len(out) == len(order)
        for i, (doc_id, text) in enumerate(order):
            following = order[(i + 1) % len(order)][1]
            edited = text[:len(text) - len(text) // 4] + following[:len(text) // 4]
            row = out[doc_id]
            assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            marks = ee.fingerprints([text, edited, following])
            assert row.fingerprint == ee.written(len(text), marks[0]) and row.edited_fingerprint == ee.written(len(edited), marks[1])
            assert row.near_next == ee.likeness(len(text), marks[0], len(following), marks[2])
    fingerprints.ROWS_PER_BUCKET = 2_000
    assert fingerprints.op7_edit_fingerprints(awkward(spark)).count() == len(awkward_rows())
    assert fingerprints.op7_edit_fingerprints(awkward(spark).limit(0)).count() == 0
    one = fingerprints.op7_edit_fingerprints(awkward(spark, [(1, "alone here", "en", "s", 10)])).first()
    assert one.near_next == 1.0


def test_near_texts_by_edits_are_one_class(spark):
    rng = random.Random(9)
    base = [prose(rng, n) for n in (80, 200, 900)]
    given = [(10 * i + k, t if k == 0 else t.replace(" ", "  ", 1) if k == 1 else t[:-3] + "end", "en", "s", 0)
             for i, t in enumerate(base) for k in range(3)] + [(90, prose(rng, 300), "en", "s", 0), (91, None, "en", "s", 0)]
    out = {r.doc_id: r.component_id for r in fingerprints.edit_components(awkward(spark, given)).collect()}
    assert out == {d: d // 10 * 10 if d < 90 else d for d, *_ in given}


def plain_distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        before = row
    return before[-1]


def test_edit_distance_equals_the_plain_table():
    rng = random.Random(11)
    for _ in range(1_500):
        a, b = ("".join(rng.choice("ab\x00é😀") for _ in range(rng.randint(0, 16))) for _ in range(2))
        most, want = rng.randint(0, 17), plain_distance(a, b)
        assert edit_distance(a, b, most) == (want if want <= most else -1)
    text = prose(rng, 300)
    assert edit_distance(text, text[:500] + "x" + text[500:-1], 10) == 2


def test_edit_classes_find_the_near_texts_and_no_others(spark):
    rng = random.Random(12)
    opening = prose(rng, 12)    # all begin alike, so that bands of the opening are crowded with unlike texts
    given, near = [], []
    for i in range(60):
        words = (opening + " " + prose(rng, rng.randint(30, 250))).split()
        changed = list(words)
        for at in rng.sample(range(len(words)), len(words) // 25):
            changed[at] = rng.choice(["alpha", "beta", "gamma"])
        given += [(2 * i, " ".join(words), "en", "s", 0), (2 * i + 1, " ".join(changed), "en", "s", 0)]
    given += [(1_000, given[0][1], "en", "s", 0), (1_001, "", "en", "s", 0), (1_002, "", "en", "s", 0), (None, None, "en", "s", 0)]
    rows = fingerprints.op7_edit_fingerprints(awkward(spark, given)).collect()
    out = {r.doc_id: r for r in rows}
    texts = {d: t for d, t, *_ in given if t}
    ids = [d for d in texts if d < 1_000]
    for i, d in enumerate(ids):
        for other in ids[i + 1:]:
            if edit_distance(texts[d], texts[other], int(max(len(texts[d]), len(texts[other])) * fingerprints.EDITS)) >= 0:
                near.append((d, other))
    assert near == [(d, d + 1) for d in range(0, 120, 2)]
    found = [pair for pair in near if out[pair[0]].class_id == out[pair[1]].class_id == pair[0]]
    assert len(found) >= 0.9 * len(near)
    assert all(out[d].class_id in (d, d - d % 2) for d in ids) and {out[d].n_links for d in ids} <= {0, 1}
    assert out[1_000].class_id == 0 and out[1_000].n_links == out[0].n_links
    assert [(out[d].class_id, out[d].n_links) for d in (1_001, 1_002, None)] == [(1_001, 0), (1_002, 0), (None, 0)]


def test_no_pair_of_a_crowded_band_is_dropped(spark, monkeypatch):
    rng = random.Random(13)
    opening, given = prose(rng, 20), []
    for i in range(40):     # unlike texts that begin alike, each with a far copy: the opening is often all that bands share
        words = (opening + " " + prose(rng, 70)).split()
        changed = list(words)
        for at in rng.sample(range(20, len(words)), 7):
            changed[at] = changed[at][:1] + "q" + changed[at][2:]
        given += [(2 * i, " ".join(words), "en", "s", 0), (2 * i + 1, " ".join(changed), "en", "s", 0)]
    texts = {d: t for d, t, *_ in given}
    marks = dict(zip(texts, ee.fingerprints(list(texts.values())), strict=True))
    bands = {d: set(fingerprints.band_keys(len(t), marks[d])) for d, t in texts.items()}
    want = [(a, b) for a in texts for b in texts if a < b and bands[a] & bands[b]
            and ee.likeness(len(texts[a]), marks[a], len(texts[b]), marks[b]) >= fingerprints.LIKENESS
            and edit_distance(texts[a], texts[b], int(max(len(texts[a]), len(texts[b])) * fingerprints.EDITS)) >= 0]
    assert len(want) > 30 and max(sum(band in own for own in bands.values()) for one in bands.values() for band in one) > 50
    for rows in (fingerprints.BLOCK_ROWS, 10):
        monkeypatch.setattr(fingerprints, "BLOCK_ROWS", rows)
        out = {r.doc_id: r.component_id for r in fingerprints.edit_components(awkward(spark, given)).collect()}
        assert [pair for pair in want if out[pair[0]] != out[pair[1]]] == []
        assert all(out[d] in (d, d - d % 2) for d in texts)


def test_quick_near_tests_agree_with_the_edit_distance():
    rng = random.Random(14)
    for _ in range(1_500):
        a = [rng.choice("abcdé😀") for _ in range(rng.randint(1, 70))]
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            at = rng.randint(0, len(b))
            b[at:at + rng.randint(0, 2)] = rng.choice(["", "x", "ab"])
        a, b, most = "".join(a), "".join(b[20:] + b[:20] if rng.random() < 0.2 else b), rng.randint(0, 20)
        near = edit_distance(a, b, most) >= 0
        assert within(a, b, most) == near
        longer = np.array([max(len(a), len(b))])
        assert may_be_near(gram_counts(a, 5), gram_counts(b, 5)[None], longer, np.array([most]))[0] or not near


def test_shuffle_files_go_with_their_action(spark):
    before = spark.conf.get(FREED)
    with freed_shuffles(spark):
        assert spark.conf.get(FREED) == "true"
    made = materialize(spark.range(100).repartition(5).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert spark.conf.get(FREED) == before and {r["count"] for r in made.collect()} == {14, 15}


def test_token_counts_equal_the_library(spark):
    rng = random.Random(10)
    parts = ["a", "é", "word", " ", "  ", "\n", "\t", "\xa0", "'ll", "'s", "1", "23", ",", "!?", "<|endoftext|>", "<|endo", "ß", "中", "😀",
             "\x1c", "\x85", ".", " lantern"]
    counter, tokenizer = token_counts.Counter(), load(token_counts.TOKENIZER)
    for _ in range(1_500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        want = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert counter.short(text) == want and counter.long(text, 20, 4) == want
    given = awkward_rows() + [(500, "x" * 70_000 + " y" * 40_000 + " " * 70_000 + "z", "en", "s", 0)]
    out = token_counts.count_tokens(awkward(spark, given), chunk=2_048).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in out) == sorted(
        (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for _, t, *_ in given)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in out)
    assert token_counts.op8_token_counts(awkward(spark).limit(0)).count() == 0
