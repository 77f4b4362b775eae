import random
import zlib

import numpy as np
import pytest
from llm.fixtures import awkward, awkward_rows
from pagesearch.llm import packing
from pagesearch.llm.bins import plan
from pagesearch.llm.tokens import load


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_item_once(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 2049, 500), rng.integers(1, 60, 900), np.clip(rng.lognormal(6, 1, 30_000), 1, 2048).astype(int),
               np.full(7, 1025), np.array([2048, 1, 1]), rng.integers(500, 700, 5_000)][seed]
    histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    runs = plan(histogram, 2048)
    ranges = {}
    for run in runs:
        offset = 0
        for length, rank, at in run.items:
            assert at == offset
            offset += length
            ranges.setdefault(length, []).append((rank, run.count))
        assert offset == run.used <= 2048 and run.count > 0
    for length, count in histogram.items():
        at = 0
        for rank, n in sorted(ranges[length]):
            assert rank == at
            at += n
        assert at == count
    # no worse than first fit on the same items, longest first
    bins = []
    for length in sorted(map(int, lengths[:3_000] if len(lengths) > 3_000 else lengths), reverse=True):
        for i, room in enumerate(bins):
            if room >= length:
                bins[i] -= length
                break
        else:
            bins.append(2048 - length)
    if len(lengths) <= 3_000:
        assert sum(r.count for r in runs) <= len(bins)
    assert sum(r.count for r in runs) >= -(-int(lengths.sum()) // 2048)


def test_empty_plan():
    assert plan({}, 2048) == []


def test_pieces_are_the_library_ids_and_sequences_have_no_gaps(spark):
    rng = random.Random(1)
    odd = ["İstanbul ΣΑΣ naïve é don't a<|endoftext|>b x\x1cy z\xa0w ''s 12ab \x85 . ,, a,. ß² ªº µ é",
           "".join(rng.choice(["a", "É", " ", "'ll", ",", ".", "<|startoftext|>", "1", "ǆ", "　", "😀"]) for _ in range(3_000))]
    given = awkward_rows() + [(1000 + i, t, "en", "s", 0) for i, t in enumerate(odd)]
    out = packing.pack(awkward(spark, given), capacity=256).toPandas()
    tokenizer = load(packing.TOKENIZER)
    want = []
    for _, text, *_ in given:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for start in range(0, len(ids), 256):
            piece = np.array(ids[start:start + 256], dtype="<u4").tobytes()
            want.append((start // 256, start, len(piece) // 4, zlib.crc32(piece)))
    assert sorted(zip(out.piece, out.start, out.length, out.ids_crc32)) == sorted(want)
    for _, sequence in out.groupby("sequence_id"):
        sequence = sequence.sort_values("offset")
        assert (sequence.offset.to_numpy() == np.r_[0, np.cumsum(sequence.length)[:-1]]).all()
        assert sequence.length.sum() <= 256
    assert packing.pack(awkward(spark).limit(0)).count() == 0
