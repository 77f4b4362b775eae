"""Exact self-join of documents by the Jaccard similarity of their word shingles, to components.

1. *Routing.* All sets order their shingles alike: those of one set only, then shared ones from the rarest on, then a
   bounded list of common ones. Two sets of Jaccard t or more share a shingle among the first
   n - ceil(t n) + 1 of both. What only one set has cannot be it, so a set emits only the shared ones of these
   as keys, in most texts none. Which shingles are shared is counted over all sets, packed by ranges of hashes.
   From GROUPED_FROM percent on, equal groups route with less work: linked sets differ in at most d shingles, d known from
   their size class, so with d + 2 hash groups they have the same shingles in some group. The hash of (size class,
   group, its shingles) is the key, and sets joined through keys form a cluster. Groups are large there (9 shingles and more
   at 90 %), so sets that are not alike rarely share a key; at 80 % one common shingle is a whole group.
2. *Search.* The sets under one key are points of an R-tree by their group counts (count_tree). The sum of the
   coordinate minima bounds the overlap; survivors are verified on the sets themselves. Only verified
   links join sets to components. With keys of a prefix, first every set is searched under its most shared key; other keys follow where their sets are not yet
   in one component.

A key with too many sets for one task is cut into blocks. One pivot block meets every block; then only what is
outside the largest component found meets every block. Sets are equal when 128 hash bits are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesearch.llm.common import texts
from pagesearch.llm.components import components
from pagesearch.llm.count_tree import linked
from pagesearch.session import fits_broadcast, materialize

SHINGLE = 3
PERCENT = 90
BLOCK_SHINGLES = 2_000_000  # most shingles of a key's sets that one task holds at a time (16 MB of hashes)
POINT = 32  # a set's count vector takes the memory of so many shingles
BAND_RATIO = 1.25
GROUPED_FROM = 90           # percent from which sets are routed by equal groups
CHUNK_CHARS = 16_000_000    # texts that are shingled together
COMMON_IN_CHUNK = 8         # sets of a chunk with a shingle that make it a candidate for the common ones
MOST_COMMON = 100_000       # common shingles that every task holds (0.8 MB)
RANGE_SHINGLES = 2_000_000  # shingles of one range of hashes, which a task counts at a time

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of mixed values identify sets."""
    x = x ^ (x >> np.uint64(31))
    x = x * _M2
    x = x ^ (x >> np.uint64(29))
    x = x * _M3
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """Word to 64-bit hash, emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, hashes: Words, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``width`` words; of the whole sequence when it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(width, len(h))
    with np.errstate(over="ignore"):
        mixed = np.full(len(h) - k + 1, np.uint64(k) * _M3)
        for place in range(k):
            mixed = _mix(mixed * _M1 + h[place:len(h) - k + 1 + place])
    return np.unique(mixed)


def bands(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower ends of the size classes, and for each the most shingles by which two linked sets can differ.

    A class is as wide as BAND_RATIO, wider than the ratio of linked sizes, so a pair lies in one class
    or in two neighbours. The larger set's class counts.
    """
    lows = [1]
    while lows[-1] <= largest:
        # at least one apart, and never narrower than the ratio that two linked sets may have
        lows.append(max(lows[-1] + 1, int(lows[-1] * max(BAND_RATIO, 100 / percent)) + 1))
    low = np.array(lows, dtype=np.int64)
    return low[:-1], 2 * (low[1:] - 1) * (100 - percent) // (100 + percent)


def group_keys(shingles: np.ndarray, percent: int, low: np.ndarray, apart: np.ndarray) -> list[np.ndarray]:
    """Keys of one set by equal groups, in its own size class and, where a larger set of the next class may link, there."""
    n = len(shingles)
    own = int(np.searchsorted(low, n, side="right")) - 1
    keys = []
    with np.errstate(over="ignore"):
        values = _mix(shingles + _M1)
        for band in (own, own + 1):
            if band >= len(low) or 100 * n < percent * low[band] or apart[band] == 0:
                continue  # no set of that class links with another set
            groups = int(apart[band]) + 2
            # multiply-shift keeps the order of the sorted hashes, so each group is one run
            group = ((shingles >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            salt = np.uint64(band * 2 + 1) * _M3
            present = group[starts]
            keys.append(_mix(np.add.reduceat(values, starts) ^ _mix(present * _M1 + salt)))
            if len(starts) <= apart[band]:  # so lopsided that the equal groups may all be empty
                empty = np.setdiff1d(np.arange(groups, dtype=np.uint64), present)
                keys.append(_mix(_mix(empty * _M2 + salt) ^ _M1))
    return keys


def prefix_size(n: int, percent: int) -> int:
    """How many first shingles of a set of n, in any order that all sets have, meet those of every set it links with."""
    return n - -(-percent * n // 100) + 1


def _set_id(shingles: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return (int(_mix(shingles).sum(dtype=np.uint64).astype(np.int64)),
                int(_mix(shingles ^ _M1).sum(dtype=np.uint64).astype(np.int64)))


def _chunks(batches: Iterator[pd.DataFrame], width: int) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """Rows with a ``text``, and the shingles of each, some millions of characters at a time."""
    hashes = Words()
    for batch in batches:
        chunk = batch["text"].str.len().fillna(0).cumsum() // CHUNK_CHARS
        for _, rows in batch.groupby(chunk, sort=False):
            yield rows, [shingle_set(text, hashes, width) for text in rows["text"]]


def shingle_sets(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, a, b, n_shingles, common, times`` per row: 128-bit id of the set, and its size.

    The first row of a chunk also has the shingles that COMMON_IN_CHUNK sets of the chunk have, and how many.
    """
    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, sets in _chunks(batches, width):
            ids = [_set_id(s) for s in sets]
            seen, counts = np.unique(np.concatenate(list(dict(zip(ids, sets, strict=True)).values())), return_counts=True)
            often = counts >= COMMON_IN_CHUNK
            nothing = np.empty(0, dtype=np.int64)
            yield pd.DataFrame({
                "id": rows["id"], "text_hash": rows["text_hash"], "a": [a for a, _ in ids],
                "b": [b for _, b in ids], "n_shingles": [len(s) for s in sets],
                "common": [seen[often].view(np.int64)] + [nothing] * (len(sets) - 1),
                "times": [counts[often]] + [nothing] * (len(sets) - 1)})

    # the id goes through as text: a column of whole numbers with nulls would become one of doubles
    named = texts(docs).select(F.col("doc_id").cast("string").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    described = named.mapInPandas(
        describe, "id string, text_hash long, a long, b long, n_shingles long, common array<long>, times array<long>")
    return described.select(F.col("id").cast("long").alias("doc_id"), "text_hash", "a", "b", "n_shingles", "common", "times")


def grouped_sets(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, a, b, n_shingles, keys`` per row: 128-bit id of the set, its size and its routing keys."""
    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Words()
        low, apart = bands(percent, 1 << 16)
        for batch in batches:
            for part in range(0, len(batch), 500):
                rows = []
                piece = batch.iloc[part:part + 500]
                for doc_id, text_hash, text in zip(piece["id"], piece["text_hash"], piece["text"], strict=True):
                    shingles = shingle_set(text, hashes, width)
                    while len(shingles) * 2 >= low[-1]:
                        low, apart = bands(percent, int(low[-1]) * 4)
                    keys = group_keys(shingles, percent, low, apart) if len(shingles) else []
                    a, b = _set_id(shingles)
                    rows.append((doc_id, text_hash, a, b, len(shingles),
                                 np.concatenate(keys).view(np.int64) if keys else np.empty(0, dtype=np.int64)))
                yield pd.DataFrame(rows, columns=["id", "text_hash", "a", "b", "n_shingles", "keys"])

    named = texts(docs).select(F.col("doc_id").cast("string").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    described = named.mapInPandas(describe, "id string, text_hash long, a long, b long, n_shingles long, keys array<long>")
    return described.select(F.col("id").cast("long").alias("doc_id"), "text_hash", "a", "b", "n_shingles", "keys")


def common_shingles(sets: DataFrame, most: int = MOST_COMMON) -> np.ndarray:
    """Sorted hashes of the ``most`` shingles that come up in most sets, as far as chunks show; they are ordered last.

    Any list gives the same links. This one keeps keys small: a shingle in more sets than about the root of
    all rows is seen in some chunk.
    """
    rows = (sets.where(F.size("common") > 0).select(F.explode(F.arrays_zip("common", "times")).alias("x"))
            .groupBy("x.common").agg(F.sum("x.times").alias("n")).orderBy(F.desc("n"), "common").limit(most))
    return np.sort(np.array([row.common for row in rows.select("common").collect()], dtype=np.int64).view(np.uint64))


def _places(hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of each hash and its place in the range, cut to 32 bits; both grow with the hash."""
    low, high, n = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32), np.uint64(ranges)
    with np.errstate(over="ignore"):
        return ((high * n + ((low * n) >> np.uint64(32))) >> np.uint64(32)).astype(np.int64), ((hashes * n) >> np.uint64(32)).astype(np.uint32)


def _packed(docs: DataFrame, common: np.ndarray, percent: int, width: int, ranges: int) -> DataFrame:
    """``part, sets, spare, sizes, shingles``: the shingles of a chunk's distinct sets by ranges of hashes, in binary arrays.

    ``spare`` is how many shingles a set has, common ones apart, beyond its prefix. When it is below zero, that many
    common ones are in the prefix: they are rows of parts below zero. Shingles of a set that fall together
    when cut count once, which can only make its prefix longer.
    """
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, sets in _chunks(batches, width):
            distinct = {_set_id(s)[0]: s for s in sets if len(s)}
            if not distinct:
                continue
            ids, held = np.array(list(distinct), dtype=np.int64), list(distinct.values())
            sizes = np.array([len(s) for s in held])
            owner, hashes = np.repeat(np.arange(len(held)), sizes), np.concatenate(held)
            often = np.isin(hashes, common)
            part, place = _places(hashes, ranges)
            once = np.r_[True, (part[1:] != part[:-1]) | (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])] & ~often
            spare = (np.bincount(owner[once], minlength=len(held)) - [prefix_size(int(n), percent) for n in sizes]).astype(np.int32)
            rows = []
            for i in np.flatnonzero((spare < 0) & (np.bincount(owner[often], minlength=len(held)) > 0)):
                keys = held[i][np.isin(held[i], common)][:-spare[i]]
                rows.append((int(-1 - ids[i] % ranges), ids[i:i + 1].tobytes(), spare[i:i + 1].tobytes(),
                             np.array([len(keys)], dtype=np.int32).tobytes(), keys.tobytes()))
            owner, part, place = owner[once], part[once], place[once]
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(ranges + 1))
            for number in np.flatnonzero(np.diff(ends)):
                mine = order[ends[number]:ends[number + 1]]
                own, n = np.unique(owner[mine], return_counts=True)
                rows.append((int(number), ids[own].tobytes(), spare[own].tobytes(), n.astype(np.int32).tobytes(), place[mine].tobytes()))
            if rows:
                yield pd.DataFrame(rows, columns=["part", "sets", "spare", "sizes", "shingles"])

    return texts(docs).select("text").mapInPandas(pack, "part int, sets binary, spare binary, sizes binary, shingles binary")


def _shared_shingles(group: pd.DataFrame) -> pd.DataFrame:
    """``a, spare, times, key``: the shingles of one range that several sets have; of parts below zero all, with times 0."""
    part = int(group["part"].iloc[0])

    def read(column: str, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(x, dtype=kind) for x in group[column]])

    sizes = read("sizes", np.int32)
    owner, spare = np.repeat(read("sets", np.int64), sizes), np.repeat(read("spare", np.int32), sizes)
    shingle = read("shingles", np.uint32 if part >= 0 else np.int64)
    order = np.lexsort((owner, shingle))
    owner, spare, shingle = owner[order], spare[order], shingle[order]
    new = np.r_[True, shingle[1:] != shingle[:-1]]
    once = new | np.r_[True, owner[1:] != owner[:-1]]   # a copy of a set in another chunk counts once
    owner, spare, shingle, new = owner[once], spare[once], shingle[once], new[once]
    if part < 0:
        return pd.DataFrame({"a": owner, "spare": spare, "times": np.zeros(len(owner), dtype=np.int64), "key": shingle})
    n = np.diff(np.r_[np.flatnonzero(new), len(new)])
    times = np.repeat(n, n)
    shared = times > 1
    return pd.DataFrame({"a": owner[shared], "spare": spare[shared], "times": times[shared],
                         "key": (np.int64(part) << np.int64(32)) + shingle[shared].astype(np.int64)})


def routing_keys(docs: DataFrame, common: np.ndarray, shingles: int, percent: int = PERCENT, width: int = SHINGLE,
                 range_shingles: int = RANGE_SHINGLES) -> DataFrame:
    """``a, key``: the keys of each set that has any; linked sets share one. ``shingles`` is about how many there are."""
    packed = _packed(docs, common, percent, width, max(1, -(-shingles // range_shingles)))
    found = (packed.groupBy("part").applyInPandas(_shared_shingles, "a long, spare int, times long, key long")
             .groupBy("a").agg(F.first("spare").alias("spare"), F.sort_array(F.collect_list(F.struct("times", "key"))).alias("all")))
    often, rare = F.filter("all", lambda x: x["times"] == 0), F.filter("all", lambda x: x["times"] > 0)
    # what no other set has comes first in the order and is no key, so this many of the shared ones are in the prefix
    left = F.greatest(F.size(rare) - F.col("spare"), F.lit(0))
    return found.select("a", F.explode(F.concat(often, F.slice(rare, F.lit(1), left))).alias("x")).select("a", "x.key")


def _link_tasks(members: DataFrame, percent: int, width: int) -> DataFrame:
    """``u, v``: for each set of a task (column ``task``) the root of its component among the task's sets."""
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Words()
        task, ids, sets = None, [], []

        def finish() -> pd.DataFrame:
            roots = linked(sets, percent)
            u = np.array(ids, dtype=np.int64)
            moved = roots != np.arange(len(roots))
            return pd.DataFrame({"u": u[moved], "v": u[roots[moved]]})

        for batch in batches:
            for row_task, a, b, text in zip(batch["task"], batch["a"], batch["b"], batch["text"], strict=True):
                if row_task != task:
                    if len(ids) > 1:
                        yield finish()
                    task, ids, sets, seen = row_task, [], [], set()
                if (a, b) in seen:
                    continue
                shingles = shingle_set(text, hashes, width)
                if _set_id(shingles) != (a, b):
                    continue  # another text with the same hash under the same document id
                seen.add((a, b))
                ids.append(a)
                sets.append(shingles)
        if len(ids) > 1:
            yield finish()

    return (members.select("task", "a", "b", "text").repartition("task").sortWithinPartitions("task", "a")
            .mapInPandas(link, "u long, v long"))


def clusters(sets: DataFrame) -> DataFrame:
    """``a, cluster`` of the sets that share a routing key with another set, directly or through others."""
    keyed = sets.where(F.size("keys") > 0).select("a", F.explode("keys").alias("key"))
    shared = materialize(keyed.groupBy("key").agg(F.min("a").alias("least"), F.max("a").alias("most"))
                         .where("least <> most").select("key", "least"), "shared-keys")
    hits = keyed.join(shared, "key").where("a <> least").select(F.col("a").alias("u"), F.col("least").alias("v"))
    return components(hits).select(F.col("node").alias("a"), F.col("root").alias("cluster"))


def _with_texts(members: DataFrame, docs: DataFrame) -> DataFrame:
    """The text of each member's document, by id (null-safe) and hash of the text, so that an id of many rows is no hot key."""
    if fits_broadcast(members):
        members = F.broadcast(members)
    wanted = members.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    keyed = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    return keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).drop("_id", "_hash")


def _big_cluster_links(members: DataFrame, docs: DataFrame, percent: int, block: int, width: int) -> DataFrame:
    """Links under keys that one task cannot hold: ``members(cluster, a, b, doc_id, text_hash, n, weight)``."""
    blocks = F.ceil(F.col("weight") / block)
    # an even spread over the size order; the hash breaks ties of equal sizes
    place = F.col("n") + F.pmod("a", F.lit(1 << 20)) / float(1 << 20)
    placed = members.withColumns({"place": place, "blocks": blocks})
    ends = placed.groupBy("cluster").agg(
        F.percentile_approx("place", F.lit([i / 64 for i in range(1, 64)]), 10_000).alias("ends"),
        F.max("blocks").alias("n_blocks"))
    # 64 size ranges, each dealt by hash into as many blocks as the cluster's weight needs
    ranged = placed.join(ends, "cluster").withColumn(
        "range", F.size(F.filter("ends", lambda e: e < F.col("place"))))
    per_range = F.greatest(F.ceil(F.col("n_blocks") / 64), F.lit(1))
    tiled = materialize(ranged.select(
        "cluster", "a", "b", "doc_id", "text_hash", "n", "weight",
        F.when(F.col("n_blocks") < 64, F.floor(F.col("range") * F.col("n_blocks") / 64))
        .otherwise(F.col("range") * per_range + F.pmod(F.xxhash64("a"), per_range)).cast("long").alias("block")), "tiles")
    spans = materialize(tiled.groupBy("cluster", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"),
                                                              F.sum("n").alias("held")), "spans")
    pivot = spans.groupBy("cluster").agg(F.max_by("block", F.struct("held", "block")).alias("pivot"))

    def met(first: DataFrame, pairs: DataFrame) -> DataFrame:
        """Run the tasks of block pairs ``cluster, one, two``; ``first`` holds the blocks named by ``one``."""
        task = F.xxhash64("cluster", "one", "two").alias("task")
        both = (first.join(pairs.withColumn("block", F.col("one")), ["cluster", "block"])
                .select(task, "a", "b", "doc_id", "text_hash")
                .unionByName(tiled.join(pairs.withColumn("block", F.col("two")), ["cluster", "block"])
                             .select(task, "a", "b", "doc_id", "text_hash")))
        return _link_tasks(_with_texts(materialize(both.distinct(), "block-tasks"), docs), percent, width)

    p, s = pivot.alias("p"), spans.alias("s")
    pivots = p.join(s, F.col("p.cluster") == F.col("s.cluster")).select(
        F.col("p.cluster").alias("cluster"), F.col("pivot").alias("one"), F.col("s.block").alias("two"))
    first = materialize(met(tiled, pivots), "pivot-links")
    roots = components(first)
    rooted = tiled.join(roots, tiled["a"] == roots["node"], "left").withColumn("root", F.coalesce("root", "a"))
    sizes = rooted.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("held"))
    largest = sizes.groupBy("cluster").agg(F.max_by("root", F.struct("held", "root")).alias("largest"))
    rest = materialize(rooted.join(largest, "cluster").where("root <> largest")
                       .select("cluster", "a", "b", "doc_id", "text_hash", "n", "block"), "unresolved")
    if not rest.head(1):
        return first
    r = rest.groupBy("cluster", "block").agg(F.min("n").alias("r_low"), F.max("n").alias("r_high")).alias("r")
    pairs = (r.join(s, F.col("r.cluster") == F.col("s.cluster"))
             .where((100 * F.col("high") >= percent * F.col("r_low")) & (100 * F.col("r_high") >= percent * F.col("low")))
             .select(F.col("r.cluster").alias("cluster"), F.col("r.block").alias("one"), F.col("s.block").alias("two")))
    return first.unionByName(met(rest, pairs))


def _searched(keyed: DataFrame, own: DataFrame, docs: DataFrame, percent: int, block: int, width: int) -> DataFrame:
    """Links among the sets under each key of ``keyed(a, key)``."""
    members = materialize(keyed.join(own, "a").withColumnRenamed("key", "cluster"), "members")
    weights = members.groupBy("cluster").agg(F.sum(F.col("n") + POINT).alias("weight"))
    weighed = materialize(members.join(weights, "cluster"), "weighed")
    small = weighed.where(F.col("weight") <= 2 * block).select(F.col("cluster").alias("task"), "a", "b", "doc_id", "text_hash")
    links = _link_tasks(_with_texts(small, docs), percent, width)
    big = weighed.where(F.col("weight") > 2 * block)
    if big.head(1):
        links = links.unionByName(_big_cluster_links(big, docs, percent, block, width))
    return materialize(links, "set-links")


def verified_links(own: DataFrame, keyed: DataFrame, docs: DataFrame, percent: int, block: int, width: int) -> DataFrame:
    """Links ``u, v`` that leave the sets in the components that all links would leave them in."""
    keyed = materialize(keyed, "routing-keys")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    keyed = materialize(keyed.join(shared, "key"), "shared-keys")
    # copies with many keys in common meet once, under the key that most sets have
    most = keyed.groupBy("a").agg(F.max_by("key", F.struct("held", "key")).alias("key"))
    first = _searched(most, own, docs, percent, block, width)
    roots = components(first)
    rooted = keyed.join(roots, keyed["a"] == roots["node"], "left").select("a", "key", F.coalesce("root", "a").alias("root"))
    # texts that are alike but not enough share many keys: of keys with the same sets one is searched
    sets = [F.bit_xor(F.xxhash64("a")).alias("these"), F.bit_xor(F.xxhash64("a", F.lit(1))).alias("those"), F.count(F.lit(1)).alias("held")]
    open_keys = (rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), *sets).where("least <> most")
                 .groupBy("these", "those", "held").agg(F.min("key").alias("key")))
    rest = materialize(keyed.join(open_keys.select("key"), "key").select("a", "key"), "open-keys")
    return first.unionByName(_searched(rest, own, docs, percent, block, width))


def jaccard_components(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK_SHINGLES) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest id reachable by links, itself included; null ids never are the
    smallest unless all are null. A null or empty text has no shingles and links with nothing. Repeated
    rows link with each other. An empty table gives an empty result; other columns are ignored.
    """
    return labelled(docs, percent, block).select("doc_id", "n_shingles", "component_id")


def labelled(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK_SHINGLES, width: int = SHINGLE) -> DataFrame:
    """As ``jaccard_components``, with the row's ``text_hash`` and ``component``, a key that no two components share."""
    grouped = percent >= GROUPED_FROM
    sets = materialize(grouped_sets(docs, percent, width) if grouped else shingle_sets(docs, width), "shingle-sets")
    own = materialize(sets.where("n_shingles > 0").groupBy("a", "b").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("of"), F.first("n_shingles").alias("n"))
        .select("a", "b", "of.doc_id", "of.text_hash", "n"), "own-sets")
    if grouped:
        links = _searched(clusters(sets).withColumnRenamed("cluster", "key"), own, docs, percent, block, width)
    else:
        shingles = own.agg(F.sum("n").alias("n")).first().n or 0
        keyed = routing_keys(docs, common_shingles(sets), shingles, percent, width)
        links = verified_links(own, keyed, docs, percent, block, width)
    roots = components(links)
    rooted = own.join(roots, own["a"] == roots["node"], "left")
    # written first, so that the join can split a component that holds many sets
    least = materialize(rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least-ids")
    labels = materialize(rooted.join(least, "root", "left")
                         .select("a", "b", F.coalesce("root", "a").alias("component"),
                                 F.coalesce("least", "doc_id").alias("component_id")), "labels")
    return (sets.join(labels, ["a", "b"], "left")
            .select("doc_id", "text_hash", "n_shingles", "component",
                    F.coalesce("component_id", "doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component: of its smallest id, then of the smallest hash of the text.

    Rows without shingles all stay, as nothing links them. All columns stay; of rows with one id and text,
    any one stays. Only the keys of rows that go meet the documents again.
    """
    rows = materialize(labelled(docs, percent, width=width).where("n_shingles > 0").select("doc_id", "text_hash", "component"), "components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    kept = materialize(rows.groupBy("component").agg(first.alias("kept")), "kept")
    same = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_hash") == F.col("kept.text_hash"))
    judged = materialize(rows.join(kept, "component").groupBy("doc_id", "text_hash")
                         .agg(F.max(same).alias("stays"), F.count(F.lit(1)).alias("copies"))
                         .where("not stays or copies > 1"), "judged")
    marked = judged.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "stays")
    if fits_broadcast(marked):
        marked = F.broadcast(marked)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                        F.col("doc_id").cast("long").alias("_key"), F.xxhash64(F.col("text").cast("string")).alias("_text"))
    met = keyed["_key"].eqNullSafe(marked["_id"]) & (keyed["_text"] == marked["_hash"])
    single = keyed.join(marked, met, "left_anti").select("_row.*")
    if not judged.where("stays").head(1):
        return single
    repeated = keyed.join(marked.where("stays"), met, "left_semi").dropDuplicates(["_key", "_text"]).select("_row.*")
    return single.unionByName(repeated)


SQL = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM t),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.rid < y.rid GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rid AS start, rid AS reached FROM t UNION SELECT r.start, e.b FROM r JOIN e ON e.a = r.reached)
SELECT any_value(o.doc_id) AS doc_id, any_value(coalesce(n.n, 0))::BIGINT AS n_shingles, min(x.doc_id) AS component_id
FROM r JOIN t o ON o.rid = r.start JOIN t x ON x.rid = r.reached LEFT JOIN n ON n.rid = r.start GROUP BY r.start
"""
