"""The inverted index as tables: postings, dictionary, per-document norm, corpus size."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagesearch.config import STOP_WORDS, SiteConfig
from pagesearch.functions.text import SEPARATORS, STEM_MARK, SYNONYM_MARK, tokens
from pagesearch.sources.store import page_hash

# A document inside the index build: 128 bits of hash in place of its site and long id, so that the
# rows which are sorted and counted by the million stay short.
KEY = ["_d1", "_d2"]
ROWS_PER_SLICE = 200     # documents whose terms a Python worker holds at a time
MOST_CHARACTERS = 16_000_000    # bytes of text whose postings a Python worker sorts at a time
ROWS_PER_BATCH = 20_000     # postings that a Python worker hands over at a time


def plain(term: Column) -> Column:
    """True for terms that are tokens of the text, false for stem and synonym terms."""
    return ~(term.startswith(STEM_MARK) | term.startswith(SYNONYM_MARK))


def single_word_groups(config: SiteConfig) -> list[tuple[str, list[str]]]:
    """``(group, one-word members)`` of the synonym groups, in lower case."""
    groups = [(g, [m.lower() for m in members if len(m.split()) == 1])
              for g, members in config.active_groups.items()]
    return [(g, words) for g, words in groups if words]


def word_runs(config: SiteConfig) -> list[tuple[str, list[str]]]:
    """``(group, words)`` of the members of several words, in lower case."""
    return [(group, words) for group, members in config.active_groups.items()
            for words in (m.lower().split() for m in members) if len(words) > 1]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_d1": F.xxhash64("site", "doc_id"), "_d2": F.xxhash64("doc_id", F.lit("#"), "site")})


def _root(token: str) -> str:
    """``functions.text.stem`` of one token."""
    if len(token) <= 3 or not token.endswith("s"):
        return token
    if token.endswith("ies") and not token.endswith(("eies", "aies")):
        return token[:-3] + "y"
    if token.endswith("es") and not token.endswith(("aes", "ees", "oes")) or not token.endswith(("us", "ss")):
        return token[:-1]
    return token


def _cells(config: SiteConfig) -> Column:
    """Of each field its text in lower case, or, where a backslash may join punctuation to a word, its tokens."""
    def cell(name: str) -> Column:
        text = F.coalesce(F.col(name), F.lit(""))
        joined = F.contains(text, F.lit("\\"))
        return F.struct(F.when(~joined, F.lower(text)).alias("text"), F.when(joined, tokens(text)).alias("words"))

    return F.array(*[cell(name) for name in config.field_weights])


# bytes of UTF-8 that tokens are made of
_INSIDE = np.array([code >= 128 or not re.match(f"[{SEPARATORS}]", chr(code)) for code in range(256)])


def cut(texts: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
    """``functions.text.all_tokens`` of texts in lower case without a backslash: the text of each token, and the tokens."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    first, size = offsets[:-1] - offsets[0], int(offsets[-1] - offsets[0])
    if not size:
        return np.empty(0, np.int64), pa.array([], pa.string())
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    inside = _INSIDE[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    starts[first[first < size]] = inside[first[first < size]]
    last = first[(first > 0) & (first < size)] - 1      # the last bytes of texts
    ends[:-1] &= ~inside[1:]
    ends[last] = inside[last]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    bounds = np.concatenate([[0], np.cumsum(ends - starts + 1)]).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data[inside]))
    return np.searchsorted(first, starts, side="right") - 1, found


def _coded(cells: pa.StructArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """From ``_cells``: of each token without stop words, in order, its number and its cell; the tokens by number."""
    texts, words = cells.flatten()
    cell, found = cut(texts.cast(pa.string()))
    joined = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    joined = np.repeat(np.arange(len(cells)), joined)   # these have no stop words any more, and may be like one without their backslashes
    coded = pa.concat_arrays([found, words.flatten().cast(pa.string())]).dictionary_encode()
    codes, cell = coded.indices.to_numpy(zero_copy_only=False), np.concatenate([cell, joined])
    kept = ~pc.is_in(coded.dictionary, pa.array(STOP_WORDS, pa.string())).to_numpy(zero_copy_only=False)[codes]
    kept[len(codes) - len(joined):] = True
    codes, cell = codes[kept], cell[kept]
    if len(joined):
        order = np.argsort(cell, kind="stable")
        codes, cell = codes[order], cell[order]
    return codes, cell, coded.dictionary.to_pylist()


@dataclass(frozen=True)
class _Counts:
    """Postings of keys by term and key; an entry is a term in a field of a key."""

    names: pa.Array         # the terms, by their names
    term: np.ndarray        # of a posting
    key: np.ndarray
    wtf: np.ndarray
    bounds: np.ndarray      # of the entries of a posting
    field: np.ndarray       # of an entry
    ends: np.ndarray        # of its places
    places: np.ndarray
    most: np.ndarray        # of a key: the greatest wtf of a token


def _count(config: SiteConfig) -> Callable[[pa.StructArray, np.ndarray, int], _Counts | None]:
    """Counts the terms of documents given as ``_cells``, with the key of each, by whole arrays of tokens."""
    weights = np.array([float(w) for w in config.field_weights.values()])
    stemmed = np.array([name not in config.no_stem_fields for name in config.field_weights])
    groups: dict[str, list[list[str]]] = defaultdict(list)      # their members, as lists of words
    for group, members in single_word_groups(config):
        groups[group].extend([word] for word in members)
    for group, run in word_runs(config):
        groups[group].append(run)

    def count(cells: pa.StructArray, key_of: np.ndarray, keys: int) -> _Counts | None:
        codes, cell, values = _coded(cells)
        if not len(codes):
            return None
        starts = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=len(cells)))])
        place = (np.arange(len(codes)) - starts[cell // len(weights) * len(weights)]).astype(np.int32)

        terms, number = list(values), {value: n for n, value in enumerate(values)}

        def numbered(term: str) -> int:
            if term not in number:
                number[term] = len(terms)
                terms.append(term)
            return number[term]

        roots = np.array([numbered(STEM_MARK + root) if (root := _root(value)) != value else -1 for value in values])
        at = np.flatnonzero((roots[codes] >= 0) & stemmed[cell % len(weights)])
        found = [(codes, np.arange(len(codes))), (roots[codes[at]], at)]
        for group, members in groups.items():
            begins = np.zeros(len(codes), bool)
            for run in members:
                n = len(codes) - len(run) + 1
                if n > 0 and all(word in number for word in run):
                    hit = cell[:n] == cell[len(run) - 1:]
                    for i, word in enumerate(run):
                        hit &= codes[i:i + n] == number[word]
                    begins[:n] |= hit
            at = np.flatnonzero(begins)
            found.append((np.full(len(at), numbered(SYNONYM_MARK + group) if len(at) else 0), at))
        names = pa.array(terms, pa.string())
        by_name = pc.sort_indices(names).to_numpy()
        rank = np.empty(len(terms), np.int64)
        rank[by_name] = np.arange(len(terms))

        # entries of a term, key and field; the postings that they make up
        at = np.concatenate([places for _, places in found])
        owned = key_of[cell // len(weights)] * len(weights) + cell % len(weights)
        entry = rank[np.concatenate([which for which, _ in found])] * (keys * len(weights)) + owned[at]
        places, room = place[at], int(place.max()) + 1
        if len(terms) * keys * len(weights) * room < 1 << 62:   # as one number, which sorts faster
            entry, places = np.divmod(np.sort(entry * room + places), room)
        else:
            order = np.lexsort((places, entry))
            entry, places = entry[order], places[order]
        places = places.astype(np.int32)
        entries = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
        ends = np.append(entries, len(entry)).astype(np.int32)
        owner, field = np.divmod(entry[entries], len(weights))
        heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        wtf = np.add.reduceat(weights[field] * np.diff(ends), heads)
        term, key = np.divmod(owner[heads], keys)
        of_text, most = by_name[term] < len(values), np.zeros(keys)
        np.maximum.at(most, key[of_text], wtf[of_text])
        return _Counts(names.take(pa.array(by_name)), term, key, wtf, np.append(heads, len(entries)).astype(np.int32), field, ends, places, most)

    return count


def _parts(postings: _Counts, document: np.ndarray, posting: np.ndarray, score: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of postings and their documents, by term.

    Documents of like score and norm lie together within a term, so these columns are written as runs.
    """
    most = np.zeros(len(score))
    most[document] = postings.most[postings.key[posting]]
    turn = np.empty(len(score), np.int64)
    turn[np.lexsort((most, score))] = np.arange(len(score))
    order = np.argsort(postings.term[posting] * len(score) + turn[document])
    for start in range(0, len(order), ROWS_PER_BATCH):
        part = order[start:start + ROWS_PER_BATCH]
        yield posting[part], document[part]


def _held(batches: Iterator[pa.RecordBatch], cells: str) -> Iterator[pa.RecordBatch]:
    """Batches together up to ``MOST_CHARACTERS`` of the texts in a column of ``_cells``."""
    def size(batch: pa.RecordBatch) -> int:
        return sum(column.nbytes for column in batch.column(cells).flatten().flatten())

    held, room = [], MOST_CHARACTERS
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_PER_SLICE):
            held.append(batch.slice(start, ROWS_PER_SLICE))
            room -= size(held[-1])
            if room <= 0:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, room = [], MOST_CHARACTERS
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


_ROWS = ("term string, wtf double, fields array<struct<field:string,tf:bigint,wtf:double,positions:array<int>>>, max_wtf double, "
         "site string, doc_id string, doc_score double")


def _document_rows(config: SiteConfig) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From documents with their keys, sorted by these, and ``_cells`` to the rows of ``term_postings``."""
    names, weights = pa.array(list(config.field_weights), pa.string()), np.array([float(w) for w in config.field_weights.values()])
    count = _count(config)

    def rows(docs: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        d1, d2 = (docs.column(name).to_numpy(zero_copy_only=False) for name in KEY)
        heads = np.concatenate([[True], (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])])
        key_of = np.cumsum(heads) - 1
        found = count(docs.column("cells").flatten(), key_of, int(key_of[-1]) + 1)
        if found is None:
            return
        # each copy of a key has the rows of all
        first, copies = np.flatnonzero(heads), np.bincount(key_of)
        times = copies[found.key]
        posting = np.repeat(np.arange(len(found.key)), times)
        document = np.repeat(first[found.key] - np.cumsum(times) + times, times) + np.arange(len(posting))
        tf = np.diff(found.ends)
        entries = pa.StructArray.from_arrays(
            [names.take(pa.array(found.field)), pa.array(tf.astype(np.int64)), pa.array(weights[found.field] * tf),
             pa.ListArray.from_arrays(pa.array(found.ends), pa.array(found.places))], names=["field", "tf", "wtf", "positions"])
        fields = pa.ListArray.from_arrays(pa.array(found.bounds), entries)
        for part, docs_of in _parts(found, document, posting, docs.column("doc_score").to_numpy(zero_copy_only=False)):
            at, own = pa.array(part), pa.array(docs_of)
            yield pa.RecordBatch.from_arrays(
                [found.names.take(pa.array(found.term[part])), pa.array(found.wtf[part]), fields.take(at), pa.array(found.most[found.key[part]]),
                 *[docs.column(name).take(own) for name in ("site", "doc_id", "doc_score")]],
                names=["term", "wtf", "fields", "max_wtf", "site", "doc_id", "doc_score"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None     # the last key of what was held, whose copies may go on
        for docs in _held(batches, "cells"):
            if left is not None:
                docs = pa.Table.from_batches([left, docs]).combine_chunks().to_batches()[0]
            d1, d2 = (docs.column(name).to_numpy(zero_copy_only=False) for name in KEY)
            whole = int(np.flatnonzero((d1 != d1[-1]) | (d2 != d2[-1]))[-1]) + 1 if (d1 != d1[-1]).any() or (d2 != d2[-1]).any() else 0
            left = docs.slice(whole)
            if whole:
                yield from rows(pa.Table.from_batches([docs.slice(0, whole)]).combine_chunks().to_batches()[0])
        if left is not None:
            yield from rows(pa.Table.from_batches([left]).combine_chunks().to_batches()[0])

    return build


def term_postings(docs: DataFrame, config: SiteConfig, partitions: int | None = None) -> DataFrame:
    """Rows ``(term, wtf, fields, max_wtf, site, doc_id, doc_score)``: one per term and document.

    ``fields`` has ``(field, tf, wtf, positions)`` of each field that holds the term.

    The documents are hash-partitioned by their page once and sorted by key, so that copies of a key meet and count together.
    Tokens are cut and counted by whole arrays in ``mapInArrow``, so no single token is shuffled, sorted or spilled, and rows
    come by term within what a worker holds. The number of partitions is given, as splitting text costs far more than its
    bytes suggest to AQE. Documents with a ``doc_bucket`` are stored, one row per key, and stay where they lie; their rows have the
    columns of ``stored_form`` as well.
    """
    if "doc_bucket" in docs.columns:
        return read_postings(stored_postings(docs, config), list(config.field_weights), list(config.field_weights.values()), with_form=True)
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    score = F.col("score") if "score" in docs.columns else F.lit(1.0)
    paged = _keyed(docs).select(page_hash(F.col("site"), F.col("doc_id")).alias("_page"), *KEY, "site", "doc_id",
                                score.cast("double").alias("doc_score"), *[F.col(name).alias(f"_f{i}") for i, name in enumerate(config.field_weights)])
    met = paged.repartition(partitions, "_page").sortWithinPartitions(*KEY)
    texts = met.select(*KEY, *[F.col(f"_f{i}").alias(name) for i, name in enumerate(config.field_weights)],
                       F.col("site").alias("_site"), F.col("doc_id").alias("_doc_id"), F.col("doc_score").alias("_doc_score"))
    return texts.select(*KEY, F.col("_site").alias("site"), F.col("_doc_id").alias("doc_id"), F.col("_doc_score").alias("doc_score"),
                        _cells(config).alias("cells")).mapInArrow(_document_rows(config), _ROWS)


_STORED = "term string, doc_id string, doc_score double, max_wtf double, fields array<tinyint>, positions array<array<int>>"


def _sorted_rows(config: SiteConfig, with_site: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From documents ``(site, doc_id, doc_score, cells)`` to rows of ``stored_postings``."""
    count, site = _count(config), ["site"] if with_site else []

    def rows(docs: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = count(docs.column("cells").flatten(), np.arange(docs.num_rows), docs.num_rows)
        if found is None:
            return
        bounds = pa.array(found.bounds)
        fields = pa.ListArray.from_arrays(bounds, pa.array(found.field.astype(np.int8)))
        positions = pa.ListArray.from_arrays(bounds, pa.ListArray.from_arrays(pa.array(found.ends), pa.array(found.places)))
        score = docs.column("doc_score").to_numpy(zero_copy_only=False)
        for part, docs_of in _parts(found, found.key, np.arange(len(found.key)), score):
            at, own = pa.array(part), pa.array(docs_of)
            yield pa.RecordBatch.from_arrays(
                [found.names.take(pa.array(found.term[part])), docs.column("doc_id").take(own), docs.column("doc_score").take(own),
                 pa.array(found.most[docs_of]), fields.take(at), positions.take(at), *[docs.column(name).take(own) for name in site]],
                names=["term", "doc_id", "doc_score", "max_wtf", "fields", "positions", *site])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _held(batches, "cells"):
            yield from rows(docs)

    return build


def stored_postings(docs: DataFrame, config: SiteConfig, with_site: bool = True) -> DataFrame:
    """What ``term_postings`` says of documents with one row per site and id, in the form that is stored; see ``read_postings``.

    Nothing is moved: the terms of a document are counted where it lies, and a task's rows are sorted by term. ``fields`` has the numbers
    of the fields that hold the term, ``positions`` the positions in each; frequencies follow from these and are not stored.
    Documents of a single site need not say it in each row.
    """
    score = F.col("score") if "score" in docs.columns else F.lit(1.0)
    return docs.select("site", "doc_id", score.cast("double").alias("doc_score"), _cells(config).alias("cells")) \
        .mapInArrow(_sorted_rows(config, with_site), _STORED + ", site string" * with_site)


def stored_form(term_rows: DataFrame, config: SiteConfig) -> DataFrame:
    """Rows of ``term_postings`` in the form that ``stored_postings`` has."""
    fields, positions = F.col("_fields"), F.col("_positions")
    if "_fields" not in term_rows.columns:
        names = F.array(*[F.lit(name) for name in config.field_weights])
        fields = F.transform("fields", lambda f: (F.array_position(names, f["field"]) - 1).cast("tinyint"))
        positions = F.transform("fields", lambda f: f["positions"])
    return term_rows.select("term", "doc_id", "doc_score", "max_wtf", fields.alias("fields"), positions.alias("positions"), "site")


def read_postings(stored: DataFrame, field_names: Sequence[str], field_weights: Sequence[float], *more: str,
                  with_form: bool = False) -> DataFrame:
    """The rows of ``term_postings`` from ``stored_postings``, with the fields that these were built with; they keep ``more`` columns."""
    form = [F.col("fields").alias("_fields"), F.col("positions").alias("_positions")] if with_form else []
    names, weights = F.array(*[F.lit(name) for name in field_names]), F.array(*[F.lit(float(w)) for w in field_weights])
    fields = F.zip_with("fields", "positions", lambda f, p: F.struct(
        F.get(names, f).alias("field"), F.size(p).cast("long").alias("tf"), (F.get(weights, f) * F.size(p)).alias("wtf"), p.alias("positions")))
    wtf = F.aggregate(F.zip_with("fields", "positions", lambda f, p: F.get(weights, f) * F.size(p)), F.lit(0.0), lambda total, w: total + w)
    return stored.select("term", wtf.alias("wtf"), fields.alias("fields"), "max_wtf", "site", "doc_id", "doc_score", *more, *form)


def collected(keyed: DataFrame, occurrences: DataFrame) -> DataFrame:
    """See ``term_postings``, from rows ``(key, field, weight, position, term)`` and the keyed documents."""
    per_field_term = occurrences.groupBy("term", "field", "weight", *KEY).agg(
        F.array_sort(F.collect_list("position")).alias("positions"))
    weighed = per_field_term.withColumn("tf", F.size("positions").cast("long")) \
        .withColumn("wtf", F.col("weight") * F.col("tf"))
    per_term = weighed.groupBy("term", *KEY).agg(
        F.sum("wtf").alias("wtf"), F.collect_list(F.struct("field", "tf", "wtf", "positions")).alias("fields"))
    tokens_only = F.when(plain(F.col("term")), F.col("wtf"))
    normed = per_term.withColumn("max_wtf", F.max(tokens_only).over(W.partitionBy(*KEY)))
    score = F.col("score") if "score" in keyed.columns else F.lit(1.0)
    owners = keyed.select(*KEY, "site", "doc_id", score.alias("doc_score"))
    return normed.join(owners.hint("shuffle_merge"), KEY).drop(*KEY)


def postings(term_rows: DataFrame) -> DataFrame:
    """Rows ``(site, term, doc_id, field, tf, wtf, positions)``: one per term, document and field."""
    return term_rows.select("site", "term", "doc_id", F.inline("fields"))


def dictionary(term_rows: DataFrame) -> DataFrame:
    """Rows ``(site, term, df)`` from one row per term and document."""
    return term_rows.groupBy("site", "term").agg(F.count("*").alias("df"))


def corpus_size(docs: DataFrame) -> DataFrame:
    return docs.groupBy("site").agg(F.count("*").alias("n_docs"))
