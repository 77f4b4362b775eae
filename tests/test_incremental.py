"""An index that grows by batches against one built anew from the pages as they are last."""

import random

import pytest
from pyspark.sql import functions as F

from pagesearch.functions.scores import boost_pages, boost_top_level_pages
from pagesearch.config import SiteConfig
from pagesearch.operators import postings
from pagesearch.operators.validate import title_marker
from pagesearch.plans.incremental import apply_pages, open_segments, refresh_index
from pagesearch.plans.index_site import open_index, parse_documents, reindex
from pagesearch.plans.search import search
from pagesearch.sources import segments
from pagesearch.sources.store import IndexStore
from pagesearch.streaming import ingest as I

SITE = "https://docs.example.com"
CONFIG = SiteConfig(SITE, literal_terms=("v6.2.8",), scorers=(boost_pages, boost_top_level_pages), score_hierarchy="resolved",
                    synonym_groups={"k": ("kube", "container ship")}, validators=(title_marker("DRAFT"),))
WORDS = "apple pear plum fig quince kube lemon container ship grape v6.2.8 far".split()
SCHEMA = "page_id long, site string, url string, html string"
QUERIES = ["apple", "pear plum", "qui*", "kube", "*", "v6.2.8 far", "grape fig", "the", "lemon ship", "nothing"]


def page(path, title, words):
    number = abs(hash((path, title))) % 10 ** 6
    return (number, SITE, f"{SITE}/{path}", f"<title>{title}</title><p>{words}</p><h2>Part</h2><p>{words} more {words[:5]}</p>")


def site(seed):
    """Pages by path: two levels of inner pages and leaves below them."""
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 9)))
    pages = {f"a{i}": (f"Area {i}", text()) for i in range(3)}
    pages |= {f"a{i % 3}/b{i}": (f"Book {i}", text()) for i in range(5)}
    pages |= {f"a{i % 3}/b{i % 5}/c{i}": (f"Chapter {i}", text()) for i in range(14)}
    return pages


def frame(spark, pages):
    return spark.createDataFrame([page(path, *rest) for path, rest in pages.items()] or [], SCHEMA)


def state(spark, index):
    """Everything a reader sees: documents, postings, frequencies, sizes and answers."""
    docs = sorted((r.doc_id, r.title, tuple(r.hierarchy), r.body, round(r.score, 9)) for r in index.documents.collect())
    posts = sorted((r.term, r.doc_id, round(r.wtf, 6), round(r.max_wtf, 6), round(r.doc_score, 9)) for r in index.postings.collect())
    asked = spark.createDataFrame([(i, q, f"{SITE}/a1/x" if i % 3 == 0 else None, 0, 50, None) for i, q in enumerate(QUERIES)],
                                  "query_id long, q string, from_url string, start int, num int, site string")
    result = search(index, asked, SITE)
    return (docs, posts, sorted(map(tuple, index.terms.select("site", "term", "df").collect())),
            sorted(map(tuple, index.sites.select("site", "n_docs").collect())),
            sorted(map(tuple, result.hits.select("query_id", "rank", "title", "section_title", "hierarchy", "body", "url").collect())),
            sorted(map(tuple, result.totals.collect())))


def rebuilt(spark, pages, folder):
    store = IndexStore(spark, str(folder), "whole")
    reindex(frame(spark, pages), CONFIG, store, buckets=4)
    return open_index(store, CONFIG)


# changed text, a new title of an inner page, a draft, a page back from being a draft, new pages below new inner pages
STEPS = [
    {"a0/b0/c0": ("Chapter 0", "pear pear quince"), "a1": ("Areal", "plum"), "a2/b2/c2": ("DRAFT", "apple")},
    {"a3": ("Area 3", "fig"), "a3/b9/c99": ("Chapter 99", "apple kube"), "a2/b2/c2": ("Chapter 2", "far far")},
    {"a3/b9": ("Book 9", "container ship"), "a0": ("DRAFT area", "apple"), "a1/b4": ("Book 4", "grape fig")},
]


def after(pages, steps):
    last = dict(pages)
    for step in steps:
        last |= step
    return last


def test_batches_equal_a_rebuild(spark, tmp_path):
    store, pages = IndexStore(spark, str(tmp_path / "steps"), "docs"), site(1)
    assert apply_pages(store, CONFIG, parse_documents(frame(spark, {}), CONFIG), None, 4, 3) is None and store.current() is None
    assert apply_pages(store, CONFIG, parse_documents(frame(spark, pages), CONFIG), None, 4, 3).count() == 0
    for number, step in enumerate(STEPS):
        went = apply_pages(store, CONFIG, parse_documents(frame(spark, step), CONFIG))
        assert went.count() > 0 or number == 1
        if number < 2:
            assert len(segments.manifest(store)) > 1
    assert state(spark, open_segments(store, CONFIG)) == state(spark, rebuilt(spark, after(pages, STEPS), tmp_path))
    # a batch that comes again changes nothing
    version = store.current()
    assert apply_pages(store, CONFIG, parse_documents(frame(spark, STEPS[-1]), CONFIG)).count() == 0
    assert store.current() == version


def test_only_changed_documents_are_tokenised(spark, tmp_path, monkeypatch):
    store, pages = IndexStore(spark, str(tmp_path), "docs"), site(2)
    crawl = parse_documents(frame(spark, pages), CONFIG)
    refresh_index(store, CONFIG, crawl, 4, 3)
    seen = []
    build = postings.term_postings

    def counted(docs, config):
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        return build(docs, config)

    monkeypatch.setattr(postings, "term_postings", counted)
    later = dict(pages) | {"a0/b0/c0": ("Chapter 0", "entirely new"), "a1": ("Areal", pages["a1"][1])}
    del later["a2/b2/c2"]
    went = {r.doc_id for r in refresh_index(store, CONFIG, parse_documents(frame(spark, later), CONFIG)).collect()}
    new = {r.doc_id for r in parse_documents(frame(spark, later), CONFIG).join(crawl, "doc_id", "left_anti").collect()}
    # the documents below a1 have another breadcrumb, but the same score: their postings stay where they are
    assert set().union(*seen) == new | went and len(new) == 4 and len(went) == 6
    monkeypatch.undo()
    assert state(spark, open_segments(store, CONFIG)) == state(spark, rebuilt(spark, later, tmp_path))


def test_merging_keeps_everything_and_few_segments(spark, tmp_path, monkeypatch):
    store, pages = IndexStore(spark, str(tmp_path), "docs"), site(3)
    apply_pages(store, CONFIG, parse_documents(frame(spark, pages), CONFIG), None, 2, 2)
    before = state(spark, open_segments(store, CONFIG))
    step = {"a0/b0/c0": ("Chapter 0", "zebra"), "a0": ("Area zero", "apple")}
    monkeypatch.setattr(segments, "mergeable", len)     # never
    apply_pages(store, CONFIG, parse_documents(frame(spark, step), CONFIG))
    back = {path: pages[path] for path in step}
    apply_pages(store, CONFIG, parse_documents(frame(spark, back), CONFIG))
    assert len(segments.manifest(store)) == 3
    assert state(spark, open_segments(store, CONFIG)) == before
    for first in (1, 0):
        segments.publish_segments(store, segments.merged(store, segments.manifest(store), first))
        assert len(segments.manifest(store)) == first + 1
        assert state(spark, open_segments(store, CONFIG)) == before
    named = [s.name for s in segments.manifest(store)]
    assert segments.children(spark, f"{store.home}/segments") == named


def test_merge_policy_keeps_sizes_apart():
    def sized(*docs):
        return [segments.Segment(i, str(i), n, 1, 1) for i, n in enumerate(docs)]

    assert segments.mergeable(sized(1000, 10)) == 2 and segments.mergeable(sized(1000, 10, 8)) == 1
    assert segments.mergeable(sized(30, 10, 8)) == 0 and segments.mergeable(sized(5)) == 1 and segments.mergeable(sized(5, 0)) == 2


def test_everything_can_go_and_come_back(spark, tmp_path):
    store, pages = IndexStore(spark, str(tmp_path), "docs"), {"a": ("A", "apple"), "a/b": ("B", "pear")}
    refresh_index(store, CONFIG, parse_documents(frame(spark, pages), CONFIG), 2, 2)
    gone = spark.createDataFrame([(SITE, f"{SITE}/a"), (SITE, f"{SITE}/a/b/")], "site string, url string")
    assert apply_pages(store, CONFIG, parse_documents(frame(spark, {}), CONFIG), gone).count() == 4
    assert open_segments(store, CONFIG).documents.count() == open_segments(store, CONFIG).terms.count() == 0
    refresh_index(store, CONFIG, parse_documents(frame(spark, pages), CONFIG))
    assert state(spark, open_segments(store, CONFIG)) == state(spark, rebuilt(spark, pages, tmp_path))


def test_stream_fills_the_index(spark, tmp_path):
    source, store, pages = str(tmp_path / "pages"), IndexStore(spark, str(tmp_path / "ix"), "docs"), site(4)
    for step in (pages, *STEPS):
        frame(spark, step).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    I.index_stream(stream, lambda batch: parse_documents(batch, CONFIG), CONFIG, store, str(tmp_path / "cp"), 4, 3)
    assert state(spark, open_segments(store, CONFIG)) == state(spark, rebuilt(spark, after(pages, STEPS), tmp_path))


def test_stream_keeps_each_key_once_without_state(spark, tmp_path):
    source, staging, point = (str(tmp_path / name) for name in ("rows", "out", "cp"))
    schema = "k string, l int, v string"
    batches = [[("a", 1, "x"), ("a", 1, "w"), ("b", None, "y")], [("a", 1, "later"), ("a", 2, "z"), (None, None, "n")], [("b", None, "again"), (None, None, "m")], [("c", 3, "new")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    I.distinct_stream(stream(), ["k", "l"], staging, point, buckets=4)
    want = [("a", 1, "w"), ("a", 2, "z"), ("b", None, "y"), ("c", 3, "new"), (None, None, "n")]
    read = lambda: sorted((tuple(r) for r in spark.read.schema(schema).parquet(staging).select("k", "l", "v").collect()), key=repr)
    assert read() == sorted(want, key=repr)
    assert not (tmp_path / "cp" / "state").exists()
    # batches that run again, as after a lost checkpoint, leave the same rows
    I.distinct_stream(stream(), ["k", "l"], staging, str(tmp_path / "cp2"), buckets=4)
    assert read() == sorted(want, key=repr)


def test_tables_on_the_way_go_and_postings_stay_where_their_documents_lie(spark, tmp_path, monkeypatch):
    from pagesearch.session import work_folder

    def left():
        names = ("parsed-", "crawl-", "scored-", "added-", "fresh-", "moved-", "new-postings-", "valid-", "leaving-", "segment-documents-")
        return {name for name in segments.children(spark, f"{work_folder(spark)}/tables") if name.startswith(names)}

    store, pages, before = IndexStore(spark, str(tmp_path), "docs"), site(6), left()
    monkeypatch.setattr(segments, "mergeable", len)
    refresh_index(store, CONFIG, parse_documents(frame(spark, pages), CONFIG), 4, 3)
    later = dict(pages) | {"a0/b0/c0": ("Chapter 0", "entirely new"), "a1": ("Areal", pages["a1"][1])}
    refresh_index(store, CONFIG, parse_documents(frame(spark, later), CONFIG))
    assert left() == before
    for segment in segments.manifest(store):
        folder = segments.read_table(store, segment.name, "postings")
        assert "term_bucket" not in folder.columns
        files = len(folder.inputFiles())
        assert files <= len(segments.read_table(store, segment.name, "documents").inputFiles())
    assert len(segments.manifest(store)) == 2


def test_segments_keep_the_weights_they_were_built_with(spark, tmp_path):
    from dataclasses import replace

    store, pages = IndexStore(spark, str(tmp_path), "docs"), {"a": ("A", "apple"), "a/b": ("B", "pear plum")}
    apply_pages(store, CONFIG, parse_documents(frame(spark, pages), CONFIG), None, 2, 2)
    heavy = replace(CONFIG, field_weights={"body": 7.0, "title": 2.0, "section_title": 1.0, "url": 1.0, "s": 1.0})
    apply_pages(store, heavy, parse_documents(frame(spark, {"c": ("C", "quince quince")}), heavy))
    apply_pages(store, heavy, parse_documents(frame(spark, {"d": ("D", "lemon")}), heavy))
    got = {(r.term, r.wtf) for r in open_segments(store, heavy).postings.filter("term in ('pear', 'quince', 'lemon') and doc_id like '%:section:%'").collect()}
    assert got == {("pear", 2 * 1.5), ("quince", 2 * 7.0), ("lemon", 2 * 7.0)}


def test_joins_by_ids_agree_however_ids_travel(spark, monkeypatch):
    from pagesearch.operators import skew

    rows = spark.createDataFrame([("s", "a", 0), ("s", "b", 1), ("t", "a", 2), (None, "a", 0), ("s", None, 0), ("s", "b", 5)], "site string, doc_id string, _seq int")
    ids = spark.createDataFrame([("s", "a", 1), ("s", "b", 3), (None, "a", 9), ("s", None, 9), ("u", "a", 9)], "site string, doc_id string, _until int")
    flat = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for fits in (lambda *a, **b: True, lambda *a, max_rows=0, **b: max_rows == skew.MOST_HASHES, lambda *a, **b: False):
        monkeypatch.setattr(skew, "fits_broadcast", fits)
        assert flat(skew.by_ids(rows, ids, ["site", "doc_id"], "left_semi")) == [("s", "a", 0), ("s", "b", 1)]
        assert flat(skew.by_ids(rows, ids, ["site", "doc_id"], "left_anti")) == [("s", "b", 5), ("s", None, 0), ("t", "a", 2), (None, "a", 0)]
        assert flat(skew.by_ids(rows, ids.drop("_until"), ["site", "doc_id"], "left_semi")) == [("s", "a", 0), ("s", "b", 1), ("s", "b", 5)]


@pytest.mark.parametrize("name", ["absent"])
def test_nothing_published(spark, tmp_path, name):
    with pytest.raises(LookupError):
        open_segments(IndexStore(spark, str(tmp_path), name), CONFIG)
