"""Index versions, refresh, streaming, ranking and matching on small fixtures."""

import math
from itertools import pairwise
from random import Random

import pytest
from pyspark.sql import functions as F

from pagesearch.config import STOP_WORDS, LandingPage, SiteConfig
from pagesearch.functions.scores import boost_pages
from pagesearch.operators import match as M, rank as K, skew
from pagesearch.operators.postings import word_runs
from pagesearch.operators.refresh import refresh_diff, upsert_latest
from pagesearch.plans.index_site import index_documents, open_index, parse_documents, reindex
from pagesearch.plans import index_site, search as P
from pagesearch.plans.search import search
from pagesearch.session import FREED, discard, fresh_path, materialize, work_folder
from pagesearch.sources.catalogue import configured_landing_pages
from pagesearch.sources.store import IndexStore, children, doc_bucket
from pagesearch.streaming import ingest as I

SITE = "https://docs.example.com"
CONFIG = SiteConfig(SITE, literal_terms=("v6.2.8",), scorers=(boost_pages,),
                    synonym_groups={"k": ("kube", "container ship"), "all": ("every",)})
TEXTS = ["kube apples and oranges", "apple pie with a container ship", "oranges apples apples v6.2.8", "pear", "apples far far far away oranges"]


def html(text):
    return f"<title>T {text.split()[0]}</title> <p>{text}</p>"


def page_rows(spark, texts=TEXTS):
    return spark.createDataFrame([(i, SITE, f"{SITE}/s{i % 2}/{i}", html(t)) for i, t in enumerate(texts)],
                                 "page_id long, site string, url string, html string")


@pytest.fixture
def store(spark, tmp_path):
    return IndexStore(spark, str(tmp_path), "docs")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    kept = IndexStore(spark, str(tmp_path_factory.mktemp("ix")), "docs")
    reindex(page_rows(spark), CONFIG, kept, buckets=4)
    return open_index(kept, CONFIG)


def run(spark, index, *queries, **options):
    rows = [(i, q, None, 0, 30, None) if isinstance(q, str) else (i, *q) for i, q in enumerate(queries)]
    asked = spark.createDataFrame(rows, "query_id long, q string, from_url string, start int, num int, site string")
    return search(index, asked, SITE, **options)


def urls(result, query_id=0):
    rows = result.hits.filter(F.col("query_id") == query_id).orderBy("rank").collect()
    return [r.url.rsplit("/", 1)[1] for r in rows]


def test_reindex_publishes_and_finds_stale(spark, store):
    assert reindex(page_rows(spark), CONFIG, store, buckets=4).count() == 0
    first = store.current()
    assert reindex(page_rows(spark), CONFIG, store, buckets=4).count() == 0
    assert store.current() != first and store.versions() == [store.current()]
    stale = reindex(page_rows(spark, TEXTS[:3] + ["plum"]), CONFIG, store, buckets=4).collect()
    assert sorted(r.doc_id.split(":page:")[0][-1] for r in stale) == ["3", "4"]
    store.register({"docs_now": "documents"})
    assert spark.sql("select count(*) n from docs_now").first().n == 4
    assert store.versions() == [store.current()] and store.drop_old_versions() == []
    current = store.current()
    assert reindex(page_rows(spark).limit(0), CONFIG, store, buckets=4) is None
    assert store.current() == current and store.versions() == [current]
    store.drop()
    assert store.current() is None


def test_own_parser(spark, store):
    def parser(pages, config):
        return parse_documents(pages, config).withColumn("title", F.upper("title"))

    reindex(page_rows(spark), CONFIG, store, parser, buckets=2)
    assert all(r.title.isupper() for r in store.read("documents").collect())


def test_copies_of_a_key_meet_in_their_bucket(spark, store, monkeypatch):
    seen, real = [], index_site.write_by_id

    def write(docs, path, *buckets):
        plan = docs._jdf.queryExecution().executedPlan().toString()
        seen.append((plan.count("Exchange "), spark.conf.get(FREED)))
        real(docs, path, *buckets)

    monkeypatch.setattr(index_site, "write_by_id", write)
    rows = [(page, SITE, f"key{n}", f"{n}", f"body {page}") for n in range(20) for page in range(1 + n % 3)] + [(7, SITE, "none", None, "x")]
    docs = spark.createDataFrame(rows, "page_id long, site string, doc_key string, doc_id string, body string")
    docs = docs.withColumns({"url": F.lit(SITE), "title": F.lit("t"), "section_title": F.lit(""), "s": F.lit(""), "score": F.lit(1.0)})
    version = index_site.store_index(docs, CONFIG, store, 2, doc_buckets=3)
    out = store.read("documents", version).withColumn("of", doc_bucket(F.col("site"), F.col("doc_id"), 3)).collect()
    assert {(r.doc_key, r.page_id) for r in out} == {(f"key{n}", n % 3) for n in range(20)} | {("none", 7)} and len(out) == 21
    assert all(r.doc_bucket == r.of for r in out)
    assert seen == [(1, "true")]    # one shuffle, whose files go with the action


def test_documents_of_a_page_lie_together_and_their_tables_go(spark, store):
    def left():
        return [name for name in children(spark, f"{work_folder(spark)}/tables") if name.startswith(("parsed-", "scored-"))]

    before = left()
    reindex(page_rows(spark), CONFIG, store, buckets=4)
    assert left() == before and store.read("documents").count() == len(TEXTS)
    with pytest.raises(ValueError):
        discard(store.read("terms"))
    url, md5 = f"{SITE}/a:b", "0123456789abcdef" * 2
    ids = [(f"{url}:page:{md5}",), (f"{url}:section:{md5[::-1]}",), (url,), ("7",), ("8",), (None,), (f"{url}:page:{md5}x",)]
    buckets = [r.b for r in spark.createDataFrame(ids, "doc_id string").coalesce(1)
               .select(doc_bucket(F.lit(SITE), F.col("doc_id"), 1_000_003).alias("b")).collect()]
    assert len(set(buckets[:3])) == 1 and len(set(buckets[2:])) == 5


def test_upsert_and_diff(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b"), ("l", 1, "d")], "doc_key string, page_id long, v string")
    assert {tuple(r) for r in upsert_latest(rows, ["page_id"]).collect()} == {("k", 3, "c"), ("l", 1, "d")}
    old = spark.createDataFrame([("1", "u1"), ("2", "u2"), ("3", "u3")], "doc_id string, url string")
    new = spark.createDataFrame([("1", "u1"), ("9", "u2"), ("4", "u4")], "doc_id string, url string")
    assert {r.doc_id: r.status for r in refresh_diff(old, new).collect()} == {
        "1": "kept", "2": "replaced", "9": "changed", "3": "gone", "4": "new"}


def test_stream_equals_batch(spark, store, tmp_path):
    source, staging = str(tmp_path / "pages"), str(tmp_path / "staging")
    page_rows(spark).drop("site").repartition(3).write.parquet(source)
    page_rows(spark).drop("site").write.mode("append").parquet(source)
    extract = lambda batch: parse_documents(batch.withColumn("site", F.lit(SITE)), CONFIG)
    I.ingest(I.page_stream(spark, source, files_per_batch=1), extract, staging, str(tmp_path / "cp"))
    batch = parse_documents(page_rows(spark), CONFIG)
    streamed = I.latest_documents(spark, staging)
    assert sorted(map(tuple, streamed.select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))
    assert I.finish(spark, staging, CONFIG, store, buckets=2).count() == 0
    assert store.read("documents").count() == len(TEXTS)


def test_words_stems_synonyms_prefixes(spark, index):
    result = run(spark, index, "apple", "kube", "orang*", "v6.2.8", "apples pie", "the", "nothere", "*", "every*")
    assert set(urls(result, 0)) == {"0", "1", "2", "4"}
    assert set(urls(result, 1)) == {"0", "1"}
    assert set(urls(result, 2)) == {"0", "2", "4"}
    assert urls(result, 3) == ["2"]
    assert urls(result, 4) == ["1"]
    totals = {r.query_id: r.total for r in result.totals.collect()}
    assert totals == {0: 4, 1: 2, 2: 3, 3: 1, 4: 1, 5: 0, 6: 0, 7: 5, 8: 0}
    body = result.hits.filter("query_id = 3").first().body
    assert "<b>v6</b>.2.8" in body


def test_synonyms_of_several_words_in_requests(spark, index):
    result = run(spark, index, "container ship", "apple container ship", "ship container", "apple ship*", "kube")
    # a request for the phrase finds what the one word finds; the words apart stay words
    assert set(urls(result, 0)) == set(urls(result, 4)) == {"0", "1"}
    assert set(urls(result, 1)) == {"0", "1"} and urls(result, 2) == ["1"] and urls(result, 3) == ["1"]


def test_longest_synonym_wins_from_left_to_right(spark):
    config = SiteConfig(SITE, synonym_groups={"a": ("x y", "one"), "b": ("x y z", "two w"), "c": ("y z",), "d": ("x y",)})
    asked = spark.createDataFrame([("1", SITE, "x y z x y w"), ("2", SITE, "w x y*"), ("3", SITE, "y z y z x"), ("4", SITE, ""), ("5", SITE, "x")],
                                  "qkey string, site string, query_text string")
    found = {}
    for r in P.query_pieces(asked, P.synonym_phrases(spark, config)).collect():
        found.setdefault(r.qkey, []).append((r.slot, r.kind, r.text))
    assert {k: sorted(v) for k, v in found.items()} == {
        "1": [(0, "token", "~ b"), (1, "token", "~ a"), (1, "token", "~ d"), (2, "exact", "w")],
        "2": [(0, "exact", "w"), (1, "exact", "x"), (2, "prefix", "y")],
        "3": [(0, "token", "~ c"), (1, "token", "~ c"), (2, "exact", "x")], "5": [(0, "exact", "x")]}


def test_synonym_runs_keep_a_text_where_it_is(spark, monkeypatch):
    config = SiteConfig(SITE, synonym_groups={"a": ("x y", "one"), "b": ("x y z", "two w"), "c": ("y z",), "d": ("x y",)})
    phrases = {}
    for group, words in word_runs(config):
        phrases.setdefault(tuple(words), set()).add("~ " + group)
    random = Random(5)
    texts = ["x " * 50 + "y z " * 3000, "y z", "x y z*", "X Y z x \\* y*", "\\x y z", "the x y", None, "* x y", "x the y z"]
    texts += [" ".join(random.choice(["x", "y", "z", "w", "two", "the", "y*", "q"]) for _ in range(random.randrange(40))) for _ in range(60)]
    expected = set()
    for key, text in enumerate(texts):
        words = [w for w in (text or "").lower().replace("\\", "").split() if w not in STOP_WORDS and w != "*"]
        at = slot = 0
        while at < len(words):
            n = max((n for n in (2, 3) if tuple(words[at:at + n]) in phrases), default=1)
            if n > 1:
                expected |= {(str(key), slot, "token", mark) for mark in phrases[tuple(words[at:at + n])]}
            else:
                starred = words[at].endswith("*")
                expected.add((str(key), slot, "prefix" if starred else "exact", words[at].removesuffix("*")))
            at, slot = at + n, slot + 1
    asked = spark.createDataFrame([(str(i), SITE, t) for i, t in enumerate(texts) if "*" not in (t or "") or i > 8], "qkey string, site string, query_text string")
    expected = {row for row in expected if row[0] in {str(i) for i, t in enumerate(texts) if "*" not in (t or "") or i > 8}}
    table = P.synonym_phrases(spark, config)
    pieces = P.query_pieces(asked, table)
    found = [tuple(r[c] for c in ("qkey", "slot", "kind", "text")) for r in pieces.collect()]
    assert len(found) == len(expected) and set(found) == expected
    # words are neither shuffled nor folded one by one
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "aggregate(" not in plan
    monkeypatch.setattr(P, "PUSHED_PHRASES", 1)
    joined = P.query_pieces(asked, table)
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r[c] for c in ("qkey", "slot", "kind", "text")) for r in joined.collect()) == sorted(found)


def test_score_formula(spark, index):
    hits = M.match(spark.createDataFrame([("q", SITE, 0, "must", "token", "pear", "")],
                                         "qkey string, site string, slot int, occur string, kind string, text string, field string"), index)
    row = hits.collect()[0]
    # title (weight 10) and body (1.5) hold the word once each; it is the top word of its document
    assert row.base == pytest.approx(math.log2(1 + 6 / 1))


def test_landing_section_and_invalid_site(spark, index):
    landing = configured_landing_pages(spark, SITE, [LandingPage("apple", "Landing", "/s0/0", "Hello")])
    result = run(spark, index, "apple*", ("apple", f"{SITE}/s1/x", 0, 30, None), ("apple", None, 0, 30, "https://no.example.com"),
                 landing_pages=landing)
    found = result.hits.filter("query_id = 0").orderBy("rank").collect()
    assert (found[0].rank, found[0].title, found[0].url) == (0, "Landing", f"{SITE}/s0/0")
    assert [r.url for r in found].count(f"{SITE}/s0/0") == 1
    assert urls(result, 1)[1] == "1"  # in the section, after the landing page
    status = {r.query_id: (r.status, r.total) for r in result.totals.collect()}
    assert status[2] == ("invalid_site", 0) and status[0] == ("ok", 4)


def test_pages_join_up(spark, index):
    result = run(spark, index, ("*", None, 0, 2, None), ("*", None, 2, 2, None), ("*", None, 0, 4, None))
    assert urls(result, 0) + urls(result, 1) == urls(result, 2)


def test_salted_joins_give_the_same(spark, index, monkeypatch):
    queries = ("apples oranges", "orang*", "kube", "*", ("apple", f"{SITE}/s1/x", 0, 30, None))
    def answer():
        result = run(spark, index, *queries)
        return sorted(map(tuple, result.hits.collect())), sorted(map(tuple, result.totals.collect()))

    broadcast = answer()
    monkeypatch.setattr(skew, "fits_broadcast", lambda df, max_rows=0: False)
    monkeypatch.setattr(M, "fits_broadcast", lambda df, max_rows=0: False)
    monkeypatch.setattr(K, "fits_broadcast", lambda df, max_rows=0: False)
    monkeypatch.setattr(index_site, "fits_broadcast", lambda df, max_rows=0: False)
    monkeypatch.setattr(M.SlotProfile, "fits", False)
    assert answer() == broadcast


def test_deep_ranks_equal_window_ranks(spark):
    hits = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("qkey"), F.concat(F.lit("d"), "id").alias("doc_id"),
        (F.col("id") % 7).cast("double").alias("score")).repartition(6)
    want = sorted(map(tuple, K.top_ranks(hits, 3000).select("qkey", "doc_id", "rank").collect()))
    assert sorted(map(tuple, K.all_ranks(hits).select("qkey", "doc_id", "rank").collect())) == want
    asked = spark.createDataFrame([(1, "hot", 0, 10), (2, "hot", 1500, 100), (3, "cold", 95, 10), (4, "gone", 0, 5)],
                                  "query_id long, qkey string, start int, num int")
    page = K.page_ranks(hits, asked, window_depth=100).collect()
    ranks = {q: sorted(r.rank for r in page if r.query_id == q) for q in (1, 2, 3, 4)}
    assert ranks == {1: list(range(1, 11)), 2: list(range(1501, 1601)), 3: list(range(96, 106)), 4: []}
    order = {(q, d): r for q, d, r in want}
    assert all(order[r.qkey, r.doc_id] == r.rank for r in page)


@pytest.mark.parametrize("lists", [([1, 9], [4, 20]), ([5], [5]), ([1, 2, 3], [100]), ([7], [3], [8])])
def test_slop(one, lists):
    gaps = [min(abs(a - b) for a in left for b in right) for left, right in pairwise(lists)]
    want = max(1.0, math.sqrt(sum(g * g for g in gaps)))
    assert one(M.slop(F.col("p").cast("array<array<int>>")), p=[list(x) for x in lists]) == pytest.approx(want)


def test_common_words_are_read_for_candidates_only(spark, index, monkeypatch):
    written = {}

    def keep(df, label):
        written[label] = materialize(df, label)
        return written[label]

    monkeypatch.setattr(M, "materialize", keep)
    assert urls(run(spark, index, "apples v6.2.8")) == ["2"]
    # one document holds the rare word; the common word's other documents are never grouped or written
    assert {r.doc_id for r in written["slot_documents"].select("doc_id").collect()} \
        == {r.doc_id for r in written["driving_documents"].select("doc_id").collect()}
    assert written["driving_documents"].count() == 1


def test_postings_scan_gets_the_terms(spark, index, capsys):
    slots = spark.createDataFrame([("q", SITE, 0, "must", "exact", "pear", "")],
                                  "qkey string, site string, slot int, occur string, kind string, text string, field string")
    asked = M.profile(slots)
    M.postings_of(M.slot_terms(slots, index, asked), index, asked).explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "In(term" in plan.replace("EqualTo(term", "In(term")


def test_terms_of_a_document_are_counted_in_its_row(spark):
    from pagesearch.config import SiteConfig
    from pagesearch.operators import postings as P

    config = SiteConfig("u", field_weights={"title": 10.0, "body": 1.5}, synonym_groups={"with": ("avec", "dans la")})
    docs = spark.createDataFrame([("u", "1", "cats", "avec cats ponies dans la avec", 0.5), ("u", "2", "bus", None, 1.0), ("u", "3", "", "", 1.0),
                                  ("u", "4", "b", "b", 1.0), ("u", "4", "c", "b", 1.0)], "site string, doc_id string, title string, body string, score double")
    rows = P.term_postings(docs, config)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("Window", "SortMergeJoin", "Generate"))     # tokens are never rows of their own before
    got = {}
    for r in rows.collect():
        got.setdefault(r.doc_id, []).append((r.term, r.wtf, r.max_wtf, r.doc_score, [(f.field, f.tf, f.positions) for f in r.fields]))
    assert sorted(got["1"]) == [
        ("+ cat", 11.5, 11.5, 0.5, [("title", 1, [0]), ("body", 1, [2])]), ("+ dan", 1.5, 11.5, 0.5, [("body", 1, [4])]), ("+ pony", 1.5, 11.5, 0.5, [("body", 1, [3])]),
        ("avec", 3.0, 11.5, 0.5, [("body", 2, [1, 6])]), ("cats", 11.5, 11.5, 0.5, [("title", 1, [0]), ("body", 1, [2])]),
        ("dans", 1.5, 11.5, 0.5, [("body", 1, [4])]), ("la", 1.5, 11.5, 0.5, [("body", 1, [5])]), ("ponies", 1.5, 11.5, 0.5, [("body", 1, [3])]),
        ("~ with", 4.5, 11.5, 0.5, [("body", 3, [1, 4, 6])])]
    assert got["2"] == [("bus", 10.0, 10.0, 1.0, [("title", 1, [0])])] and "3" not in got
    # copies of a key count together
    assert {(t, w, tuple(map(str, f))) for t, w, _, _, f in got["4"]} == {
        ("b", 13.0, ("('title', 1, [0])", "('body', 2, [1, 1])")), ("c", 10.0, ("('title', 1, [0])",))} and len(got["4"]) == 4


def test_postings_agree_with_stems_in_spark(spark):
    from pagesearch.functions.text import stem
    from pagesearch.operators.postings import _root

    words = ["as", "bus", "gas", "cats", "ponies", "eies", "aies", "movies", "heroes", "trees", "aes", "class", "ées", "xaies", "yeies", "boxes", "s", "𝒜𝒜s", "status"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", stem(F.col("w")).alias("r")).collect()
    assert all(_root(r.w) == r.r for r in got)


def test_stored_postings_are_made_where_documents_lie(spark, store):
    from pagesearch.operators import postings as Post

    config = SiteConfig("u", field_weights={"title": 10.0, "body": 1.5, "s": 1.0},
                        synonym_groups={"with": ("avec", "dans la"), "sea": ("cats", "dans la mer", "bus bus")})
    random, words = Random(7), ["avec", "dans", "la", "mer", "cats", "ponies", "bus", "été", "𝒜s", "the", "boxes"]
    text = lambda n: " ".join(random.choice(words) for _ in range(n))
    rows = [(f"u{n % 2}", f"{n}", text(n % 4), text(n % 50) if n % 7 else None, text(1), 1.0 / (1 + n % 3)) for n in range(450)]
    docs = spark.createDataFrame([*rows, ("u0", None, "la", "la", "", 1.0), ("u1", "none", None, "", "", 1.0)],
                                 "site string, doc_id string, title string, body string, s string, score double").coalesce(3)
    stored = Post.stored_postings(docs, config)
    assert "Exchange" not in stored._jdf.queryExecution().executedPlan().toString()     # no document is moved
    made = Post.read_postings(stored, list(config.field_weights), list(config.field_weights.values()))
    flat = lambda df: sorted(df.select("site", "doc_id", "term", F.round("wtf", 6), "max_wtf", "doc_score", F.to_json("fields")).collect(), key=str)
    assert made.schema.simpleString() == Post.term_postings(docs, config).schema.simpleString()
    assert flat(made) == flat(Post.term_postings(docs, config))
    store_path = f"{store.home}/postings"
    index_site.write_in_place(stored, store_path)
    for site in ("u0", "u1"):      # one file for each task, not one for each task and bucket; rows sorted by term
        files = [name for name in children(spark, f"{store_path}/site={site}") if name.endswith(".parquet")]
        assert 1 <= len(files) <= stored.rdd.getNumPartitions()
        for name in files:
            terms = [r.term for r in spark.read.parquet(f"{store_path}/site={site}/{name}").collect()]
            assert terms == sorted(terms)


def test_tokens_are_cut_by_whole_arrays_as_spark_cuts_them(spark):
    import pyarrow as pa

    from pagesearch.functions.text import all_tokens, tokens
    from pagesearch.operators import postings as Post

    random, signs = Random(11), "aB é𝒜İ_\t\n\x0b\x00\u00a0.,-'0 "
    texts = ["".join(random.choice(signs) for _ in range(random.randint(0, 14))) for _ in range(400)]
    texts += ["", "the", "by\\-nc the", "the\\\\ x", "a\\", "\\é the\\_", "2\\.0 of-the IN", None]
    docs = spark.createDataFrame([("u", str(i), t, t) for i, t in enumerate(texts)], "site string, doc_id string, title string, body string").coalesce(2)
    plain = docs.filter(~F.contains("body", F.lit("\\"))).select(F.lower("body").alias("low"), all_tokens(F.col("body")).alias("tokens")).collect()
    cell, found = Post.cut(pa.array([r.low for r in plain], pa.string()))
    assert list(zip(cell.tolist(), found.to_pylist())) == [(i, t) for i, r in enumerate(plain) for t in r.tokens]
    config = SiteConfig("u", field_weights={"title": 2.0, "body": 1.0})
    got = {}
    for r in Post.stored_postings(docs, config, with_site=False).collect():
        if not r.term.startswith(("+ ", "~ ")):
            for f, places in zip(r.fields, r.positions):
                got.update({(r.doc_id, f, p): r.term for p in places})
    want = {}
    for r in docs.select("doc_id", tokens(F.col("body")).alias("t")).collect():
        want.update({(r.doc_id, f, f * len(r.t) + p): t for f in (0, 1) for p, t in enumerate(r.t)})
    assert got == want and len(want) > 500


def test_postings_of_one_site_go_to_its_folder(spark, store, monkeypatch):
    written = []
    real = index_site.write_in_place
    monkeypatch.setattr(index_site, "write_in_place", lambda rows, path, site=None: (written.append((rows.columns, site)), real(rows, path, site)))
    reindex(page_rows(spark), CONFIG, store, buckets=4)
    assert written == [(["term", "doc_id", "doc_score", "max_wtf", "fields", "positions"], SITE)]
    assert {r.site for r in open_index(store, CONFIG).postings.select("site").distinct().collect()} == {SITE}


def test_corpus_pages_are_moved_before_they_are_split(spark):
    from pagesearch.plans.index_site import enrich
    from pagesearch.workload import corpus

    rows = [(n, f"Title {n}. more\nline cc by-nc {n}\n\nlast", f"src{n % 2}", "fr" if n % 3 else None, 1) for n in range(40)]
    rows += [rows[1], (1, "Other. text", "src1", "fr", 1), (50, None, "src9", "it", 0), (51, "", "src0", None, 0), (52, "x", None, None, 1)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    pages = corpus.corpus_pages(documents)
    want = enrich(corpus.split_documents(pages).unionByName(corpus.index_pages(pages)), corpus.CORPUS)
    placed = corpus.placed_corpus(documents, 5)
    got = placed.drop("doc_bucket").select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    wrong = placed.filter(F.col("doc_bucket") != doc_bucket(F.col("site"), F.col("doc_id"), 5))
    assert not wrong.head(1) and placed.select("doc_bucket").distinct().count() > 1
    # copies of a key meet where their pages lie: documents are not moved again
    once = upsert_latest(placed, ["page_id"], "doc_bucket", "doc_key")._jdf.queryExecution().executedPlan().toString()
    assert once.count("Exchange hashpartitioning(doc_bucket") == 1 and "hashpartitioning(doc_key" not in once


def test_fields_of_a_term_are_added_up_in_its_row(spark, index):
    from pagesearch.workload.corpus_checks import field_sums

    added = field_sums(index.postings)
    assert "Exchange" not in added._jdf.queryExecution().executedPlan().toString()
    want = index.postings.select("term", "doc_id", F.inline("fields")).groupBy("term", "doc_id").agg(F.round(F.sum("wtf"), 6).alias("wtf"))
    assert sorted(map(tuple, added.collect())) == sorted(map(tuple, want.collect()))
