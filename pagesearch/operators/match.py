"""Query words against the postings: expansion, matching of all slots, scores.

A query is a list of *slots*. A slot holds one or more alternatives ``(kind, text, field)``; a
document fills the slot when it has any of them. ``occur`` says what a slot does: ``must`` slots
all have to be filled, ``should`` slots only add to the score, ``not`` slots exclude documents.

    slots  (qkey, site, slot, occur, kind, text, field)

Kinds: ``exact`` (token, stem or synonym), ``token`` (the token alone), ``prefix``, ``fuzzy``
(edit distance one) and ``phrase`` (consecutive words of one field). ``field`` is empty for any field.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pagesearch.config import SiteConfig
from pagesearch.functions.text import STEM_MARK, SYNONYM_MARK, stem
from pagesearch.operators.postings import plain, single_word_groups
from pagesearch.operators.skew import lookup_join, salted_join
from pagesearch.plans.index_site import SearchIndex, documents_of
from pagesearch.session import fits_broadcast, materialize

ALTERNATIVE = ["site", "kind", "text", "field"]
PUSHED_TERMS = 1_000


def exact_terms(text: Column, field: Column, config: SiteConfig) -> Column:
    """The index terms an exact word stands for."""
    root = stem(text)
    stemmed = ~field.isin(*config.no_stem_fields)
    terms = [text, F.when(stemmed, root), F.when(stemmed, F.concat(F.lit(STEM_MARK), root))]
    for group, words in single_word_groups(config):
        terms.append(F.when(text.isin(*words), F.lit(SYNONYM_MARK + group)))
    return F.array_distinct(F.filter(F.array(*terms), lambda t: t.isNotNull()))


@dataclass(frozen=True)
class SlotProfile:
    """What a batch of slots asks for: how many there are, and the word lengths of each kind."""

    total: int
    lengths: dict[str, list[int]]

    @property
    def fits(self) -> bool:
        """True when the slots, and up to four index terms of each, fit a broadcast."""
        return self.total <= 50_000


def profile(slots: DataFrame) -> SlotProfile:
    """One small job over the slots; its result has a row per kind and word length."""
    rows = slots.groupBy("kind", F.length("text").alias("n")).agg(F.count("*").alias("slots")).collect()
    lengths: dict[str, list[int]] = {}
    for row in rows:
        lengths.setdefault(row.kind, []).append(row.n)
    return SlotProfile(sum(row.slots for row in rows), {kind: sorted(ns) for kind, ns in lengths.items()})


def expand_prefixes(alternatives: DataFrame, terms: DataFrame, asked: SlotProfile) -> DataFrame:
    """Dictionary terms that start with a prefix, by an equi join on the leading characters."""
    heads = F.filter(F.array(*[F.lit(n) for n in asked.lengths["prefix"]]), lambda n: n <= F.length("term"))
    heads = F.transform(heads, lambda n: F.substring(F.col("term"), F.lit(1), n))
    keyed = terms.filter(plain(F.col("term"))).select("site", "term", "df", F.explode(heads).alias("text"))
    return lookup_join(keyed, alternatives, ["site", "text"], ["term"], fits=asked.fits) \
        .select(*ALTERNATIVE, "term", "df")


def _deletions(word: Column) -> Column:
    """The word itself and the word with any one character left out."""
    cut = F.transform(
        F.sequence(F.lit(1), F.length(word)),
        lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), cut))


def expand_fuzzy(alternatives: DataFrame, terms: DataFrame, asked: SlotProfile) -> DataFrame:
    """Dictionary terms within edit distance one: such words share a one-character deletion."""
    lengths = asked.lengths["fuzzy"]
    near = terms.filter(plain(F.col("term")) & F.length("term").between(max(lengths[0] - 1, 1), lengths[-1] + 1))
    keyed = near.select("site", "term", "df", F.explode(_deletions(F.col("term"))).alias("_cut"))
    wanted = alternatives.select(*ALTERNATIVE, F.explode(_deletions(F.col("text"))).alias("_cut"))
    close = lookup_join(keyed, wanted, ["site", "_cut"], ["term"])
    return close.filter(F.levenshtein("term", "text") <= 1).select(*ALTERNATIVE, "term", "df").distinct()


def slot_terms(slots: DataFrame, index: SearchIndex, asked: SlotProfile) -> DataFrame:
    """Rows ``(site, kind, text, field, term, df, idf)``: the index terms of each distinct alternative."""
    words = slots.select(*ALTERNATIVE).distinct()
    listed = F.when(F.col("kind") == "token", F.array("text")) \
        .otherwise(exact_terms(F.col("text"), F.col("field"), index.config))
    exact = words.filter(F.col("kind").isin("exact", "token")).withColumn("term", F.explode(listed))
    found = lookup_join(index.terms, exact, ["site", "term"], ["term"], fits=asked.fits).select(*ALTERNATIVE, "term", "df")
    if "prefix" in asked.lengths:
        prefixes = words.filter(F.col("kind") == "prefix")
        found = found.unionByName(expand_prefixes(prefixes, index.terms, asked))
    if "fuzzy" in asked.lengths:
        fuzzy = words.filter(F.col("kind") == "fuzzy")
        found = found.unionByName(expand_fuzzy(fuzzy, index.terms, asked))
    idf = F.log2(1 + (F.col("n_docs") + 1) / F.col("df"))
    return found.join(index.sites, "site").select(*ALTERNATIVE, "term", "df", idf.alias("idf"))


def postings_of(terms: DataFrame, index: SearchIndex, asked: SlotProfile) -> DataFrame:
    """The postings of the wanted terms.

    Up to ``PUSHED_TERMS`` terms are pushed to the scan: files are sorted by term, so other pages are skipped.
    More terms than a broadcast holds are joined salted by document, so the postings of one hot term
    are spread over tasks.
    """
    open_ended = {"prefix", "fuzzy"} & set(asked.lengths)
    small = asked.fits and (not open_ended or fits_broadcast(terms))
    if not small:
        return salted_join(index.postings, terms, ["site", "term"], ["doc_id"])
    rows = index.postings
    if index.doc_buckets is not None:
        named = terms.select("term").distinct().take(PUSHED_TERMS + 1)
        if len(named) <= PUSHED_TERMS:
            rows = rows.filter(F.col("term").isin([row[0] for row in named]))
    return rows.join(F.broadcast(terms), ["site", "term"])


def _in_field(value: Column) -> Column:
    """The nested field entries an alternative may use."""
    return F.filter("fields", lambda f: (value == "") | (f["field"] == value))


def _only(hit: DataFrame, candidates: DataFrame | None) -> DataFrame:
    """Postings of candidate documents ``(site, doc_id)``, or all."""
    if candidates is None:
        return hit
    if fits_broadcast(candidates):
        candidates = F.broadcast(candidates)
    return hit.join(candidates, ["site", "doc_id"], "left_semi")


def word_documents(terms: DataFrame, index: SearchIndex, asked: SlotProfile,
                   candidates: DataFrame | None = None) -> DataFrame:
    """Rows ``(site, kind, text, field, doc_id, doc_score, part, positions)``: one per alternative and document."""
    hit = _only(postings_of(terms, index, asked), candidates)
    used = hit.withColumn("_used", _in_field(F.col("field"))).filter(F.size("_used") > 0)
    wtf = F.aggregate("_used", F.lit(0.0), lambda total, f: total + f["wtf"])
    positions = F.flatten(F.transform("_used", lambda f: f["positions"]))
    rows = used.select(*ALTERNATIVE, "doc_id", "doc_score",
                       (wtf / F.col("max_wtf") * F.col("idf")).alias("part"), positions.alias("positions"))
    return rows.groupBy(*ALTERNATIVE, "doc_id", "doc_score").agg(
        F.sum("part").alias("part"), F.flatten(F.collect_list("positions")).alias("positions"))


def phrase_documents(slots: DataFrame, index: SearchIndex, asked: SlotProfile,
                     candidates: DataFrame | None = None) -> DataFrame:
    """Like ``word_documents`` for phrases: words at consecutive positions of one field."""
    phrases = slots.filter(F.col("kind") == "phrase").select(*ALTERNATIVE).distinct() \
        .withColumn("words", F.split("text", " ")).withColumn("n_words", F.size("words"))
    words = phrases.select(*ALTERNATIVE, "n_words", F.posexplode("words").alias("at", "term"))
    known = lookup_join(index.terms, words, ["site", "term"], ["term"]).join(index.sites, "site") \
        .withColumn("idf", F.log2(1 + (F.col("n_docs") + 1) / F.col("df")))
    hit = _only(postings_of(known, index, SlotProfile(asked.total, {"phrase": asked.lengths["phrase"]})), candidates)
    shifted = hit.select(
        *ALTERNATIVE, "n_words", "at", "doc_id", "doc_score", (F.col("idf") / F.col("max_wtf")).alias("unit"),
        F.inline(_in_field(F.col("field")).alias("used")).alias("in_field", "tf", "wtf", "positions")) \
        .withColumn("starts", F.transform("positions", lambda p: p - F.col("at")))
    per_field = shifted.groupBy(*ALTERNATIVE, "n_words", "doc_id", "doc_score", "in_field").agg(
        F.count("*").alias("n_found"), F.sum(F.col("unit") * F.col("wtf")).alias("part"),
        F.collect_list("starts").alias("starts"))
    complete = per_field.filter(F.col("n_found") == F.col("n_words"))
    common = F.reduce(F.slice("starts", F.lit(2), F.size("starts")), F.get("starts", F.lit(0)), F.array_intersect)
    matched = complete.withColumn("positions", common).filter(F.size("positions") > 0)
    return matched.groupBy(*ALTERNATIVE, "doc_id", "doc_score").agg(
        F.sum("part").alias("part"), F.flatten(F.collect_list("positions")).alias("positions"))


def nearest_gap(left: Column, right: Column) -> Column:
    """Smallest distance between two position lists, by one pass over both in order."""
    tagged = F.array_sort(F.concat(
        F.transform(left, lambda p: F.struct(p.alias("p"), F.lit(0).alias("side"))),
        F.transform(right, lambda p: F.struct(p.alias("p"), F.lit(1).alias("side")))))
    nothing = F.lit(None).cast("int")
    start = F.struct(nothing.alias("l"), nothing.alias("r"), nothing.alias("best"))
    step = lambda seen, x: F.struct(
        F.when(x["side"] == 0, x["p"]).otherwise(seen["l"]).alias("l"),
        F.when(x["side"] == 1, x["p"]).otherwise(seen["r"]).alias("r"),
        F.least(seen["best"], x["p"] - F.when(x["side"] == 0, seen["r"]).otherwise(seen["l"])).alias("best"))
    return F.aggregate(tagged, start, step, lambda seen: seen["best"])


def slop(ordered: Column) -> Column:
    """Root of the summed squared gaps between neighbouring slots, at least one.

    ``ordered`` holds the position list of each required slot in query order.
    """
    gaps = F.transform(
        F.when(F.size(ordered) > 1, F.sequence(F.lit(1), F.size(ordered) - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: nearest_gap(F.get(ordered, i - 1), F.get(ordered, i)).cast("double"))
    squares = F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap * gap)
    return F.greatest(F.sqrt(squares), F.lit(1.0))


def match(slots: DataFrame, index: SearchIndex) -> DataFrame:
    """Rows ``(qkey, site, doc_id, doc_score, base, slop)`` of the documents that fill every must slot.

    The must slot whose terms have the fewest documents drives, as the dictionary says before any
    postings are read: only its documents become candidates. The postings of the other slots are cut
    down to candidate documents as they are read, before they are grouped, so a term that a third of
    all documents hold costs little beside a rare one. ``slots`` should be a stored table.
    """
    asked = profile(slots)
    terms = materialize(slot_terms(slots, index, asked), "slot_terms")
    must = slots.filter(F.col("occur") == "must")
    sizes = terms.groupBy(*ALTERNATIVE).agg(F.sum("df").alias("df"))
    # the size of a phrase is not known from the dictionary, so any other slot is preferred
    size = F.when(F.col("kind") == "phrase", F.lit(float("inf"))).otherwise(F.coalesce("df", F.lit(0)).cast("double"))
    per_slot = must.join(sizes, ALTERNATIVE, "left").groupBy("qkey", "slot").agg(F.sum(size).alias("df"))
    drivers = per_slot.groupBy("qkey").agg(
        F.min(F.struct("df", "slot")).alias("least"), F.count("*").alias("n_must")) \
        .select("qkey", F.col("least.slot").alias("driver"), "n_must")
    planned = materialize(
        slots.join(drivers, "qkey").withColumn("drives", F.col("slot") == F.col("driver")).drop("driver"), "planned")

    def documents(part: DataFrame, candidates: DataFrame | None) -> DataFrame:
        """The matches of the alternatives of some slots, in all documents or in the candidates."""
        own = part.select(*ALTERNATIVE).distinct()
        found = word_documents(terms.join(own, ALTERNATIVE, "left_semi"), index, asked, candidates)
        if "phrase" in asked.lengths:
            found = found.unionByName(phrase_documents(part, index, asked, candidates))
        return found

    columns = ["qkey", "site", "doc_id", "doc_score", "n_must", "slot", "occur", "part", "positions"]
    leading, others = planned.filter("drives").drop("drives"), planned.filter(~F.col("drives")).drop("drives")
    led = materialize(lookup_join(documents(leading, None), leading, ALTERNATIVE, ["doc_id"], fits=asked.fits)
                      .select(*columns), "driving_documents")
    hits = led
    if others.head(1):
        candidates = materialize(led.select("site", "doc_id").distinct(), "candidates")
        found = materialize(documents(others, candidates), "slot_documents")
        wanted = lookup_join(led.select("qkey", "site", "doc_id").distinct(), others, ["qkey", "site"], ["doc_id"],
                             fits=asked.fits)
        hits = led.unionByName(wanted.join(found, [*ALTERNATIVE, "doc_id"]).select(*columns))
    per_slot_hit = hits.groupBy(
        "qkey", "site", "doc_id", "doc_score", "n_must", "slot", "occur").agg(
        F.sum("part").alias("part"), F.flatten(F.collect_list("positions")).alias("positions"))
    is_must = F.col("occur") == "must"
    filled = per_slot_hit.groupBy("qkey", "site", "doc_id", "doc_score", "n_must").agg(
        F.count(F.when(is_must, 1)).alias("n_filled"),
        F.count(F.when(F.col("occur") == "not", 1)).alias("n_banned"),
        F.sum(F.when(F.col("occur") != "not", F.col("part"))).alias("sum_part"),
        F.array_sort(F.collect_list(F.when(is_must, F.struct("slot", "positions")))).alias("placed"))
    whole = filled.filter((F.col("n_filled") == F.col("n_must")) & (F.col("n_banned") == 0))
    gap = slop(F.transform("placed", lambda p: p["positions"]))
    return whole.select("qkey", "site", "doc_id", "doc_score", (F.col("sum_part") / gap).alias("base"), gap.alias("slop"))


def _section_words(sections: DataFrame, index: SearchIndex) -> tuple[DataFrame, DataFrame, SlotProfile]:
    """The distinct words of each query's section, their index terms, and how many there are."""
    needed = sections.withColumn("section_tokens", F.array_distinct("section_tokens")) \
        .withColumn("n_words", F.size("section_tokens"))
    words = needed.select("qkey", "site", "n_words", F.explode("section_tokens").alias("term"))
    slots = words.select("site", F.lit("token").alias("kind"), F.col("term").alias("text"), F.lit("s").alias("field"))
    profiled = profile(slots)
    return words, materialize(slot_terms(slots, index, profiled), "section_terms"), profiled


def section_documents(sections: DataFrame, index: SearchIndex) -> DataFrame:
    """Rows ``(qkey, site, doc_id, doc_score, base, section_part)``: every document of each section, as a star query finds it."""
    words, terms, profiled = _section_words(sections, index)
    found = word_documents(terms, index, profiled).select("site", F.col("text").alias("term"), "doc_id", "doc_score", "part")
    asked = lookup_join(found, words, ["site", "term"], ["doc_id"], fits=profiled.fits)
    whole = asked.groupBy("qkey", "site", "doc_id", "doc_score", "n_words").agg(
        F.count("*").alias("n_found"), F.sum("part").alias("section_part")).filter("n_found = n_words")
    return whole.withColumn("base", F.lit(1.0)).drop("n_words", "n_found")


def section_scores(hits: DataFrame, sections: DataFrame, index: SearchIndex) -> DataFrame:
    """Add ``section_part``: the score of ``@s:section`` where the document is in the query's section.

    ``sections`` has rows ``(qkey, site, section_tokens)``; all tokens have to be in the field. Only the
    postings of hits are read further than their ids. ``hits`` should be a stored table.
    """
    words, terms, profiled = _section_words(sections, index)
    candidates = lookup_join(hits.select("qkey", "site", "doc_id"), sections.select("qkey"), ["qkey"], ["doc_id"]) \
        .select("site", "doc_id").distinct()
    found = word_documents(terms, index, profiled, materialize(candidates, "section_candidates")) \
        .select("site", F.col("text").alias("term"), "doc_id", "part")
    asked = lookup_join(hits.select("qkey", "site", "doc_id"), words, ["qkey", "site"], ["doc_id"], fits=profiled.fits)
    whole = asked.join(found, ["site", "term", "doc_id"]).groupBy("qkey", "doc_id", "n_words").agg(
        F.count("*").alias("n_found"), F.sum("part").alias("section_part")).filter("n_found = n_words")
    return hits.join(whole.select("qkey", "doc_id", "section_part"), ["qkey", "doc_id"], "left")


def tagged(tags: DataFrame, index: SearchIndex, *columns: str) -> DataFrame:
    """The documents that carry exactly the tags ``tags(site, doc_id)``, each once, with columns of theirs."""
    return documents_of(tags.select("site", "doc_id").distinct(), index, *columns)
