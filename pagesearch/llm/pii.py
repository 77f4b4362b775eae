"""Personal data: fixed patterns, and bootstrapped contextual extraction of what they miss.

What the fixed patterns find are seed entities, and so is what stands behind the names of SEED_NAMES, given
lexical patterns for a fifth kind. The words around seeds and the shapes of their values are patterns; patterns and
instances (values that look like identifiers) form a graph. In each round a pattern's score is the score
mass of its distinct instances over their number, and an instance's score is the noisy-or of its patterns;
instances that pass become entities of the next round. Patterns that stay confident mark identifiers the
fixed patterns did not know. DataFrame functions only.

The expressions below find what the plain ones find (``[a-z]+@`` and so on), but try each run of characters
once: look-behinds and possessive repeats keep them linear and free of recursion on very long texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesearch.llm.common import SPACE, ascii_lower, let, spans_of, texts, total
from pagesearch.session import fits_broadcast, materialize

KINDS = ["email", "ip", "card", "phone"]
SECRET = len(KINDS)
# Names before "=" or ":" whose values are seed entities of the kind "secret", as patterns in lower case
SEED_NAMES = (
    "password", "passwd", "passphrase", "passcode", "pwd", "pin", "secret", "token", "credential",
    "(?:api|access|secret|private|account)[_ -]?key", "ssn", "social security(?: number)?", "passport(?: (?:no|number))?",
    "iban", "account(?: (?:no|number))?", "tax[_ -]?id",
)
_EMAIL = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_SEED = (rf"(?i)(?<![a-z0-9])(?:{'|'.join(SEED_NAMES)})[\"']?\x20?[:=]\x20?[\"']?"
         rf"([^{SPACE}0-9\"',;]*+[0-9][^{SPACE}\"',;]*+)")
_IDENTIFIER = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"

# quotes and brackets around a value, and the signs behind it
_OPENING, _CLOSING = r"""^["'(\[{<]+""", r"""["')\]}>.,;:!?]+\z"""
_OPEN_END, _CLOSED_START = r"""["'(\[{<]+\z""", r"""^["')\]}>.,;:!?]+"""
_NAMED = rf"""([\p{{L}}_][\p{{L}}\p{{N}}_-]*)["']?[{SPACE}]*([:=#]*)[{SPACE}]*\z"""

CONTEXT = 64            # characters on each side in which context words are looked for
ROUNDS = 3
SMOOTHING = 2.0         # added to a pattern's instances: one seed alone gives no confidence
PATTERN_SCORE = 0.6     # least score of a pattern that may pass scores on
INSTANCE_SCORE = 0.6    # least score of an instance that counts as an entity
LEAST_LENGTH = 5        # of an identifier found by context

_FRAMED = "array<struct<kind:int,start:int,end:int,value:string,left:string,right:string>>"


def _framed(text: Column, spans: Column) -> Column:
    """The spans with up to CONTEXT characters of the text before and after each, whatever stands there.

    The text is cut into pieces of CONTEXT characters once, so a span looks at two pieces on each side
    instead of counting characters from the start of the text.
    """
    def piece(pieces: Column, at: Column) -> Column:
        return F.coalesce(F.get(pieces, at.cast("int")), F.lit(""))

    def framed(pieces: Column) -> Column:
        def around(x: Column) -> Column:
            first, last = F.floor(x["start"] / CONTEXT), F.floor(x["end"] / CONTEXT)
            before = F.concat(piece(pieces, first - 1), F.left(piece(pieces, first), x["start"] % CONTEXT))
            after = F.concat(F.substr(piece(pieces, last), x["end"] % CONTEXT + 1), piece(pieces, last + 1))
            return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"),
                            F.right(before, F.lit(CONTEXT)).alias("left"), F.left(after, F.lit(CONTEXT)).alias("right"))
        return F.transform(spans, around)

    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CONTEXT}}}+"), F.lit(0))
    return F.when(F.size(spans) > 0, let(pieces, framed)).otherwise(F.array().cast(_FRAMED))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    def checked(digits: Column) -> Column:
        def weighed(i: Column) -> Column:
            digit = F.substring(digits, i + 1, 1).cast("int")
            twice = F.when(i % 2 == 1, digit * 2).otherwise(digit)
            return F.when(twice > 9, twice - 9).otherwise(twice).cast("long")
        return total(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), weighed)) % 10 == 0

    return let(F.reverse(_digits(value)), checked)


def base_spans(text: Column) -> Column:
    """All base spans of a text that is not null, by kind and place."""
    email = spans_of(text, _EMAIL, 0, text.contains("@"))
    ip = F.filter(spans_of(text, _IP, 1, text.rlike(r"[0-9]\.[0-9]")), lambda x: F.forall(
        F.split(x["value"], r"\."), lambda part: F.length(F.regexp_replace(part, "^0+", "")) <= 3) & F.forall(
        F.split(x["value"], r"\."), lambda part: F.expr("true") & (F.coalesce(
            F.substring(F.regexp_replace(part, "^0+", ""), 1, 4).try_cast("int"), F.lit(0)) <= 255)))
    card = F.filter(spans_of(text, _CARD, 2, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")), lambda x: _luhn(x["value"]))
    phone = F.filter(spans_of(text, _PHONE, 3, text.contains("+")),
                     lambda x: F.length(_digits(x["value"])).between(8, 15))
    return F.concat(email, ip, card, phone)


def _apart(spans: Column, taken: str) -> Column:
    """The spans of enough characters that overlap none of a column of spans."""
    return F.filter(spans, lambda w: (F.length(w["value"]) >= LEAST_LENGTH) & ~F.exists(
        taken, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))


def seed_spans(text: Column) -> Column:
    """What stands behind the names of SEED_NAMES, without the names."""
    def value_of(x: Column) -> Column:
        value = F.regexp_extract(x["value"], _SEED, 1)
        return F.struct(x["kind"].alias("kind"), (x["end"] - F.length(value)).alias("start"), x["end"].alias("end"), value.alias("value"))

    return F.transform(spans_of(text, _SEED, SECRET, text.rlike(_SEED)), value_of)


def _trimmed(words: Column) -> Column:
    """Words without the quotes and brackets around them and the signs that end a sentence."""
    def trimmed(x: Column) -> Column:
        before = F.length(F.regexp_extract(x["value"], _OPENING, 0))
        value = F.regexp_replace(F.substr(x["value"], before + 1), _CLOSING, "")
        return F.struct(x["kind"].alias("kind"), (x["start"] + before).alias("start"),
                        (x["start"] + before + F.length(value)).alias("end"), value.alias("value"))

    return F.transform(words, trimmed)


def _found(docs: DataFrame) -> DataFrame:
    """Per row: ids, base spans, seeds and the identifier-like words outside them; written, so that ids are fixed."""
    named = texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    based = named.withColumn("base", base_spans(F.col("text")))
    seeded = based.withColumn("seeds", _apart(seed_spans(F.col("text")), "base")).withColumn("taken", F.concat("base", "seeds"))
    words = _trimmed(spans_of(F.col("text"), _IDENTIFIER, -1, F.col("text").rlike("[0-9@]")))
    return materialize(seeded.withColumn("free", _apart(words, "taken")).select(F.monotonically_increasing_id().alias("row_id"), "doc_id",
                                    F.xxhash64("text").alias("text_a"), F.xxhash64(F.lit("b"), "text").alias("text_b"),
                                    _framed(F.col("text"), F.col("base")).alias("base"),
                                    _framed(F.col("text"), F.col("seeds")).alias("seeds"),
                                    _framed(F.col("text"), F.col("free")).alias("words")), "pii-found")


def _shape(value: Column) -> Column:
    """Digits and letters of a value by their classes; only the length of hexadecimal ones, which mix both at will."""
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[A-Z]", "A"), "[a-z]", "a")
    return F.when(value.rlike("^[0-9a-f]{16,}$"), F.concat(F.lit("x"), F.length(value).cast("string"))).otherwise(classes)


def _patterns(spans: DataFrame) -> DataFrame:
    """The patterns of each span, quotes and brackets around it left out.

    L: the two words before it. B: the words on both sides. W: the nearest word before it, behind which only signs
    may stand. P: that word and these signs. S: the shape of the value.
    """
    left = F.regexp_replace(ascii_lower(F.col("left")), _OPEN_END, "")
    right = F.regexp_replace(ascii_lower(F.col("right")), _CLOSED_START, "")
    before = F.regexp_extract_all(left, F.lit(rf"[^{SPACE}]+"), F.lit(0))
    after = F.regexp_extract_all(right, F.lit(rf"[^{SPACE}]+"), F.lit(0))
    sides = spans.withColumns({"_before": F.slice(F.reverse(before), 1, 2), "_after": F.slice(after, 1, 1),
                               "_word": F.regexp_extract(left, _NAMED, 1), "_sign": F.regexp_extract(left, _NAMED, 2)})
    keys = F.array(
        F.when(F.col("_word") != "", F.concat_ws(" ", F.lit("W"), "_word")),
        F.when((F.col("_word") != "") & (F.col("_sign") != ""), F.concat_ws(" ", F.lit("P"), "_word", "_sign")),
        F.concat(F.lit("S "), _shape(F.col("value"))),
        F.when(F.size("_before") == 2, F.concat_ws(" ", F.lit("L"), F.element_at("_before", 2), F.element_at("_before", 1))),
        F.when((F.size("_before") > 0) & (F.size("_after") > 0),
               F.concat_ws(" ", F.lit("B"), F.element_at("_before", 1), F.element_at("_after", 1))))
    return (sides.withColumn("pattern", F.explode(F.filter(keys, lambda k: k.isNotNull())))
            .drop("_before", "_after", "_word", "_sign", "left", "right"))


def bootstrap(found: DataFrame) -> DataFrame:
    """Confident patterns ``pattern, kind, score`` learnt from ``found(base, seeds, words)``.

    Only patterns that surround an entity of the round can score: seeds first, then also the instances that passed,
    with all their contexts. Each round's graph is cut down to those patterns. Copies of a text add nothing: edges
    are distinct pairs of pattern and value.
    """
    seeds = _patterns(found.select(F.explode(F.concat("base", "seeds")).alias("s")).select("s.kind", "s.value", "s.left", "s.right"))
    unknown = _patterns(found.select(F.explode("words").alias("s")).select("s.value", "s.left", "s.right"))
    unknown = materialize(unknown.select("pattern", "value").distinct(), "pii-unknown")
    entities = materialize(seeds.distinct().select("pattern", "value", "kind", F.lit(1.0).alias("score")), "pii-seeds")
    known = materialize(entities.groupBy("pattern").agg(F.countDistinct("value").alias("known")), "pii-known")
    scored = entities
    for number in range(ROUNDS):
        mass = materialize(scored.groupBy("pattern", "kind").agg(F.sum("score").alias("mass")), "pii-mass")
        around = mass.select("pattern").distinct()
        if fits_broadcast(around):
            around = F.broadcast(around)
        edges = materialize(unknown.join(around, "pattern", "left_semi"), "pii-edges")
        sizes = (edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("open")).join(known, "pattern", "full")
                 .select("pattern", (F.coalesce("known", F.lit(0)) + F.coalesce("open", F.lit(0))).alias("instances")))
        patterns = materialize(mass.join(sizes, "pattern").select(
            "pattern", "kind", (F.col("mass") / (F.col("instances") + SMOOTHING)).alias("score"))
            .where(F.col("score") >= PATTERN_SCORE), "pii-patterns")
        if number + 1 == ROUNDS:
            break
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-12)))))
        instances = materialize(edges.join(patterns, "pattern").groupBy("value", "kind").agg((1 - doubt).alias("score"))
                                .where(F.col("score") >= INSTANCE_SCORE), "pii-instances")
        if fits_broadcast(instances):
            instances = F.broadcast(instances)
        scored = entities.unionByName(unknown.join(instances, "value").select("pattern", "value", "kind", "score"))
    return patterns


def find_pii(docs: DataFrame) -> DataFrame:
    """``row_id, doc_id, text_a, text_b, base, more`` of every row of ``docs(doc_id, text)``.

    ``base`` and ``more`` are arrays of spans: those of the fixed patterns, and those found behind seed names and
    by context. A null text counts as empty; repeated rows each get their spans; no rows give no rows. A word found by
    several kinds of pattern takes the best score, then the first kind.
    """
    found = _found(docs)
    patterns = bootstrap(found)
    words = _patterns(found.select("row_id", F.explode("words").alias("s"))
                      .select("row_id", "s.start", "s.end", "s.value", "s.left", "s.right"))
    if fits_broadcast(patterns):
        patterns = F.broadcast(patterns)
    more = (words.join(patterns, "pattern").groupBy("row_id", "start", "end")
            .agg(F.max(F.struct("score", (-F.col("kind")).alias("order"))).alias("best"))
            .groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct(
                (-F.col("best.order")).cast("int").alias("kind"), "start", "end"))).alias("more")))
    def bare(spans: Column | str) -> Column:
        return F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    context = F.coalesce("more", F.array().cast("array<struct<kind:int,start:int,end:int>>"))
    return (found.join(more, "row_id", "left")
            .select("row_id", "doc_id", "text_a", "text_b", bare("base").alias("base"),
                    F.sort_array(F.concat(bare("seeds"), bare(context))).alias("more")))


def _written(spans: Column, prefix: str) -> Column:
    names = F.array(*[F.lit(prefix + kind) for kind in [*KINDS, "secret"]])
    return F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"]))


def op10_pii(docs: DataFrame) -> DataFrame:
    """``n_more`` counts the spans that the method adds; ``has_personal_data`` is true for any span."""
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    base, more = _written(F.col("base"), ""), _written(F.col("more"), "like_")
    return find_pii(docs).select("doc_id", *[count(k) for k in range(len(KINDS))],
                                 F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
                                 F.array_join(F.concat(base, more), ",").alias("spans"),
                                 F.size("more").cast("long").alias("n_more"),
                                 (F.size("base") + F.size("more") > 0).alias("has_personal_data"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; all other columns stay.

    Spans depend on the text alone, so they are joined back by the text's 128-bit hash: only texts with
    spans, sent to all executors when few and shuffled otherwise. ``n_chars`` follows the text where it exists.
    """
    spans = find_pii(docs).select("text_a", "text_b", F.concat("base", "more").alias("spans")).where(F.size("spans") > 0)
    spans = materialize(spans.groupBy("text_a", "text_b").agg(F.first("spans").alias("spans")), "pii-spans")
    if fits_broadcast(spans):
        spans = F.broadcast(spans)
    by_place = F.sort_array(F.transform("spans", lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def merge(merged: Column, x: Column) -> Column:
        last = F.element_at(merged, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"),
                         last["kind"].alias("kind"))
        overlaps = (F.size(merged) > 0) & F.coalesce(F.get(merged, F.size(merged) - 1)["end"] > x["start"], F.lit(False))
        return F.when(overlaps, F.concat(F.slice(merged, 1, F.size(merged) - 1), F.array(wider))).otherwise(
            F.concat(merged, F.array(x)))

    merged = F.aggregate(by_place, F.array().cast("array<struct<start:int,end:int,kind:int>>"), merge)
    names = F.array(*[F.lit(f"[{kind.upper()}]") for kind in [*KINDS, "secret"]])

    def rewritten(text: Column) -> Column:
        def built(m: Column) -> Column:
            pieces = F.transform(m, lambda x, i: F.concat(text.substr(
                F.coalesce(F.get(m, i - 1)["end"], F.lit(0)) + 1,
                x["start"] - F.coalesce(F.get(m, i - 1)["end"], F.lit(0))), F.get(names, x["kind"])))
            return F.concat(F.array_join(pieces, ""), text.substr(F.element_at(m, -1)["end"] + 1, F.length(text)))
        return let(merged, built)

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    text = F.coalesce(docs["text"], F.lit(""))
    joined = docs.select(row, F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit("b"), text).alias("text_b")).join(
        spans, ["text_a", "text_b"], "left")
    new = F.when(F.col("spans").isNotNull(), rewritten(F.col("_row.text"))).otherwise(F.col("_row.text"))
    renewed = joined.select("_row", new.alias("_text"))
    return renewed.select(*[
        F.col("_text").alias(c) if c == "text" else F.length("_text").cast(docs.schema[c].dataType).alias(c)
        if c == "n_chars" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
