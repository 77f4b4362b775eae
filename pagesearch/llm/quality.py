"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per
rule; a policy is a versioned mask over those bits, so trying another policy, or leaving one rule out,
reads the slim ledger and never the texts again. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesearch.llm.common import SPACE, let, texts, total, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"

# Rule name and SQL condition over the measurements. The place in the list is the bit: append, never reorder.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "4 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("shouting", "2 * n_upper > word_chars"),
    ("exclamation", "2 * n_exclaim > n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("digits", "2 * n_digits > word_chars"),
]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim",
            "n_digits"]


@dataclass(frozen=True)
class Policy:
    """A version number and the rules whose failure rejects a document."""

    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << bit for bit, (name, _) in enumerate(RULES) if name in self.rules)


POLICIES = {
    1: Policy(1, ("few_words", "repeated_windows")),
    2: Policy(2, tuple(name for name, _ in RULES)),
}


def _kept_chars(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def _repeated(words: Column) -> Column:
    """How many words lie in windows of eight words that occur twice or more in the text."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)),
                          lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda x, k: F.coalesce(
            F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(starts, lambda p: total(F.transform(
            p, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - v, F.lit(WINDOW))).cast("long"))))

    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(F.size(words) > WINDOW, counted).otherwise(F.lit(0)).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements and ``fail_bits`` of every row of ``docs(doc_id, text)``.

    A null text counts as empty. Repeated rows and ids give one row each; other columns are ignored.
    Windows are compared by a 64-bit hash within one text. No rows give no rows.
    """
    return _measured(texts(docs), "doc_id")


def kept_documents(docs: DataFrame, policy: Policy | None = None) -> DataFrame:
    """The rows of ``docs`` that a policy (the newest by default) keeps, with all their columns and no others."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").cast("string"))
    judged = apply_policy(_measured(rows, "_row"), policy or POLICIES[max(POLICIES)])
    # a filter would be pushed below the measurements and take each of them once per rule
    return judged.select(F.explode(F.when(F.col("kept"), F.array("_row"))).alias("_row")).select("_row.*")


def _measured(rows: DataFrame, carried: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    split = rows.select(carried, text.alias("text"), words_of(text).alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(rf"[^{SPACE}]"))
    measured = split.select(
        carried,
        F.size("words").cast("long").alias("n_words"),
        _kept_chars(F.col("text"), rf"[{SPACE}]+").alias("word_chars"),
        _kept_chars(F.col("text"), r"[^#*$%&|<>]+").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("own"))).alias("_lines"),
        _repeated(F.col("words")).alias("n_repeat_words"),
        _kept_chars(F.col("text"), r"[^\p{Lu}]+").alias("n_upper"),
        _kept_chars(F.col("text"), r"[^!]+").alias("n_exclaim"),
        _kept_chars(F.col("text"), r"[^0-9]+").alias("n_digits"))
    measured = measured.withColumns({
        "n_lines": F.col("_lines.all").cast("long"),
        "n_dup_lines": (F.col("_lines.all") - F.col("_lines.own")).cast("long")})
    bits = sum((F.when(F.expr(rule), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, (_, rule) in enumerate(RULES)),
               F.lit(0))
    return measured.select(carried, *MEASURES, bits.cast("long").alias("fail_bits"))


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """Add ``kept`` and ``policy_version``; reads the bits only."""
    return rows.withColumns({"kept": F.col("fail_bits").bitwiseAND(policy.mask) == 0,
                             "policy_version": F.lit(policy.version)})


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """One row per rule of the policy: documents that fail it, that only it rejects, and kept without it.

    The ledger is first folded to one row per distinct bit pattern (at most 2 to the number of rules).
    """
    patterns = (rows.groupBy(F.col("fail_bits").bitwiseAND(policy.mask).alias("bits"))
                .agg(F.count(F.lit(1)).alias("docs")))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("long").alias("bit"))
                                for bit, (name, _) in enumerate(RULES) if name in policy.rules])).alias("r")
    failed = F.col("bits").bitwiseAND(F.col("r.bit"))
    return (patterns.select("bits", "docs", rules).groupBy("r.rule")
            .agg(F.sum(F.when(failed != 0, F.col("docs")).otherwise(0)).alias("failing"),
                 F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("docs")).otherwise(0)).alias("only_by_it"),
                 F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("r.bit")), F.col("docs")).otherwise(0))
                 .alias("kept_without")))


def op2_quality_rules(docs: DataFrame) -> DataFrame:
    base = F.col("fail_bits").bitwiseAND(POLICIES[1].mask) != 0
    return (apply_policy(ledger(docs), POLICIES[2])
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), "fail_bits", "policy_version"))


def _sql_bits() -> str:
    return " + ".join(f"CASE WHEN {rule} THEN {1 << bit} ELSE 0 END" for bit, (_, rule) in enumerate(RULES))


SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT rid, s, array_to_string(words[s:s + 7], ' ') AS gram
      FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS s FROM w WHERE len(words) >= 8)),
d AS (SELECT rid, s FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
r AS (SELECT rid, sum(least(8, coalesce(following - s, 8)))::BIGINT AS n_repeat_words
      FROM (SELECT rid, s, lead(s) OVER (PARTITION BY rid ORDER BY s) AS following FROM d) GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper,
             length(regexp_replace(text, '[^!]+', '', 'g'))::BIGINT AS n_exclaim,
             length(regexp_replace(text, '[^0-9]+', '', 'g'))::BIGINT AS n_digits
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, ({_sql_bits()})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits, 2 AS policy_version FROM b
"""
