import re
from collections import Counter

from llm.fixtures import awkward, awkward_rows
from pagesearch.llm import quality


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_measures_equal_brute_force(spark):
    rows = awkward_rows() + [(200, "a b c d e f g h " * 3 + "a b c d e f g", "en", "s", 0), (201, "# $ |\n# $ |\n" * 9, "en", "s", 0)]
    got = quality.op2_quality_rules(awkward(spark, rows)).collect()
    assert len(got) == len(rows)
    measured = sorted(((r.doc_id or -1), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert measured == sorted(((d or -1), *brute(t)) for d, t, *_ in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_policies_and_ablation_read_the_bits_only(spark):
    ledger = quality.ledger(awkward(spark))
    bits = [r.fail_bits for r in ledger.collect()]
    for policy in quality.POLICIES.values():
        kept = quality.apply_policy(ledger, policy).where("kept").count()
        assert kept == sum(b & policy.mask == 0 for b in bits)
        for row in quality.ablation(ledger, policy).collect():
            bit = 1 << [name for name, _ in quality.RULES].index(row.rule)
            assert row.failing == sum(b & bit != 0 for b in bits)
            assert row.only_by_it == sum(b & policy.mask == bit for b in bits)
            assert row.kept_without == sum(b & policy.mask & ~bit == 0 for b in bits)


def test_kept_documents_keep_their_columns(spark):
    docs = awkward(spark)
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality.op2_quality_rules(docs).where("kept").count() > 0
    assert quality.kept_documents(docs.limit(0)).count() == quality.op2_quality_rules(docs.limit(0)).count() == 0
