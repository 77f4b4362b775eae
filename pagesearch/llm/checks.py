"""The operators' queries over the given tables, with their SQL where it can say them."""

from __future__ import annotations

from pagesearch.llm import (
    fingerprints, jaccard, licenses, mixing, packing, pii, quality, secret_scan, sharding, token_counts, toxicity, vector_codes, word_variants)
from pagesearch.workload import Check, table

CHECKS: dict[str, Check] = {
    "op2_quality_rules": Check(
        lambda spark, folder: quality.op2_quality_rules(table(spark, folder, "documents")), quality.SQL),
    "op9_ngram_jaccard": Check(
        lambda spark, folder: jaccard.jaccard_components(table(spark, folder, "documents")), jaccard.SQL),
    "op10_pii": Check(lambda spark, folder: pii.op10_pii(table(spark, folder, "documents"))),
    "op4_source_mixing": Check(lambda spark, folder: mixing.op4_source_mixing(table(spark, folder, "documents"))),
    "op3_bestfit_packing": Check(lambda spark, folder: packing.pack(table(spark, folder, "documents"))),
    "op1_license_scan": Check(lambda spark, folder: licenses.op1_license_scan(table(spark, folder, "documents")), licenses.SQL),
    "op5_lpt_sharding": Check(lambda spark, folder: sharding.op5_lpt_sharding(table(spark, folder, "documents"))),
    "op6_toxicity": Check(lambda spark, folder: toxicity.op6_toxicity(
        table(spark, folder, "documents"), table(spark, folder, "labels"))),
    "op7_edit_fingerprints": Check(
        lambda spark, folder: fingerprints.op7_edit_fingerprints(table(spark, folder, "documents"))),
    "op8_token_counts": Check(lambda spark, folder: token_counts.op8_token_counts(table(spark, folder, "documents"))),
    "op11_secret_scan": Check(lambda spark, folder: secret_scan.op11_secret_scan(table(spark, folder, "documents"))),
    "op12_vector_codes": Check(
        lambda spark, folder: vector_codes.op12_vector_codes(table(spark, folder, "embeddings")), vector_codes.SQL),
    "op13_word_variants": Check(
        lambda spark, folder: word_variants.op13_word_variants(table(spark, folder, "documents")), word_variants.SQL),
}
