import re

from llm.fixtures import awkward, awkward_rows, prose
from pagesearch.llm import licenses

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return TOKEN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, templates, percent=licenses.PERCENT):
    w = words(text)
    places = [(i, label) for label, phrase in licenses.PHRASES.items() for p in [phrase.split()]
              for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    labels, share = {label for _, label in places}, 0.0
    for start in range(0, max(len(w) - licenses.STEP, 1), licenses.STEP):
        block = set(w[start:start + licenses.BLOCK])
        for label, template in templates:
            tokens = set(words(template))
            common = len(tokens & block)
            if tokens and 100 * common >= percent * len(tokens):
                labels.add(label)
                share = max(share, common / len(tokens))
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})), ",".join(sorted(labels)), 1.0 if places else share)


def rows():
    import random
    rng = random.Random(2)
    texts = ["MIT License mit-license Mit, LICENSE", "Apache License; version 2! cc by nc cc-by-nc", "mit licence éMIT license",
             "all rights\n\nreserved", "reserved all " + prose(rng, 70) + " rights"]
    for label, template in licenses.TEMPLATES:
        w = template.split()
        texts.append(prose(rng, rng.randint(0, 90)) + " " + template + " " + prose(rng, rng.randint(0, 90)))
        texts.append(prose(rng, 31) + " " + " ".join(w[::-1]) + " " + prose(rng, 40))
        texts.append(" ".join(w[:-1]))
        texts.append(" ".join(w[len(w) // 3:]) + " " + prose(rng, 5))
    return awkward_rows() + [(1000 + i, t, "en", "s", len(t)) for i, t in enumerate(texts)]


def test_scan_equals_brute_force(spark):
    given = rows()
    got = licenses.scan(awkward(spark, given)).collect()
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got), key=key) \
        == sorted(((d, *brute(t, licenses.TEMPLATES)) for d, t, *_ in given), key=key)
    assert {"gpl-3", "isc", "mpl-2"} <= {label for r in got for label in r.labels.split(",")}


def test_lower_threshold_and_own_templates(spark):
    given, own = rows(), [("x", "lantern river copper winter garden"), ("y", "gnu public license"), ("z", "")]
    table = licenses.template_table(spark, own)
    got = licenses.scan(awkward(spark, given), table, percent=60).collect()
    assert sorted((repr(r.doc_id), r.labels, r.score) for r in got) == sorted(
        (repr(d), *brute(t, own, 60)[5:]) for d, t, *_ in given)


def test_no_rows(spark):
    assert licenses.op1_license_scan(awkward(spark).limit(0)).count() == 0


def test_base_phrases_are_those_of_the_contract(spark):
    given = ["The MIT License", "Released UNDER the-MIT license, under the MIT License", "Apache License, Version 2.0", "cc-by-nc"]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.op1_license_scan(docs).collect()}
    assert got == {0: (3, 0, None, None, ""), 1: (9, 2, 1, 5, "mit"), 2: (5, 1, 0, 0, "apache-2"), 3: (3, 1, 0, 0, "cc-by-nc")}


def test_notices_of_the_mit_license_are_labelled_beside_the_base(spark):
    given = ["The MIT License", "MIT-license, under the MIT License", "license mit", None, "Apache License, Version 2.0 mit license"]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r.doc_id: (r.n_base, r.base_labels, r.labels, r.score, r.n_notices, r.first_notice, r.last_notice)
           for r in licenses.op1_license_scan(docs).collect()}
    assert got == {0: (0, "", "mit", 1.0, 1, 1, 1), 1: (1, "mit", "mit", 1.0, 2, 0, 4), 2: (0, "", "", 0.0, 0, None, None),
                   3: (0, "", "", 0.0, 0, None, None), 4: (1, "apache-2", "apache-2,mit", 1.0, 2, 0, 5)}


def test_the_sql_finds_the_notices(spark, tmp_path):
    from compare import difference
    from pagesearch.workload import Check
    import duckdb

    given = ["The MIT License", "MIT-license, under the MIT License", "license mit", None, "cc by nc", "Apache License, Version 2.0 mit license"]
    spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    check = Check(lambda s, d: licenses.op1_license_scan(s.read.parquet(f"{d}/documents.parquet")), licenses.SQL)
    assert difference(spark, str(tmp_path), check, connection) is None
