import hashlib
import math
import random
import re

import pytest
import regex
from llm.fixtures import awkward, awkward_rows, prose
from pagesearch.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute(text):
    spans = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(part) > 255 for part in m[0].split(".")) \
                    or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) \
                    or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            spans.append(f"{kind}:{m.start()}:{m.end()}")
    return spans


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(11)
    parts = ["a", "b.c", "@", "x@y.z", "d@e", ".", "-", "_", "1", "23", "256", "1.2.3.4", "+", "+1 (2", "4111111111111111", " ", "(", "😀", "\n", "é", "%"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(1_500)]
    texts += ["a." * 3_000 + "@b." + "c." * 3_000 + "d", "1 " * 20_000, "x" * 30_000, "a@b.c_d@e.f 300.1.2.3.4 1.2.3.4.5.6.7.8",
              "1.1.1.1 " * 700, "4111-1111-1111-1111-0 4111 1111 1111 1111 41111111111111111111"]
    given = awkward_rows() + [(1000 + i, t, "en", "s", 0) for i, t in enumerate(texts)]
    out = pii.op10_pii(awkward(spark, given)).collect()
    assert len(out) == len(given)
    want = sorted((hashlib.sha256(",".join(s).encode()).hexdigest(), *(sum(x.startswith(k) for x in s) for k in PLAIN))
                  for s in (brute(t) for _, t, *_ in given))
    assert sorted((r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in out) == want
    by_id = {d: t for d, t, *_ in given if d is not None}
    for r in out:
        if r.doc_id in by_id and r.doc_id >= 1000:
            assert [s for s in r.spans.split(",") if s and not s.startswith("like_")] == brute(by_id[r.doc_id])


def contextual():
    """Addresses behind one phrase, and two in a form that the fixed patterns do not know."""
    rng = random.Random(12)
    rows = [(i, f"{prose(rng, 20)} reach me: user{i}@mail.example.org {prose(rng, 10)}", "en", "s", 0) for i in range(40)]
    rows += [(100, f"{prose(rng, 5)} reach me: user-at-77-mail {prose(rng, 5)}", "en", "s", 0)]
    rows += [(101, f"{prose(rng, 5)} see page 12345 {prose(rng, 5)}", "en", "s", 0)]
    # a phrase that mostly stands before other numbers is no pattern
    rows += [(200 + i, f"order number 99{i}77 shipped", "en", "s", 0) for i in range(30)] + [(300, "order number q@w.de shipped", "en", "s", 0)]
    return rows


def test_patterns_of_seeds_find_unseen_identifiers(spark):
    out = {r.doc_id: r.spans for r in pii.op10_pii(awkward(spark, contextual() + contextual())).collect()}
    text = {d: t for d, t, *_ in contextual()}
    start = text[100].index("user-at")
    assert out[100] == f"like_email:{start}:{start + len('user-at-77-mail')}"
    assert out[101] == "" and out[205] == "" and "like" not in out[300]


def test_redacted_documents_hold_no_base_spans(spark):
    docs = awkward(spark, awkward_rows() + contextual() + [(500, "+1 4111 1111 1111 1111 x@y.zz.10.0.0.1", "en", "s", 0)])
    red = pii.redact(docs)
    assert red.columns == docs.columns
    rows = red.collect()
    assert len(rows) == docs.count()
    assert not any(brute(r.text) for r in rows)
    assert any(r.text == "[PHONE] [EMAIL]" or "[CARD]" in (r.text or "") for r in rows if r.doc_id == 14 or r.doc_id == 500)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    untouched = {(r.doc_id, r.text) for r in rows if r.doc_id not in (14, 500)}
    assert {(d, t) for d, t, *_ in awkward_rows() if d != 14} <= untouched
    assert pii.redact(docs.limit(0)).count() == pii.op10_pii(docs.limit(0)).count() == 0


def test_found_instances_lead_to_patterns_without_seeds(spark):
    rng = random.Random(13)
    rows = [(i, f"{prose(rng, 8)} reach me: user{i}@mail.example.org {prose(rng, 8)}", "en", "s", 0) for i in range(200)]
    for i in range(30):
        rows += [(1000 + i, f"{prose(rng, 5)} reach me: user-at-{i}-mail {prose(rng, 5)}", "en", "s", 0),
                 (2000 + i, f"{prose(rng, 5)} write down user-at-{i}-mail {prose(rng, 5)}", "en", "s", 0)]
    # this one stands only where found instances stand
    rows += [(3000, f"{prose(rng, 5)} write down hidden-99-box {prose(rng, 5)}", "en", "s", 0)]
    spans = {r.doc_id: r.spans for r in pii.op10_pii(awkward(spark, rows)).collect()}
    start = rows[-1][1].index("hidden-99-box")
    assert spans[3000] == f"like_email:{start}:{start + len('hidden-99-box')}"


def test_context_holds_words_with_digits(spark):
    rng = random.Random(14)
    rows = [(i, f"{prose(rng, 8)} contact 12 box user{i}@mail.example.org {prose(rng, 8)}", "en", "s", 0) for i in range(40)]
    rows += [(100, f"{prose(rng, 5)} contact 12 box user-at-77-mail {prose(rng, 5)}", "en", "s", 0)]
    spans = {r.doc_id: r.spans for r in pii.op10_pii(awkward(spark, rows)).collect()}
    start = rows[-1][1].index("user-at")
    assert spans[100] == f"like_email:{start}:{start + len('user-at-77-mail')}"


def test_context_is_cut_by_position(spark):
    rng = random.Random(15)
    texts = ["".join(rng.choice(["ab ", "1", "x2@y.zz ", "😀", "\n", "é", "7 "]) for _ in range(n)) for n in (1, 20, 60, 61, 200, 700)]
    texts += ["1" * 64, "x" * 64 + " 12345 " + "y" * 130]
    for r in pii._found(awkward(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).collect():
        text = texts[r.doc_id]
        for s in [*r.base, *r.seeds, *r.words]:
            assert (s.value, s.left, s.right) == (text[s.start:s.end], text[max(0, s.start - 64):s.start], text[s.end:s.end + 64])


def plain_patterns(text, start, end):
    low = lambda part: re.sub("[A-Z]", lambda m: m[0].lower(), part)
    left = re.sub(r"""["'(\[{<]+\Z""", "", low(text[max(0, start - 64):start]))
    right = re.sub(r"""\A["')\]}>.,;:!?]+""", "", low(text[end:end + 64]))
    before, after = re.findall(r"[^ \t-\r]+", left), re.findall(r"[^ \t-\r]+", right)
    value, found = text[start:end], []
    if len(before) > 1:
        found.append(f"L {before[-2]} {before[-1]}")
    if before and after:
        found.append(f"B {before[-1]} {after[0]}")
    named = regex.search(r"""([\p{L}_][\p{L}\p{N}_-]*)["']?[ \t-\r]*([:=#]*)[ \t-\r]*\Z""", left)
    if named:
        found.append(f"W {named[1]}")
        if named[2]:
            found.append(f"P {named[1]} {named[2]}")
    classes = re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", value)))
    return found + [f"S x{len(value)}" if re.fullmatch("[0-9a-f]{16,}", value) else f"S {classes}"]


def plain_more(texts):
    """The spans beyond the base ones of each text, by a bootstrap in plain Python."""
    names = "|".join(pii.SEED_NAMES)
    seed = re.compile(rf"""(?i)(?<![a-z0-9])(?:{names})["']?\x20?[:=]\x20?["']?([^ \t-\r0-9"',;]*[0-9][^ \t-\r"',;]*)""")
    rows, entities, unknown = [], set(), set()
    for text in texts:
        base = [(pii.KINDS.index(k), int(s), int(e)) for k, s, e in (x.split(":") for x in brute(text))]
        apart = lambda s, e, taken: e - s >= 5 and not any(x < e and s < y for _, x, y in taken)
        seeds = [(4, m.start(1), m.end(1)) for m in seed.finditer(text) if apart(m.start(1), m.end(1), base)]
        words = []
        for m in re.finditer(r"(?<![^ \t-\r])[^ \t-\r0-9@]*[0-9@][^ \t-\r]*", text):
            s = m.start() + len(re.match(r"""["'(\[{<]*""", m[0])[0])
            e = s + len(re.sub(r"""["')\]}>.,;:!?]+\Z""", "", text[s:m.end()]))
            if apart(s, e, base + seeds):
                words.append((s, e))
        rows.append((text, seeds, words))
        entities |= {(p, text[s:e], k) for k, s, e in base + seeds for p in plain_patterns(text, s, e)}
        unknown |= {(p, text[s:e]) for s, e in words for p in plain_patterns(text, s, e)}
    scored = {x: 1.0 for x in entities}
    for number in range(pii.ROUNDS):
        mass, known, opened = {}, {}, {}
        for (p, _, k), score in scored.items():
            mass[p, k] = mass.get((p, k), 0) + score
        for p, v, _ in entities:
            known.setdefault(p, set()).add(v)
        for p, v in unknown:
            opened.setdefault(p, set()).add(v)
        size = {p: len(known.get(p, ())) + len(opened.get(p, ())) for p, _ in mass}
        patterns = {(p, k): m / (size[p] + pii.SMOOTHING) for (p, k), m in mass.items() if m / (size[p] + pii.SMOOTHING) >= pii.PATTERN_SCORE}
        if number + 1 == pii.ROUNDS:
            break
        doubt = {}
        for p, v in unknown:
            for k in range(5):
                if (p, k) in patterns:
                    doubt[v, k] = doubt.get((v, k), 0) + math.log(max(1 - patterns[p, k], 1e-12))
        instances = {x: 1 - math.exp(d) for x, d in doubt.items() if 1 - math.exp(d) >= pii.INSTANCE_SCORE}
        scored = {x: 1.0 for x in entities} | {(p, v, k): score for p, v in unknown for (w, k), score in instances.items() if w == v}
    out = []
    for text, seeds, words in rows:
        more = list(seeds)
        for s, e in words:
            best = max(((patterns[p, k], -k) for p in plain_patterns(text, s, e) for k in range(5) if (p, k) in patterns), default=None)
            if best:
                more.append((-best[1], s, e))
        out.append(sorted(more))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_bootstrap_equals_plain_python(spark, seed):
    rng = random.Random(seed)
    names, signs = ["token", "Password", "ssn", "clé", "ref", "iban", "call", "box"], [" = ", ": ", " ", "=", " #", ' = "', " ("]
    def value():
        return rng.choice([lambda: "".join(rng.choice("0123456789abcdef") for _ in range(20)), lambda: f"{rng.randint(100, 999)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
                           lambda: f"u{rng.randint(1, 99)}@mail{rng.randint(1, 3)}.example.org", lambda: f"AB{rng.randint(10000, 99999)}X", lambda: f"item{rng.randint(1, 30)}",
                           lambda: f"10.0.{rng.randint(0, 255)}.{rng.randint(0, 255)}", lambda: f"é{rng.randint(1000, 9999)}\".", lambda: "12"])()
    texts = [prose(rng, rng.randint(0, 2)) + " " + " ".join(f"{rng.choice(names)}{rng.choice(signs)}{value()}{rng.choice([' ', '.', ', ', chr(34), chr(10)])}"
             for _ in range(rng.randint(1, 3))) for _ in range(200)]
    # contexts that mostly hold entities, and contexts that found instances lead on to
    texts += [f"{prose(rng, 2)} {rng.choice(['write to: ', 'mail ('])}{rng.choice(['u%d@x%d.org', 'u%d@x%d.org', 'u%d@x%d.org', 'u-at-%d-x%d'])} {prose(rng, 1)}"
              % (rng.randint(1, 10 ** 6), rng.randint(1, 4)) for _ in range(200)]
    texts += [f"{prose(rng, 2)} reach u-at-{rng.randint(1, 40)}-x{rng.randint(1, 4)} {prose(rng, 1)}" for _ in range(20)]
    texts += ['token = "%040x"' % rng.getrandbits(160) for _ in range(30)] + ['jeton = "%040x" 77-12' % rng.getrandbits(160) for _ in range(3)]
    out = {r.doc_id: r for r in pii.op10_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    want, kinds = plain_more(texts), [f"like_{k}" for k in [*pii.KINDS, "secret"]]
    assert sum(map(len, want)) > 100 and any(k < 4 for more in want for k, _, _ in more)
    for i, text in enumerate(texts):
        base = brute(text)
        assert out[i].spans == ",".join(base + [f"{kinds[k]}:{s}:{e}" for k, s, e in want[i]]), text
        assert out[i].n_more == len(want[i]) and out[i].has_personal_data == bool(base or want[i])


def test_secrets_behind_names_and_their_contexts(spark):
    rng = random.Random(21)
    token = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'{prose(rng, 6)} token = "{token()}" {prose(rng, 6)}', "en", "s", 0) for i in range(40)]
    rows += [(100, f'{prose(rng, 6)} jeton = "{token()}" {prose(rng, 6)}', "en", "s", 0)]     # by its shape
    rows += [(200 + i, prose(rng, 12), "en", "s", 0) for i in range(40)]
    docs = awkward(spark, rows)
    out = {r.doc_id: r for r in pii.op10_pii(docs).collect()}
    assert all(out[i].spans.startswith("like_secret:") and out[i].n_more == 1 for i in [*range(40), 100])
    assert not any(out[200 + i].has_personal_data for i in range(40))
    text = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert all('token = "[SECRET]"' in text[i] for i in range(40)) and 'jeton = "[SECRET]"' in text[100]
