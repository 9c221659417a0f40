"""Personal data against a plain Python version."""

import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from strandlake.llm import personal
from strandlake.llm.queries import BASE_PERSONAL, _counted

TEXTS = [
    None, "", "no data", "mail a.b@c.de, x@y_z@q.org a@b.c_d@e.f user@host", "ip 10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 000255.1.2.3 99999999999.1.1.1 1.2.3",
    "4111 1111 1111 1111, 4111-1111-1111-1112 and 5500005555555559 12345678901234567890123 30569309025904", "+1 (974) 555-3436 +12 +49.30.1234567 +1-2 + 1 555 +123456789012345678",
    "é\U0001f600 +1 (017) 555-7713 é x@y.de", "1" * 3000, "a" * 30000, "1 " * 4000, "a.b@" * 300 + "c.d", "+1 2 3 4 5 6 7 8 9 0()", "x@a-b.c-d.e.f.", "١٢ ١.٢.٣.٤",
]


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def base(text):
    t = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t if len(t) < 20000 else t.replace("a", " "))]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def test_base_patterns(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "", 1), (None, TEXTS[3], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, EMAIL int")
    got = _counted(personal.scan_personal(df), BASE_PERSONAL, BASE_PERSONAL).collect()
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r.doc_id, r.spans) for r in got), key=key) == sorted(((d, joined(base(t))) for d, t, *_ in rows), key=key)
    for r in got:
        kinds = Counter(k for _, _, k, _ in base(dict((d, t) for d, t, *_ in rows)[r.doc_id]))
        assert [r[f"n_{k}"] for k in BASE_PERSONAL] == [kinds[k] for k in BASE_PERSONAL]
        assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    assert personal.scan_personal(df.limit(0)).collect() == []


def revealing(texts, reach, support, least):
    words = [list(re.finditer(r"[^\W\d_]{3,}", t)) for t in texts]
    n = Counter(m[0].lower() for x in words for m in x)
    k, places = Counter(), []
    for i, t in enumerate(texts):
        seen = set()
        for a, _, kind, b in base(t):
            low, high = max(0, a - reach), min(len(t), b + reach)
            for part, off, first, last in ((t[low:a], low, low > 0, False), (t[b:high], b, False, high < len(t))):
                for m in re.finditer(r"[^\W\d_]{3,}", part):
                    if not (first and m.start() == 0) and not (last and m.end() == len(part)):
                        seen.add((kind, m.start() + off, m.end() + off, m[0].lower()))
        places += [(i, *s) for s in seen]
    k.update((kind, term) for _, kind, _, _, term in places)
    total = sum(n.values())
    content = Counter()
    for (kind, _), c in k.items():
        content[kind] += c
    out = {(kind, t) for (kind, t), c in k.items() if c >= support and math.log2(c / n[t] * total / content[kind]) / math.log2(total / content[kind]) >= least}
    return {(i, a, b) for i, kind, a, b, term in places if (kind, term) in out}, out


def test_terms_against_counts(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 6)))
    texts = []
    for i in range(200):
        parts = [word() for _ in range(rng.randrange(20, 60))]
        if i % 3 == 0:
            parts.insert(rng.randrange(len(parts)), f"Kontaktadresse: {word()}@mail.example" if i % 2 else "dial +1 (974) 555-3436 weekdays")
        texts.append(" ".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, terms = revealing(texts, 60, 10, 0.9)
    got = personal.scan_personal(df, support=10).collect()
    assert {(r.doc_id, s.start, s.end) for r in got for s in r.spans if s.kind == "term"} == want
    assert ("email", "kontaktadresse") in terms and ("phone", "weekdays") in terms and len(terms) < 20
    clean = {r.doc_id: r.text for r in personal.sanitised(df, support=10).collect()}
    assert "Kontaktadresse" not in " ".join(clean.values()) and "@mail" not in " ".join(clean.values()) and "[EMAIL]" in " ".join(clean.values())
    assert clean[1] == texts[1]


def test_revealing_words_far_from_entities(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 6)))
    far = lambda: " ".join(word() for _ in range(40))
    texts = [f"{far()} Kontaktadresse: {word()}@mail.example {far()}" for _ in range(40)] + [far() for _ in range(160)]
    texts[0] += " kontaktadresse again"  # in a text with an entity, but out of reach
    texts[100] = f"KONTAKTADRESSE {texts[100]} Kontaktadresse."  # in a text without any
    texts[1] += " ask kontaktadresse@mail.example"  # within an entity
    _, terms = revealing(texts, 60, 30, 0.9)
    assert terms == {("email", "kontaktadresse")}
    want = {(i, m.start(), m.end()) for i, t in enumerate(texts) for m in re.finditer("kontaktadresse(?!@)", t, re.I)}
    df = spark.createDataFrame([*enumerate(texts), (None, texts[100]), (0, texts[0])], "doc_id long, text string")
    rows = personal.scan_personal(df).collect()
    assert len(rows) == 202 and {(r.doc_id, s.start, s.end) for r in rows if r.doc_id is not None for s in r.spans if s.kind == "term"} == want
    assert len([s for r in rows if r.doc_id is None for s in r.spans]) == 2 and all(set(r.disclosed) == {s.match.lower() for s in r.spans if s.kind == "term"} for r in rows)
    clean = [r.text.lower() for r in personal.sanitised(df).collect()]
    assert len(clean) == 202 and not any("kontaktadresse" in t for t in clean)


def test_patterns_are_linear(spark):
    df = spark.range(4).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.repeat(F.lit("a"), 200000), F.repeat(F.lit("1"), 200000), F.repeat(F.lit("+1"), 1000)).alias("text"))
    assert personal.scan_personal(df).count() == 4
