import hashlib
import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import privacy, queries

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
    return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m[0])]


TEXTS = [
    "a@b.c", "a@b.c_d@e.f", "x a@b@c.d. y", ".%+-@a-b.c-d.", "a@b..c", "é@b.c 日x@y.zz", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.2.3 256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111",
    "0445617099674829 and 5500005555555559", "+1 (377) 555-0271", "+12345678", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+49 151 23456789.", "1" * 40, "a" * 3000, "1 " * 3000, "1." * 3000 + "1", "\U0001f600 a@b.c \U0001f600 1.1.1.1", "++1 555 555 5555", "", "x\ny@z.w\n",
]


def check(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = privacy.base(docs).select("row.doc_id", privacy.listing(privacy.base_places(F.col("found"))).alias("s")).collect()
    for r in got:
        assert r.s == ",".join(base(texts[r.doc_id])), texts[r.doc_id][:80]


def test_base_patterns(spark):
    check(spark, TEXTS)


def test_many_texts(spark):
    texts: list[str] = []

    @settings(max_examples=400, deadline=None, database=None)
    @given(st.text(st.sampled_from("ab.@1 +2-(59)_日\U0001f600\n"), max_size=60))
    def gather(t):
        texts.append(t)

    gather()
    check(spark, texts)


def brute_terms(texts, alpha=privacy.ALPHA, near_alpha=privacy.NEAR_ALPHA):
    """(start, end) of the disclosing terms of each text, from the definitions."""
    word = re.compile(r"[^\W\d_]{3,}")
    group = {"email": lambda v: v.rpartition("@")[2], "ip": lambda v: v.rpartition(".")[0], "card": lambda v: v[:6], "phone": lambda v: v[:4]}
    docs = []
    for text in texts:
        text = text or ""
        rest, held, near = list(text), set(), {}
        spans = [(x.split(":")[0], *map(int, x.split(":")[1:])) for x in base(text)]
        for _, a, b in spans:
            rest[a:b] = " " * (b - a)
        rest = "".join(rest)
        for kind, a, b in spans:
            value = {"email": str.lower, "ip": str}.get(kind, lambda v: re.sub("[^0-9]", "", v))(text[a:b])
            left, right = rest[max(0, a - privacy.CONTEXT) : a], rest[b : b + privacy.CONTEXT]
            left = re.sub(r"^[^\W\d_]+", "", left) if a > privacy.CONTEXT else left
            right = re.sub(r"[^\W\d_]+$", "", right) if len(rest) - b > privacy.CONTEXT else right
            for entity in (f"{kind}:{value}", f"{kind}/{group[kind](value)}", kind):
                held.add(entity)
                near.setdefault(entity, set()).update(w.lower() for w in word.findall(left) + word.findall(right))
        docs.append((rest, held, near, {w.lower() for w in word.findall(rest)}))
    n_term, n_entity = Counter(w for d in docs for w in d[3]), Counter(e for d in docs for e in d[1])
    beside = Counter((e, w) for d in docs for e, ws in d[2].items() for w in ws)
    both = Counter((e, w) for d in docs for e in d[1] for w in d[3])
    flagged = set()
    for (e, w), n in both.items():
        ic, few = math.log(len(docs) / n_entity[e]), min(n_term[w], n_entity[e])
        pmi = lambda k: math.log(k * len(docs) / (n_term[w] * n_entity[e]))  # noqa: B023, E731
        anywhere = n >= privacy.least_support(alpha) and pmi(n) * n / (n + 1) * few / (few + 1) >= ic / alpha
        if ic > 0 and (anywhere or beside[e, w] and pmi(beside[e, w]) >= ic / near_alpha):
            flagged.add((e, w))
    return [[(m.start(), m.end()) for m in word.finditer(d[0]) if any((e, m[0].lower()) in flagged for e in d[1])] for d in docs]


def found_terms(spark, texts, **options):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"found": F.lit("clash"), "terms": F.lit(1), "key": F.lit(2), "rest": F.lit("x")})
    got = {r.row.doc_id: [(t.start, t.end) for t in r.terms] for r in privacy.spans(docs, **options).collect()}
    return [got[i] for i in range(len(texts))]


def test_disclosing_terms(spark):
    far = "padding of plain words " * 12
    texts = [f"filler{chr(97 + i)} words of Bluebird, who said: mail x@y.org about it. {far} Thunderhill." for i in range(4)]
    texts += [f"common words about it now and then number{chr(97 + i)} of plain padding nothing who said mail write" for i in range(40)]
    texts += ["Bluebird", None, "", "write to Quixoticus at one@two.net", "+1 (913) 555-3797, 9.8.7.6"]
    got = found_terms(spark, texts)
    assert got == brute_terms(texts)
    marked = [{texts[i][a:b] for a, b in spans} for i, spans in enumerate(got)]
    assert all({"Bluebird", "Thunderhill"} <= m and "words" not in m for m in marked[:4])  # beside the address, and far from it
    assert marked[47] == {"Quixoticus"} and not any(marked[4:47]) and not marked[48]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in privacy.sanitise(docs).collect()}
    assert clean[47] == "write to [TERM] at [EMAIL]" and clean[48] == "[PHONE], [IP]" and clean[44] == "Bluebird"
    assert clean[45] is None and clean[46] == "" and clean[12] == texts[12]
    assert privacy.sanitise(docs).columns == docs.columns and len(clean) == len(texts)


def test_terms_against_brute_force(spark):
    r = random.Random(5)
    words = [a + b + c for a in "bdgk" for b in "aeio" for c in ("rn", "st", "m\u00fcl", "x")]
    pii = [f"u{i}@d{i % 3}.org" for i in range(6)] + [f"10.0.{i}.1" for i in range(3)] + ["+49 151 2345678"]
    texts = []
    for _ in range(150):
        text = r.choices(words, k=r.randint(0, 60))
        for _ in range(r.choice([0, 0, 0, 1, 1, 3])):
            at, value = r.randint(0, len(text)), r.choice(pii)
            text[at:at] = [value] if r.random() < 0.5 else [value, "Contact" + value[:2].strip("+1u") + ","]
        texts.append(" ".join(text))
    texts += texts[:30]  # copies
    for options in ({}, {"alpha": 1.2, "near_alpha": 1.01}, {"alpha": 4.0, "near_alpha": 2.0}):
        got = found_terms(spark, texts, **options)
        assert got == brute_terms(texts, **options)
    assert any(got)


def test_many_matches_in_one_text(spark):
    text = " ".join(f"name{chr(97 + i % 26)} u{i}@h{i % 50}.org" for i in range(5_000))
    row = privacy.spans(spark.createDataFrame([(1, text), (2, "\U0001f600" * 5_000 + " a@b.c " + "z" * 5_000 + " 1.2.3.4")], "doc_id long, text string")).orderBy("row.doc_id").collect()
    assert [(m.start, m.end) for m in row[0].found.email] == [m.span() for m in re.finditer(r"u\d+@h\d+\.org", text)]
    clean = privacy.sanitise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert clean.count("[EMAIL]") == 5_000 and "@" not in clean
    assert [(m.start, m.end) for m in row[1].found.ip] == [(10_008, 10_015)]


def test_sanitised_text(spark):
    rows = [(0, "call +49 151 23456789, 4111 1111 1111 1111 or a@b.c"), (1, "nothing"), (2, "1.2.3.4"), (3, "call"), (4, "call"), (5, "call")]
    got = {r.doc_id: r.text for r in privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "nothing" and got[2] == "[IP]" and got[0].startswith("call [PHONE]") and got[0].endswith("or [EMAIL]")


def test_query(spark, tmp_path):
    rows = [*enumerate(TEXTS), (99, None), (100, TEXTS[0]), (100, TEXTS[0])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_privacy(spark, str(tmp_path)).collect()
    want = Counter((i, hashlib.sha256(",".join(base(t or "")).encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    for r in got:
        assert r.spans.startswith(",".join(base(dict(rows)[r.doc_id] or "")))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op9_privacy(spark, f"{tmp_path}/none").collect() == []


if __name__ == "__main__":
    pytest.main([__file__])
