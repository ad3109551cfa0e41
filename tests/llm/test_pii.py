import hashlib
import random
import re

from millrace.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), list(PLAIN).index(kind), m.end()))
    return sorted(out)


def test_base_spans_against_plain_patterns(spark):
    draw = random.Random(13)
    bits = ["a", "b.c", "@", "x@y.z", "_", ".", "-", " ", "+", "1", "12", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (415) 555-2671", "10.0.0.1", "1.2.3.4.5.6.7.8", "😀", "é", "\n", "é@b.c", "%", "00000001.2.3.4", "378282246310005"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 30))) for _ in range(600)]
    texts += [None, "", "a" * 60_000, "1" * 60_000, "1 " * 30_000, "+1" + "(" * 40_000, "1." * 2_000, "a.b@" * 2_000, "a@b.c_d@e.f"]
    rows = [(i if i else None, t, "x") for i, t in enumerate(texts)] + [(5, texts[5], "y")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, base string, spans int")
    out = pii.find_personal(docs).collect()
    got = sorted((repr(r.doc_id), [(s.start, s.kind, s.end) for s in r.base]) for r in out)
    assert got == sorted((repr(k), base(t)) for k, t, _ in rows)
    for r in out:
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans)) and [tuple(s) for s in r.spans] == sorted(map(tuple, r.spans))
    assert pii.find_personal(docs.filter("doc_id < 0")).collect() == []


def test_telling_terms(spark):
    """A name that only comes with one address tells of it; words that come everywhere do not."""
    draw = random.Random(14)
    common = ["please", "write", "today", "about", "thanks", "report"]
    rows = [(i, " ".join(draw.choice(common) for _ in range(12))) for i in range(300)]
    rows += [(300 + i, f"please write Marisol Quint at mq{i % 3}@corp.example about report") for i in range(3)]
    rows += [(310 + i, "thanks Zebedee mail zeb@corp.example please today") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: {rows_text(rows, r.doc_id)[s.start : s.end] for s in r.spans if s.kind == 4} for r in pii.find_personal(docs).collect()}
    assert out[310] == {"Zebedee", "mail"} and not out[0]
    assert not out[300] & set(common)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[310] == "thanks [term] [term] [email] please today" and clean[0] == rows[0][1]


def rows_text(rows, key):
    return dict(rows)[key]


def test_query_columns(spark, tmp_path):
    text = "mail a@b.co or +1 415 555 2671 or 10.0.0.1"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in pii.op6_pii(spark, str(tmp_path)).collect()}
    said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base(text))
    assert (out[1].n_email, out[1].n_ip, out[1].n_card, out[1].n_phone) == (1, 1, 0, 1)
    assert out[1].base_sha256 == hashlib.sha256(said.encode()).hexdigest() and out[1].spans == said
    assert out[2].base_sha256 == hashlib.sha256(b"").hexdigest() and out[2].spans == ""


def test_terms_wherever_they_stand(spark):
    """Far from the address, again further on, in a text without it, and of two letters."""
    draw = random.Random(17)
    common = ["please", "write", "today", "about", "thanks", "report", "to", "an"]
    filler = lambda n: " ".join(draw.choice(common) for _ in range(n))
    rows = [(i, filler(30)) for i in range(300)]
    rows += [(400 + i, f"Oz zeb@corp.example {filler(60)} Zebedee {filler(40)} zebedee, Oz") for i in range(12)]
    rows += [(500, f"{filler(9)} Zebedee {filler(9)}")]
    docs = spark.createDataFrame([*rows, rows[-1], rows[301]], "doc_id long, text string")
    for r in pii.find_personal(docs).collect():
        text = rows_text(rows, r.doc_id)
        want = [(m.start(), m.end()) for m in re.finditer(r"(?i)\b(zebedee|oz)\b", text)]
        assert [(s.start, s.end) for s in r.spans if s.kind == 4] == want
    assert not any(re.search("(?i)zebedee|oz", r.text) for r in pii.sanitise(docs).collect())
