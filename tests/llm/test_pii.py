import hashlib
import re

from pyspark.sql import functions as F

from notegraph.llm import pii

SPEC = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in SPEC.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    None,
    "",
    "mail a@b@c.de and x_y@z.org_q@r.st, .@a.b",
    "ips 1.2.3.4.5.6.7.8 256.1.1.1 0001.000000000000002.3.4 999.1.1.1.1",
    "é 4111 1111 1111 1111 and 4111-1111-1111-1112 +1 (244) 555-4688 +12",
    "𝒳𝒳 a@b.c 4785380592391139\n+49 30 1234567 5",
    "7" * 3000 + " " + "a" * 3000 + "@b.c",
    "a@b.c " * 700,
    "call me at (499) 555-6503 today, order no. 499-555-6503, her ssn is 123-45-6789.",
    "1.1.1.1 " * 20 + "+1.2.3.4.5.6.7.8.9",
]


def test_base_spans_match_brute_force(spark, docs_of):
    data = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs_of(list(enumerate(TEXTS))).select("doc_id", "text").union(data)
    got = {(r.doc_id, r.text): [(x.kind, x.start, x.end) for x in r.b] for r in docs.select("doc_id", "text", pii.base_spans(F.coalesce("text", F.lit(""))).alias("b")).collect()}
    assert got == {(i, t): brute(t) for i, t in got}
    assert sum(map(len, got.values())) > 50


def test_query_digest_and_added_spans(docs_of):
    rows = {r.doc_id: r for r in pii.digest(docs_of(list(enumerate(TEXTS)))).collect()}
    for i, text in enumerate(TEXTS):
        base = brute(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert rows[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(rows[i].spans.split(","))
    added = set(rows[8].spans.split(","))
    text = TEXTS[8]
    at = text.index("(499)")
    assert f"phone:{at}:{at + 14}" in added
    at = text.index("123-45")
    assert f"ssn:{at}:{at + 11}" in added
    assert not any(x.startswith(f"phone:{text.index('499-555')}:") for x in added)


def test_redact_keeps_columns(docs_of, spark):
    model = pii.fit(pii.labelled_findings(spark, 2000), pii.Boost())
    out = pii.redact(docs_of([(1, "é write a@b.cd or +1 (244) 555-4688."), (2, None), (3, "")]), model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id: r.text for r in out.collect()} == {1: "é write <EMAIL> or <PHONE>.", 2: None, 3: ""}


PROBES = [
    ("write to " + "a" * 80 + " (at) mail.org soon", "email", "a" * 80 + " (at) mail.org"),
    ("mail me: john dot smith at gmail dot com today", "email", "john dot smith at gmail dot com"),
    ("contact x[at]y-z.co.uk now", "email", "x[at]y-z.co.uk"),
    ("call me at 020 7946 0958 today", "phone", "020 7946 0958"),
    ("tel. 06 12 34 56 78 merci", "phone", "06 12 34 56 78"),
    ("her ssn is 123 45 6789 they say", "ssn", "123 45 6789"),
]
OTHERS = ["we look at home.page daily", "on 2024-01-15 it rained", "sizes 10 20 30 40 are sold", "order no. 499-555-6503", "ips 10.20.30.40", "so 1 2 3 at 4 5 6"]


def test_wide_forms_are_found_and_lookalikes_left(docs_of):
    rows = {r.doc_id: r for r in pii.digest(docs_of(list(enumerate([t for t, _, _ in PROBES] + OTHERS)))).collect()}
    for i, (text, kind, hit) in enumerate(PROBES):
        at = text.index(hit)
        assert f"{kind}:{at}:{at + len(hit)}" in rows[i].spans.split(","), (text, rows[i].spans)
    assert [OTHERS[i - len(PROBES)] for i in range(len(PROBES), len(PROBES) + len(OTHERS)) if rows[i].n_added] == []


def test_candidates_against_plain_patterns(spark, docs_of):
    import regex

    data = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs_of(list(enumerate([t for t, _, _ in PROBES] + OTHERS + TEXTS))).select("doc_id", "text").union(data)
    n = 0
    for r in docs.select("text", pii.candidates(F.coalesce("text", F.lit(""))).alias("c")).collect():
        want = [(kind, *m.span()) for kind, pattern, _ in pii.WIDER for m in regex.finditer(pattern, r.text or "") if kind != "phone" or 7 <= len(regex.sub("[^0-9]", "", m[0])) <= 12]
        assert [(x.kind, x.start, x.end) for x in r.c] == want
        n += len(want)
    assert n > 20


def test_thresholds_and_recall_on_held_out_findings(spark):
    b = pii.Boost()
    model = pii.fit(pii.labelled_findings(spark, b.findings), b)
    assert set(model[1]) >= {"phone", "ssn", "iban", "email"} and len(set(model[1].values())) > 1
    rows = pii.labelled_findings(spark, 3 * b.findings).where(F.substring("text", 18, 1) != " ").withColumn("i", F.monotonically_increasing_id()).where(f"i % 3 = 2")
    found = pii.find(rows, model, b=b)
    hit = F.exists("more", lambda x: x["kind"] == F.col("kind"))
    recall, wrong = found.agg(F.avg(F.when(F.col("label") == 1, hit.cast("double"))), F.avg(F.when(F.col("label") == 0, (F.size("more") > 0).cast("double")))).first()
    assert recall >= 0.9 and wrong <= 0.1, (recall, wrong, model[1])
