"""Clashing column names, empty tables and very long texts of the native operators."""

import hashlib

from pyspark.sql import functions as F

from notegraph.llm import pii, quality_rules, secrets, text

GOOD = "This is a plain line of prose that ends well, with some words to spare."


def clash(docs):
    for name in ("found", "secrets", "base", "more", "spans", "judged", "_Found", "kept"):
        docs = docs.withColumn(name, F.lit(name.upper()))
    return docs


def test_clashing_names_and_empty_tables(spark, docs_of):
    trees = secrets.fit(secrets.labelled_findings(spark, 2000), secrets.Forest())
    model = pii.fit(pii.labelled_findings(spark, 2000), pii.Boost())
    docs = clash(docs_of([(1, GOOD + " Write to a@b.cd or use token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff."), (2, None), (3, "")]))
    for run in (lambda d: secrets.redact(d, trees), lambda d: pii.redact(d, model), quality_rules.keep_clean):
        out = run(docs)
        assert out.schema.names == docs.schema.names
        rows = {r.doc_id: r for r in out.collect()}
        assert rows[1].found == "FOUND" and rows[1].judged == "JUDGED" and rows[1]["_Found"] == "_FOUND"
        assert run(docs.where("false")).count() == 0
    assert "<SECRET>" in secrets.redact(docs, trees).where("doc_id = 1").first().text
    assert "<EMAIL>" in pii.redact(docs, model).where("doc_id = 1").first().text


def test_long_secrets_leave_nothing(spark, docs_of):
    trees = secrets.fit(secrets.labelled_findings(spark, 2000), secrets.Forest())
    long = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(160))
    token = "eyJhbGciOiJIUzI1NiJ9." + long[:400] + "." + long[400:443]
    pem = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{long[:32].upper()}\n\n{long[:64]}\n-----END RSA PRIVATE KEY-----"
    cut = "-----BEGIN PRIVATE KEY-----\n" + long[:64] + "\n" + long[64:128]
    rows = [(1, f"so the api_key: {long} is here"), (2, f"a token: {token} and"), (3, f"before {pem} after"), (4, f"bearer {token} here"), (5, f"x {cut}"), (6, (f"token = {long[:40]} " * 2000)), (7, "a-" * 60000), (1, f"so the api_key: {long} is here")]
    out = [(r.doc_id, r.text) for r in secrets.redact(docs_of(rows), trees).collect()]
    got = dict(out)
    assert got[1] == "so the api_key: <SECRET> is here" and len(out) == len(rows)
    assert got[2] == "a token: <SECRET> and" and got[3] == "before <SECRET> after"
    assert got[4] == "bearer <SECRET> here" and long[64:100] not in got[5]
    assert got[6] == "token = <SECRET> " * 2000 and got[7] == rows[6][1]


def test_clusters_against_a_plain_loop(spark):
    import random

    rng = random.Random(8)
    for n in (0, 1, 5, 700):
        items = sorted((a, a + rng.randrange(1, 9)) for a in (rng.randrange(4 * n + 1) for _ in range(n)))
        want = []
        for a, b in items:
            if want and a < max(y for _, y in want[-1]):
                want[-1].append((a, b))
            else:
                want.append([(a, b)])
        table = spark.createDataFrame([(items,)], "xs array<struct<start:int,end:int>>")
        got = [[tuple(x) for x in g] for g in table.select(text.clusters(F.col("xs")).alias("c")).first().c]
        assert [g for g in got if g] == want


def test_many_hits_in_one_text(spark, docs_of):
    model = pii.fit(pii.labelled_findings(spark, 2000), pii.Boost())
    row = "call me at (499) 555-6503, mail a@b.cd, ip 1.2.3.4; " * 1500
    out = pii.find(docs_of([(1, row)]).select("doc_id", "text"), model).selectExpr("size(base) b", "size(more) m").first()
    assert out.b == 3000 and out.m == 1500
