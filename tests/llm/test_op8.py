import hashlib
import re

from mnemospark.llm import op8_pii as op

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    v = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 * (x > 9) for x in v) % 10 == 0


def ok(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base(text):
    found = [(m.start(), k, m.end(), kind) for k, kind in enumerate(op.BASE) for m in re.finditer(PLAIN[kind], text or "") if ok(kind, m[0])]
    return sorted(found)


def check(rows, got):
    want = []
    for d, t in rows:
        b = base(t)
        said = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in b)
        want.append((d, *[sum(x[3] == k for x in b) for k in op.BASE], hashlib.sha256(said.encode()).hexdigest()))
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, want))
    for r in got:
        only = [x for x in r.spans.split(",") if x and x.split(":")[0] in op.BASE]
        assert hashlib.sha256(",".join(only).encode()).hexdigest() == r.base_sha256


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    return op.find(docs, keep=["doc_id"]), docs


def test_query_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, op.op8_personal_data(spark, sf).collect())


HARD = [
    None, "", "a@b.com_x@c.de", "foo@bar@x.y", "a@b-c.@d.e x@y z", "1.2.3.4.5.6.7.8 999.1.1.1.1 01.002.255.0", "4111 1111-1111 1111 and 4111111111111112, 12--34 5 6", "+1 (017) 555-7713 +49 30 1234567) ++1234567890. +1(((", "é" * 10 + " x.y+z@ab.cd 4111111111111111",
    "9" * 20 + " " + "0" * 12 + "-" + "1", "call me: 415-555-2671 or (415) 555-2672 ssn 123-45-6789, 123-45-6789", "IBAN DE89370400440532013000 GB82 WEST 1234 5698 7654 32 DE89370400440532013001", "a" * 100_000, "1" * 100_000, "a@b" + ".c" * 30_000, "x@y.z " * 2000, "+1" + "(" * 50_000, "😀 a@b.c 😀 10.0.0.1",
]


def test_hard_texts(spark, tmp_path):
    rows = list(enumerate(HARD)) + [(None, HARD[2]), (3, HARD[3])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kind string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    check(rows, op.op8_personal_data(spark, str(tmp_path)).collect())


def test_further_kinds_and_redaction(spark):
    found, docs = run(spark, list(enumerate(HARD[:12])))
    kinds = {r.doc_id: [x.kind for x in r.pii] for r in found.collect()}
    assert kinds[10].count("local_phone") == 2 and kinds[10].count("national_id") == 2
    assert kinds[11].count("iban") == 2
    plain, _ = run(spark, [(1, "numbers 415-555-2671 and 123-45-6789 here")])
    assert plain.first().pii == []
    text = {r.doc_id: r.text for r in op.redact(docs, length_col=None).collect()}
    assert text[2] == "[EMAIL][EMAIL]" and text[0] is None and text[1] == ""
    out = op.redact(docs.withColumn("n_chars", spark_length()))
    assert out.columns == [*docs.columns, "n_chars"] and all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)
    assert op.redact(docs.limit(0), length_col=None).count() == 0


def spark_length():
    from pyspark.sql import functions as F

    return F.length("text").cast("long")
