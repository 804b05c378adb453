r"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

Everything is DataFrame functions.  Patterns of the base kinds are anchored where a
match must begin (so a long run of characters is read once) and are possessive where
giving back cannot help; they find the same spans as the plain patterns

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)       parts at most 255
    card   [0-9]([\x20-]?[0-9])+                      12 to 19 digits, Luhn
    phone  \+[0-9][\x20().0-9-]+[0-9]                 9 to 15 digits

which pass with a score of at least KEEP whatever stands around them.  Further kinds:
iban (mod 97), national_id and local_phone (these two only pass if a word of their
CONTEXT stands within NEAR characters before or after).  A further span that touches
a base span, or a span of an earlier further kind, is dropped.

Defined cases: null text is empty and has no span; a null doc_id is kept; repeated
rows are each judged; of kinds that match the same place the base kinds all count, and
further kinds give way; texts of any length are read whole, in one row's memory; an empty
table gives an empty result; further columns are ignored by find(), and kept by redact(),
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, spans

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "national_id", "local_phone"]
PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])",
}
#: Score without context, and what a word of the context adds.
SCORE = {"email": (0.9, 0.1), "ip": (0.6, 0.2), "card": (0.8, 0.2), "phone": (0.7, 0.2), "iban": (0.9, 0.1), "national_id": (0.4, 0.4), "local_phone": (0.4, 0.3)}
KEEP, NEAR = 0.6, 40
CONTEXT = {
    "email": "e-?mail|mail|contact|courriel|correo",
    "ip": "ip|host|server|address|adresse|login",
    "card": "card|visa|mastercard|amex|credit|debit|carte|karte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|cell|telefon|teléfono|téléphone",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "national_id": "ssn|social security|national id|insurance number|ausweis",
    "local_phone": "phone|tel|call|fax|mobile|cell|telefon|teléfono|téléphone",
}


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether the digits of s pass the Luhn check."""
    d = F.reverse(F.split(digits(s), ""))

    def value(c, i):
        twice = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.filter(d, lambda c: c != ""), value), F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(s: Column) -> Column:
    """Whether s passes the ISO 7064 mod-97 check, as IBANs do."""
    plain = F.regexp_replace(s, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4)), "")
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), step) == 1


def confirmed(kind: str, s: Column) -> Column:
    n = F.length(digits(s))
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:|[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return n.between(12, 19) & luhn(s)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return mod97(s)
    if kind == "national_id":
        return ~s.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def find(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs with `text` (null: empty) and `pii`: an array of structs
    (start, kind_order, end, kind, score), by start, then kind; end is exclusive, in code points."""
    df = docs.select(*[F.col(c) for c in keep or []], shared.text_or_empty(text_col).alias("_text"))
    text, found = F.col("_text"), []
    some = {"email": text.contains("@"), "phone": text.contains("+")}
    df = df.withColumn("_digit", text.rlike("[0-9]"))
    for kind in KINDS:
        df = df.withColumn(f"_m_{kind}", spans.matches(text, PATTERN[kind], some.get(kind, F.col("_digit"))))
    for kind in KINDS:
        df = df.withColumn(f"_p_{kind}", spans.between(text, PATTERN[kind], F.col(f"_m_{kind}")))
    for order, kind in enumerate(KINDS):
        base, more = SCORE[kind]
        near = r"(?iu)(?<![\p{L}\p{N}])(?:" + CONTEXT[kind] + r")(?![\p{L}\p{N}])"

        def scored(x):
            before = F.substring(text, F.greatest(x["start"] - NEAR, F.lit(0)) + 1, F.least(x["start"], F.lit(NEAR)))
            after = F.substring(text, x["start"] + F.length(x["s"]) + 1, F.lit(NEAR))
            hit = F.concat(before, F.lit(" \n "), after).rlike(near)
            return F.struct(x["start"].alias("start"), F.lit(order).alias("kind_order"), (x["start"] + F.length(x["s"])).alias("end"), F.lit(kind).alias("kind"), (F.lit(base) + F.when(hit, more).otherwise(0.0)).alias("score"))

        spot = spans.located(f"_m_{kind}", f"_p_{kind}")
        passed = F.filter(F.transform(F.filter(spot, lambda x: confirmed(kind, x["s"])), scored), lambda x: x["score"] >= KEEP)
        df = df.withColumn(f"_s_{kind}", passed)
        found.append(f"_s_{kind}")
    for k, column in enumerate(found[len(BASE) :], len(BASE)):  # the further kinds give way to earlier ones
        for before in found[:k]:
            df = df.withColumn(column, F.when(F.size(column) > 0, F.filter(column, lambda x: ~F.exists(before, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))).otherwise(F.col(column)))
    return df.select(*(keep or []), text.alias("_text"), F.sort_array(F.concat(*found)).alias("pii"))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every span replaced by its kind in brackets; touched texts get their new length."""
    kept = {c: f"c{k}" for k, c in enumerate(docs.columns) if c != text_col}
    text = shared.quoted(text_col)
    found = find(docs.select(*[shared.quoted(c).alias(k) for c, k in kept.items()], text.alias("raw"), text.alias("text")), "text", [*kept.values(), "raw"])
    new = F.expr("""
      aggregate(pii, named_struct('at', 0, 'out', ''),
        (a, x) -> if(x.start < a.at, named_struct('at', greatest(a.at, x.end), 'out', a.out),
          named_struct('at', x.end, 'out', concat(a.out, substring(_text, a.at + 1, x.start - a.at), '[', upper(x.kind), ']'))),
        a -> concat(a.out, substring(_text, a.at + 1, length(_text))))""")
    found = found.withColumn("_new", F.when(F.size("pii") > 0, new).otherwise(F.col("raw")))
    back = {c: F.col(k) for c, k in kept.items()} | {text_col: F.col("_new")}
    if length_col in kept:
        back[length_col] = F.when(F.size("pii") > 0, F.length("_new").cast(docs.schema[length_col].dataType)).otherwise(F.col(kept[length_col]))
    return found.select(*[back[c].alias(c) for c in docs.columns])


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(shared.table(spark, sf_dir, "documents"), keep=["doc_id"])
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(pii, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE]
    base = F.filter("pii", lambda x: x["kind_order"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("pii")).alias("spans"))
