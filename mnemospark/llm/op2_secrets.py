r"""Secret scan: patterns propose candidates, a random forest removes false positives.

Candidates are values assigned to a name like token or api_key, and bare strings of 20
and more characters with a digit, of any length.  The forest judges each by its length,
transitions between classes of characters, the likelihood of its letter pairs, how much of
it words of the corpus cover, entropy, the path it was found at and the words next to it.

statistics() counts the corpus: its words (a table, never collected) and, from them, its
letter pairs (26 by 26 numbers).  The forest is fitted on labelled findings (columns
candidate, before, after, path, label); of more than MOST_LABELLED it takes those of the
least hash.  A query without findings of its own uses labelled_findings(): values made by
rule, put into real surroundings at hashed places of at most MOST_LABELLED documents.

Features, model and scan are DataFrame functions and Spark's own forest; no Python.

Defined cases: null text is empty and has no finding; a null doc_id or path is kept
(a null path counts as an empty one); repeated rows are each scanned; texts and candidates
of any length are read whole; an empty table gives an empty result; further columns are
ignored; a corpus without words gives even letter pairs and no coverage; fit() refuses
findings that are not of both classes.  Secrets are returned as SHA-256 only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, spans

MOST_LABELLED, SEED, NEAR, THRESHOLD = 6_000, 11, 40, 0.5
NAMES = r"token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|auth(?:orization)?|credentials?|private[_-]?key|bearer"
ASSIGNED = r"(?i)(?:" + NAMES + r")[\"']?[ \t]*+(?:=>|:=|=|:)[ \t]*+[\"']?([A-Za-z0-9+/=_.~-]{8,}+)"
BARE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/=_-])"
#: Words that stand for a secret in samples and manuals.
PLACEHOLDERS = "test|example|sample|dummy|placeholder|change|your|here|insert|todo|fake|redacted|none|null"
#: A word of the corpus occurs this often at least; the commonest MOST_COMMON make up identifiers.
LEAST_TIMES, MOST_COMMON = 3, 200
PARTS = "[A-Z]?[a-z]+|[A-Z]+"
FEATURES = ["f_length", "f_classes", "f_pairs", "f_words", "f_placeholder", "f_distinct", "f_entropy", "f_digits", "f_upper", "f_hex", "f_repeats", "f_steps", "f_test_path", "f_config_path", "f_near_secret", "f_near_digest", "f_near_sample", "f_assigned"]


class Statistics:
    """words: a stored table (word, n) of the corpus; pairs: log-likelihood of each letter after each other."""

    def __init__(self, words: DataFrame):
        self.words = words
        pair = F.explode(F.regexp_extract_all("word", F.lit("(?=([a-z][a-z]))"), F.lit(1)))
        found = words.select("n", pair.alias("p")).groupBy("p").agg(F.sum("n").alias("n")).collect()  # 26 * 26 rows at most
        n = [[1] * 26 for _ in range(26)]
        for r in found:
            n[ord(r.p[0]) - 97][ord(r.p[1]) - 97] += r.n
        self.pairs = [math.log(x / sum(row)) for row in n for x in row]

    def common(self) -> list[str]:
        """The commonest words of 3 to 9 letters, MOST_COMMON at most."""
        few = self.words.filter("length(word) between 3 and 9").orderBy(F.desc("n"), "word").limit(MOST_COMMON)
        return [r.word for r in few.collect()]


def statistics(docs: DataFrame, text_col: str = "text") -> Statistics:
    """Words and letter pairs of all texts."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(shared.text_or_empty(text_col)), F.lit("[a-z]{3,}+"), F.lit(0))).alias("word"))
    return Statistics(shared.stored(words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_TIMES), "words"))


def covered(df: DataFrame, known: Statistics) -> DataFrame:
    """key, f_words: of each distinct candidate the share of its characters in words of the corpus."""
    each = df.groupBy("key").agg(F.first("candidate").alias("candidate"), F.count("*").alias("n"))
    cut = F.transform(F.regexp_extract_all("candidate", F.lit(PARTS), F.lit(0)), F.lower)
    parts = each.select("key", "n", F.length("candidate").alias("size"), cut.alias("parts")).select("key", "n", "size", F.explode_outer("parts").alias("word"))
    hit = parts.join(known.words.select("word", F.lit(1).alias("hit")), "word", "left")
    return hit.groupBy("key").agg((F.sum(F.when(F.col("hit") == 1, F.length("word")).otherwise(0)) / F.first("size")).alias("f_words"), F.first("n").alias("n"))


def features(df: DataFrame, known: Statistics) -> DataFrame:
    """df (candidate, before, after, path) with the columns FEATURES, doubles."""
    df = shared.stored(df.withColumn("key", F.sha2("candidate", 256)), "candidates")
    found = shared.stored(covered(df, known), "covered")
    df = shared.lookup(df, found, "key", df.count())
    c, low = F.col("candidate"), F.lower("candidate")
    n = F.greatest(F.length(c), F.lit(1))
    path, before = F.lower(F.coalesce("path", F.lit(""))), F.lower("before")
    around = F.concat(before, F.lit(" "), F.lower("after"))
    count = lambda p, s=c: F.size(F.regexp_extract_all(s, F.lit(p), F.lit(0))).cast("double")
    flag = lambda x: x.cast("double")
    distinct = F.filter(F.array_distinct(F.split(c, "")), lambda x: x != "")
    part = lambda x: (n - F.length(F.replace(c, x))) / n
    entropy = F.aggregate(distinct, F.lit(0.0), lambda a, x: a - part(x) * F.log2(part(x)))
    table = F.lit(known.pairs)
    pairs = F.regexp_extract_all(low, F.lit("(?=([a-z][a-z]))"), F.lit(1))
    likely = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.element_at(table, ((F.ascii(p) - 97) * 26 + F.ascii(F.substring(p, 2, 1)) - 96).cast("int")))
    made = {
        "f_length": n.cast("double"),
        "f_classes": (count("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+") - 1) / n,
        "f_pairs": F.when(F.size(pairs) > 0, likely / F.size(pairs)).otherwise(math.log(1 / 26)),
        "f_words": F.col("f_words"),
        "f_placeholder": 1 - F.length(F.regexp_replace(low, PLACEHOLDERS, "")) / n,
        "f_distinct": F.size(distinct) / n,
        "f_entropy": entropy,
        "f_digits": count("[0-9]") / n,
        "f_upper": count("[A-Z]") / n,
        "f_hex": flag(c.rlike("^(?:[0-9a-f]++|[0-9A-F]++)$")),
        "f_repeats": 1 - F.length(F.regexp_replace(c, r"(.)\1{2,}", "")) / n,
        "f_steps": flag(low.rlike("abcde|12345|qwert|xxxx|98765|deadbeef")),
        "f_test_path": flag(path.rlike("test|example|sample|doc|mock|fixture")),
        "f_config_path": flag(path.rlike(r"\.env|config|settings|secret|deploy")),
        "f_near_secret": flag(before.rlike(NAMES)),
        "f_near_digest": flag(around.rlike("sha-?(?:1|256|512)|md5|commit|checksum|digest|uuid|hash|revision")),
        "f_near_sample": flag(around.rlike("example|sample|placeholder|dummy|fake|your[ _-]")),
        "f_assigned": flag(before.rlike(r"[=:]>?[ \t]*[\"']?$")),
    }
    return df.select(*[c for c in df.columns if c not in made], *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in made.items()])


def surroundings(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """before, after, path at a hashed place of n documents, those of the least hash."""
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    text = shared.text_or_empty(text_col)
    hashed = F.pmod(F.xxhash64(F.col(id_col), F.xxhash64(text)), F.lit(1 << 40))
    rows = docs.select(hashed.alias("h"), text.alias("t"), path.alias("path")).filter("length(t) >= 20")
    share = min(1.0, 2.0 * n / max(1, docs.count()))  # about 2 n rows are sorted, whatever the corpus
    rows = rows.filter(F.col("h") < int(share * (1 << 40))).withColumn("at", F.pmod("h", F.length("t")))
    cut = rows.select("h", F.substring("t", F.greatest(F.col("at") - NEAR, F.lit(0)) + 1, F.least("at", F.lit(NEAR))).alias("before"), F.substring("t", F.col("at") + 1, F.lit(NEAR)).alias("after"), "path")
    return cut.orderBy("h", "before", "after").limit(n)


def labelled_findings(docs: DataFrame, known: Statistics, n: int = 4_000, **columns) -> DataFrame:
    """Up to n labelled findings: values made by rule in real surroundings; candidate, before, after, path, label."""
    around = surroundings(docs, min(n, MOST_LABELLED), **columns).withColumn("id", F.xxhash64("h", "before", "after"))
    row, pick = F.col("id").cast("string"), lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m))
    choose = lambda salt, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (pick(salt, len(xs)) + 1).cast("int"))
    hexes = F.sha2(F.concat(row, F.lit("h")), 256)
    base64 = F.base64(F.unhex(F.sha2(F.concat(row, F.lit("b")), 256)))
    alnum = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(row, F.lit("a")), 512))), "[+/=\r\n]", "")
    cut = lambda s, a, b: F.substring(s, F.lit(1), (pick(f"cut{a}", b - a + 1) + a).cast("int"))
    kind = pick("r", 5)
    random = (
        F.when(kind == 0, cut(hexes, 32, 64)).when(kind == 1, cut(base64, 20, 44)).when(kind == 2, F.upper(cut(alnum, 16, 40)))
        .when(kind == 3, F.concat(choose("pre", "sk_live_", "ghp_", "xoxb-", "AKIA", "eyJ", ""), cut(alnum, 24, 60))).otherwise(cut(alnum, 16, 60))
    )
    common = known.common() or ["value"]
    sep = choose("sep", "_", "-", "", "/", ".")
    word = lambda k: F.when(pick(f"cap{k}", 3) == 0, F.initcap(choose(f"w{k}", *common))).otherwise(choose(f"w{k}", *common))
    names = F.concat(*[x for k in range(4) for x in (word(k), sep)], choose("d", "1", "2", "v1", "2024", "01"))
    form = pick("n", 6)
    plain = (
        F.when(form <= 1, names)
        .when(form == 2, F.repeat(choose("c", "x", "0", "1", "a", "*"), (pick("len", 30) + 10).cast("int")))
        .when(form == 3, F.concat(choose("s", "your-token-here", "changeme12345", "EXAMPLEKEY", "abcdef123456", "insert_api_key_here1"), pick("e", 90).cast("string")))
        .when(form == 4, F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12)))
        .otherwise(F.substring(hexes, 1, 40))
    )
    secret = pick("label", 2) == 0
    assigned = choose("q1", ' token = "', " api_key: ", " password=", ' secret: "', " authorization = ", " access_key='", ' auth_token := "')
    digest = choose("q2", " sha256: ", " commit ", " checksum = ", " md5 ", " revision=", " digest: ", " uuid ")
    lead = F.when(secret, F.when(pick("b", 10) < 9, assigned).otherwise(" ")).when(form >= 4, digest).when(pick("b", 2) == 0, assigned).otherwise(" ")
    path = F.when(secret, choose("g1", "src/app.py", "deploy/.env", "config/settings.yml", "tests/t.py")).otherwise(choose("g2", "tests/data.py", "docs/example.md", "src/app.py", "package.lock"))
    return around.select(
        F.when(secret, random).otherwise(plain).alias("candidate"), F.substring(F.concat("before", lead), -NEAR, NEAR).alias("before"), F.concat(choose("z", '" ', "' ", " ", " \n", "; "), F.substring("after", 1, NEAR - 2)).alias("after"),
        F.when(pick("path", 2) == 0, F.col("path")).otherwise(path).alias("path"), secret.cast("double").alias("label"),
    )


def fit(labelled: DataFrame, known: Statistics, trees: int = 40, depth: int = 8):
    """A forest on at most MOST_LABELLED labelled findings, those of the least hash."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    some = labelled.orderBy(F.xxhash64("candidate", "before", "after", "path"), "label").limit(MOST_LABELLED)
    data = shared.stored(features(some, known).select(*FEATURES, "label"), "labelled")
    if data.select("label").distinct().count() < 2:
        raise ValueError("labelled findings of both classes are needed")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="sqrt")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(data)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """doc_id, path, rule, start, end, candidate, before, after of each proposal (end exclusive, in code points)."""
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    df = docs.select(shared.quoted(id_col).cast("long").alias("doc_id"), path.alias("path"), shared.text_or_empty(text_col).alias("text"))
    text = F.col("text")
    df = df.withColumn("ma", spans.matches(text, ASSIGNED, text.rlike("[=:]"))).withColumn("mb", spans.matches(text, BARE, text.rlike("[0-9]")))
    df = df.filter((F.size("ma") > 0) | (F.size("mb") > 0))
    df = df.withColumn("va", spans.matches(text, ASSIGNED, F.size("ma") > 0, 1))
    df = df.withColumn("pa", spans.between(text, ASSIGNED, F.col("ma"))).withColumn("pb", spans.between(text, BARE, F.col("mb")))
    df = df.withColumn("sa", spans.located("ma", "pa")).withColumn("sb", spans.located("mb", "pb"))
    df = df.withColumn("a", F.expr("transform(sa, (x, i) -> named_struct('rule', 'assigned', 'start', x.start + length(x.s) - length(va[i]), 'candidate', va[i]))"))
    df = df.withColumn("b", F.expr("filter(transform(sb, x -> named_struct('rule', 'bare', 'start', x.start, 'candidate', x.s)), x -> not exists(a, y -> y.start < x.start + length(x.candidate) and x.start < y.start + length(y.candidate)))"))
    df = df.select("doc_id", "path", "text", F.explode(F.concat("a", "b")).alias("x"))
    start, size = F.col("x.start"), F.length("x.candidate")
    return df.select(
        "doc_id", "path", F.col("x.rule").alias("rule"), start.alias("start"), (start + size).alias("end"), F.col("x.candidate").alias("candidate"),
        F.substring(text, F.greatest(start - NEAR, F.lit(0)) + 1, F.least(start, F.lit(NEAR))).alias("before"), F.substring(text, start + size + 1, F.lit(NEAR)).alias("after"),
    )


def scan(docs: DataFrame, model, known: Statistics, **columns) -> DataFrame:
    """Candidates with the forest's probability and verdict."""
    from pyspark.ml.functions import vector_to_array

    judged = model.transform(features(candidates(docs, **columns), known))
    return judged.select("doc_id", "path", "rule", "start", "end", F.col("key").alias("candidate_sha256"), F.round(vector_to_array("probability")[1], 6).alias("probability")).withColumn("is_secret", F.col("probability") >= THRESHOLD)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    known = statistics(docs)
    return scan(docs, fit(labelled_findings(docs, known), known), known)
