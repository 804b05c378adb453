import duckdb

from mnemospark.llm import op5_quality as op


def by_sql(rows):
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    return sorted(map(str, con.sql(op.ORACLE).fetchall()))


def test_query_against_sql(spark, sf):
    rows = [[r.doc_id, r.text] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(str, map(tuple, op.op5_quality_rules(spark, sf).collect()))) == by_sql(rows)


def test_edges(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None, 0), (None, good, 1), (2, "", 2), (3, good, 3), (3, good, 3), (4, "a b c " * 40, 4), (5, good + "\n" + good, 5), (6, good + " x\u0085y", 6), (7, good + " # $ % & | < > *", 7), (8, "\n".join([good, "x y", "x y", " ", "x y", ""]), 8), (9, "w " * 200_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    got = op.judge(docs).drop("rule").collect()
    assert sorted(map(str, map(tuple, got))) == by_sql([list(r[:2]) for r in rows])
    kept = op.filter_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert op.judge(docs.limit(0)).count() == 0 and op.filter_documents(docs.limit(0)).count() == 0


def test_sample_reads_few_files(spark, tmp_path):
    docs = spark.range(0, 4000, 1, 40).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 60) AS text")
    docs.write.parquet(str(tmp_path / "many files"))
    docs = spark.read.parquet(str(tmp_path / "many files"))
    some = op._few_files(docs, "text")
    assert some.count() == 100 * op.FILES and len(docs.inputFiles()) == 40
    assert set(r[0] for r in op.plan(docs)) == set(op.RULES)


def test_order_changes_cost_only(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    order = [r[0] for r in op.plan(docs)]
    assert set(order) == set(op.RULES)
    a = {r.doc_id for r in op.filter_documents(docs, order=order).collect()}
    assert a == {r.doc_id for r in op.filter_documents(docs, order=order[::-1]).collect()}
