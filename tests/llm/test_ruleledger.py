from pyspark.sql import functions as F

from gramloom.llm import ruleledger

ODD = [(100, "a b c a b c\na b c\n\na b c\n \n"), (101, "# x | y <z> & 100%"), (102, "ABC DEF " * 60), (103, "x y z \x0b \x0c w\x85"), (104, "w " * 3), (105, " a b c"), (106, None), (None, "a"), (7, "a")]


def test_equals_sql(spark, rows, same_as_sql):
    table = spark.createDataFrame([*rows, *ODD], "doc_id long, text string").repartition(3)
    got = ruleledger.apply_policy(ruleledger.ledger(table))
    base = F.col("failed").bitwiseAND(F.lit(3)) != 0
    got = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")
    assert same_as_sql(got, ruleledger.ORACLE_SQL, documents=table) == len(rows) + len(ODD)


def test_policies_and_ablation(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, 4), (5, 4)], "doc_id long, failed long")
    assert [r.kept for r in ruleledger.apply_policy(rows, "base").orderBy("doc_id").collect()] == [True, False, False, True, True]
    found = {r.rule: (r.n_failed, r.n_only) for r in ruleledger.ablation(rows).collect()}
    assert found["symbols"] == (2, 2) and found["too_few_words"] == (2, 1) and found["repeated_words"] == (1, 0)
    assert set(found) == {n for n, _ in ruleledger.RULES}


def test_no_python_in_the_plan(spark):
    plan = ruleledger.ledger(spark.range(5).selectExpr("id as doc_id", "string(id) as text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty(spark):
    assert ruleledger.ledger(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ablation_by_source_with_nulls(spark, rows, same_as_sql, tmp_path):
    table = spark.createDataFrame([(i, t, [None, "a", "b", "a"][k % 4]) for k, (i, t) in enumerate([*rows, *ODD, (900, "w " * 400)])], "doc_id long, text string, source string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    assert same_as_sql(ruleledger.ruleledger_ablation(spark, str(tmp_path)), ruleledger.ABLATION_SQL, documents=table) == 3 * 9


def test_a_long_text_is_measured_whole(spark):
    text = " ".join(f"w{k % 30_000}" for k in range(60_000)) + "\n# end\n# end"
    r = ruleledger.ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) == (60_004, 2, 1, 60_000, 3)
