import pytest

from tessera.llm import mixing


def check(spark, duck, df, mix):
    got = sorted(map(str, (tuple(r) for r in mixing.op2(df, mix).select("doc_id", "domain", "lang", "source", "tokens", "epoch").collect())))
    frame = df.toArrow()
    duck.register("documents", frame)
    want = sorted(map(str, duck.sql(f"select doc_id, domain, lang, source, tokens, epoch from ({mixing.op2_sql(mix)})").fetchall()))
    assert got == want
    return got


@pytest.mark.parametrize("percent", [30, 100, 250])
def test_equals_sql(spark, docs, duck, percent):
    texts = [("word " * (k % 17 + 1)) for k in range(150)] + ["", None, "é" * 500, "x" * 5000]
    check(spark, duck, docs(texts), mixing.Mix(total_percent=percent))


@pytest.mark.parametrize("percent", [70, 130])
def test_repeated_and_null_ids(spark, docs, duck, percent):
    rows = [(k // 9 if k % 5 else None, "word " * (k % 4)) for k in range(200)] + [(1000, "same text")] * 60
    check(spark, duck, docs(rows), mixing.Mix(total_percent=percent))


def test_extra_columns_come_through(spark, docs):
    df = docs(["a b c d"] * 5).selectExpr("*", "1 as tokens", "'x' as domain", "2 as budget", "3 as `a.b`")
    assert mixing.mix_rows(df).drop("_epoch").columns == df.columns
    assert {(r["tokens"], r["domain"], r["budget"]) for r in mixing.mix_rows(df).collect()} == {(1, "x", 2)}


def test_shortage_goes_to_siblings_first(spark):
    rows = [("web", "en", "src1", 100), ("web", "en", "src2", 10_000), ("web", "de", "src1", 10_000), ("books", "en", "src10", 10_000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    mix = mixing.Mix(domains={"web": 1, "books": 1}, langs={"en": 1, "de": 1}, max_epochs=1, total_percent=25)
    found = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.budgets(leaves, mix).collect()}
    total = 30_100 // 4
    assert found["web", "en", "src1"] == 100
    assert abs(found["web", "en", "src2"] - (total // 4 - 100)) <= 2  # the sibling source takes it, not the other language
    assert abs(found["web", "de", "src1"] - total // 4) <= 2
    assert abs(found["books", "en", "src10"] - total // 2) <= 2


def test_columns_and_empty_table(spark, docs):
    df = docs(["a b c d"] * 5)
    assert mixing.mix_rows(df).select(*df.columns).columns == df.columns
    assert mixing.op2(docs([])).count() == 0
    assert mixing.op2(docs(["", None])).count() == 0
