import pytest
from pyspark.sql import functions as F

from basketlens import contracts
from basketlens.operators import load, quality
from basketlens.sources.raw import read_csv, require_closed_quotes


def test_null_texts(spark, tmp_path):
    path = tmp_path / "c.csv"
    texts = [*contracts.NULL_TEXTS, "NONE", "none", " "]
    lines = [f'{i},"{t}"' for i, t in enumerate(texts)]
    path.write_text("id,t\n" + "\n".join(lines) + "\n")
    df = load.normalize_nulls(read_csv(spark, str(path)))
    got = {int(r["id"]): r["t"] for r in df.collect()}
    assert len(contracts.NULL_TEXTS) == 19
    assert all(got[i] is None for i in range(19))
    assert [got[i] for i in range(19, 22)] == ["NONE", "none", " "]


def test_columns_are_taken_by_name(spark, tmp_path):
    path = tmp_path / "customers.csv"
    path.write_text(
        'extra,club_member_status,age,customer_id\nx,ACTIVE,31,007\ny,"PRE, ""CREATE""",NaN,008\n'
    )
    rows = load.normalize_customers(read_csv(spark, str(path))).orderBy("customer_id").collect()
    assert tuple(rows[0]) == ("007", 31.0, "ACTIVE")
    assert tuple(rows[1]) == ("008", None, 'PRE, "CREATE"')


def test_files_of_one_table_must_agree_on_their_columns(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "t" / "b.csv").write_text("b,a\n2,1\n")
    with pytest.raises(Exception, match="CSV header"):
        read_csv(spark, str(tmp_path / "t")).select("a", "b").collect()


@pytest.mark.parametrize("columns", [["a", "b", "c"], ["a", "c"]])
def test_rows_with_too_few_or_too_many_fields(spark, tmp_path, columns):
    path = tmp_path / "t.csv"
    path.write_text("a,b,c\n1,2,3\n4,5\n6,7,8,9\n")
    got = sorted(tuple(r) for r in read_csv(spark, str(path)).select("a", *columns[1:]).collect())
    whole = [("1", "2", "3"), ("4", "5", None), ("6", "7", "8")]
    assert got == [tuple(row["abc".index(c)] for c in columns) for row in whole]


def test_articles(spark):
    raw = spark.createDataFrame([("0010000001", "Item one", "x")], "article_id string, prod_name string, g string")
    assert tuple(load.normalize_articles(raw).first()) == (
        "0010000001",
        "Item one",
        "images/001/0010000001.jpg",
    )


def test_missing_columns_are_named_in_order(spark):
    with pytest.raises(ValueError, match=r"Missing columns: \['age', 'club_member_status'\]"):
        load.normalize_customers(spark.createDataFrame([("a",)], "customer_id string"))


def transactions(spark, rows):
    return spark.createDataFrame(
        rows, "customer_id string, product_id string, order_date string, unit_price string"
    )


def test_strict_parse(spark):
    good = transactions(spark, [("a", "1", "2020-01-31", "1e-2")])
    assert load.parsed_transactions(good).first()["unit_price"] == 0.01
    for bad in (("a", "1", "2020-02-31", "1"), ("a", "1", "2020-01-31", "1,5")):
        with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
            load.parsed_transactions(transactions(spark, [bad])).collect()


def test_every_fault_is_reported(spark):
    customers = spark.createDataFrame([("a",)], "customer_id string")
    articles = spark.createDataFrame([("1",)], "product_id string")

    def errors_of(raw):
        faults = raw.agg(*quality.transaction_faults(load.TRANSACTION_TYPES)).first().asDict()
        return quality.transaction_errors(faults, raw, customers, articles)

    assert errors_of(transactions(spark, [("a", "1", "2020-01-31", "1")])) == []
    broken = transactions(
        spark,
        [
            (None, "1", "2020-01-31", "1"),
            ("b", "1", "2020-01-31", "1"),
            ("b", "1", "2020-01-31", "1"),
            ("a", "9", "2020-01-31", "1"),
            ("a", "1", "31.01.2020", "1"),
            ("a", "1", "2020-01-31", "x"),
        ],
    )
    assert sorted(errors_of(broken)) == [
        "transactions contains missing identifiers (1 rows)",
        "transactions has unparsable order_date (1 rows)",
        "transactions has unparsable unit_price (1 rows)",
        "transactions references an unknown article (1 rows)",
        "transactions references an unknown customer (2 rows)",
    ]


def test_dimension_keys(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    assert tuple(quality.dimension_key_report(df, "k").first()) == (1, 1, 2)
    assert quality.dimension_errors(df, "k", "t.csv") == ["t.csv has missing or duplicate k values"]
    assert quality.dimension_errors(df.where("k = 'b'"), "k", "t.csv") == []


def test_contract(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    table = contracts.TableContract
    assert quality.contract_violation(df, table("t", ("a",))) == ""
    assert "missing required columns: ['c', 'd']" in quality.contract_violation(df, table("t", ("d", "c")))
    assert "removed columns: ['b']" in quality.contract_violation(df, table("t", ("a",), ("b",)))
    assert "no data rows" in quality.contract_violation(df.where("a > 1"), table("t", ("a",)))


def test_preview_hides_identifiers(spark):
    df = load.parsed_transactions(
        transactions(spark, [("a", str(i), "2020-01-31", str(i)) for i in range(9)])
    )
    rows = load.masked_preview(df).collect()
    assert [r["unit_price"] for r in rows] == [0.0, 1.0, 2.0, 3.0, 4.0]
    assert {r["customer_id"] for r in rows} | {r["product_id"] for r in rows} == {"<masked>"}


def test_unknown_keys_count_facts(spark):
    facts = spark.range(9).select((F.col("id") % 3).alias("k"))
    known = spark.range(2).select("id")
    assert [tuple(r) for r in quality.unknown_keys(facts, "k", known, "id").collect()] == [(2, 3)]


def test_quoted_line_ends(spark, tmp_path):
    path = tmp_path / "articles.csv"
    path.write_text('article_id,prod_name\n1,"two\nlines"\n2,plain\n')
    rows = read_csv(spark, str(path)).collect()
    assert [r["prod_name"] for r in rows] == ["two\nlines", "plain"]
    with pytest.raises(ValueError, match="quoted line end"):
        require_closed_quotes(spark, str(path))
    closed = tmp_path / "closed.csv"
    closed.write_text('a,b\n1,"x ""y"" z"\n')
    require_closed_quotes(spark, str(closed))


def test_texts_that_are_no_plain_numbers_or_dates(spark):
    from basketlens.functions.columns import parsed

    texts = ["1.0d", "2f", "Infinity", "-inf", "0x10", "12,5", "", "1.5", " -2e3 ", ".5", "7."]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(parsed("t", "double")).collect()]
    assert got == [None] * 7 + [1.5, -2000.0, 0.5, 7.0]
    dates = ["20200105", "2020-01-05", "2020-02-31", "20201305", "5", "2020-01-05 10:00:00"]
    got = [str(r[0]) for r in spark.createDataFrame([(t,) for t in dates], "t string").select(parsed("t", "timestamp_ntz")).collect()]
    assert got == ["2020-01-05 00:00:00", "2020-01-05 00:00:00", "None", "None", "None" if got[4] == "None" else got[4], "2020-01-05 10:00:00"]
