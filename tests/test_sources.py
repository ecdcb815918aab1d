import pytest

from panelstats.session import shared_dir
from panelstats.sources import io


def test_duplicate_names_rejected():
    with pytest.raises(ValueError):
        io.declared_schema([("mom_energy", "string"), ("age", "int"), ("mom_energy", "string")])


def test_answers_schema_has_nine_columns():
    assert len(io.ANSWERS_SCHEMA) == 9


def test_csv_roundtrip_with_declared_and_inferred_schema(spark):
    df = spark.createDataFrame([(1, "a b", 2.5), (2, None, None)], "k int, s string, d double")
    path = shared_dir(spark, "test_csv")
    io.write_table(df, path, fmt="csv", single_file=True)
    back = io.read_csv(spark, path, schema=df.schema)
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == [(1, "a b", 2.5), (2, None, None)]
    inferred = io.read_csv(spark, path)
    assert dict(inferred.dtypes)["k"] == "int"


def test_parquet_handover(spark):
    df = spark.createDataFrame([(1, "x")], "k int, s string")
    path = io.write_table(df, shared_dir(spark, "test_parquet"))
    assert io.read_table(spark, path).collect()[0]["s"] == "x"


def test_missing_file_raises(spark):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        io.read_csv(spark, "/nonexistent/file.csv")


def test_r_names():
    assert io.r_name("002_Gender") == "X002_Gender"
    assert io.r_name("003_Where did you grow up") == "X003_Where.did.you.grow.up"
    assert io.r_name("baseWellBeingScore") == "baseWellBeingScore"
    assert io.r_name(".5x") == "X.5x" and io.r_name("_a") == "X_a"


def test_safe_names_dedupes(spark):
    df = spark.createDataFrame([(1, 2)], ["a b", "a.b"])
    assert io.safe_names(df).columns == ["a.b", "a.b.1"]


def test_views_and_parameters(spark):
    df = spark.createDataFrame([("P1", 1, 5, "x"), ("P1", 2, 5, "y")], "p string, a int, q int, t string")
    io.register_view(df, "answers_view")
    r = io.run_sql(spark, "SELECT t FROM answers_view WHERE p = :p AND a = :a AND q = :q",
                   args={"p": "P1", "a": 2, "q": 5}).collect()
    assert [x[0] for x in r] == ["y"]
    r2 = io.run_sql(spark, "SELECT count(*) FROM {d} WHERE a = 1", d=df).first()[0]
    assert r2 == 1


def test_first_rows_and_profile(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "x int")
    assert [r[0] for r in io.first_rows(df, 2, ["x"]).collect()] == [1, 2]
    assert tuple(io.profile(df).first()) == (3, 1)


def test_every_line_is_a_row_or_rejected(spark, tmp_path):
    from panelstats.sources.io import declared_schema, read_csv_checked

    lines = ["a,b,c", "1,2.5,x", "two,2.5,x", "3,,", '4,1.0,"quoted, text"', "5,1.0", "6,1.0,x,more", "", "7,nan?,x", "8,0.5,y"]
    path = tmp_path / "in.csv"
    path.write_text("\n".join(lines) + "\n")
    schema = declared_schema([("a", "int"), ("b", "double"), ("c", "string")])
    rows, rejected = read_csv_checked(spark, str(path), schema)
    assert sorted(map(tuple, rows.collect())) == [(1, 2.5, "x"), (3, None, None), (4, 1.0, "quoted, text"), (8, 0.5, "y")]
    assert sorted(r["line"] for r in rejected.collect()) == sorted(["two,2.5,x", "5,1.0", "6,1.0,x,more", "7,nan?,x"])
    assert rows.count() + rejected.count() == len(lines) - 2  # the header and the blank line
