import pytest
from pyspark.sql import functions as F

from veedor.operators.listing import page
from veedor.sources.directory import PageDirectory


def texts(df):
    return [str(r.asDict()) for r in df.collect()]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rows = [(f"C{i % 60:03d}", f"x{i % 7}", i) for i in range(230)] + [(None, "n", 1)] * 3 + [("C030", "same", 0)] * 120  # a third are one row
    df = spark.createDataFrame(rows, "id_contrato string, ciudad string, n int").repartition(5).cache()
    return df, PageDirectory.build(df, str(tmp_path_factory.mktemp("pages") / "d"), file_rows=40)


def test_every_page_as_by_offset(table):
    df, directory = table
    whole = sorted(texts(df))
    seen = []
    for number in (0, 1, 5, 13, 29, 35):
        assert texts(directory.page(number)) == texts(page(df, number))
    for number in range(0, 6):
        seen += texts(directory.page(number, 70).drop("n_fila"))
    assert sorted(seen) == whole and directory.n_rows() == 353
    assert texts(directory.last_page()) == texts(page(df, 35)) and len(texts(directory.last_page())) == 3
    assert texts(directory.page(36)) == [] and texts(directory.page(-4)) == texts(directory.page(0))


def test_a_page_opens_one_file(table):
    _, directory = table
    assert directory.files().count() >= 8 and max(r.n for r in directory.files().collect()) <= 120
    opened = [len(directory.page(k).inputFiles()) for k in range(36)]
    assert set(opened) <= {1, 2} and opened.count(1) > opened.count(2)


def test_position_of_an_id(table):
    df, directory = table
    ids = sorted(r.id_contrato for r in df.where("id_contrato IS NOT NULL").collect())
    for key in ("", "C000", "C030", "C0305", "C059", "zzz"):
        assert directory.position(key) == sum(i < key for i in ids)


def test_empty(spark, tmp_path):
    none = PageDirectory.build(spark.createDataFrame([], "id_contrato string, n int"), str(tmp_path / "d"))
    assert none.page(0).count() == 0 and none.last_page().count() == 0 and none.n_rows() == 0 and none.position("a") == 0


def test_the_input_is_evaluated_once(spark, tmp_path):
    """For the number of rows, the ranges and the rows: joins below are made once."""
    seen = spark.sparkContext.accumulator(0)

    def told(n):
        seen.add(1)
        return f"C{n:04d}"

    df = spark.range(300, numPartitions=3).select(F.udf(told, "string")("id").alias("id_contrato"), F.col("id").alias("n"))
    directory = PageDirectory.build(df, str(tmp_path / "d"), file_rows=40)
    assert directory.n_rows() == 300 and seen.value == 300
    assert [r.n for r in directory.last_page().collect()] == list(range(290, 300))
