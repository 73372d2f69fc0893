"""Queries over documents with broadcasts forbidden: a table of documents must not be gathered on the driver, whatever the size of the files it comes from."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import SF, rows

from tidewright import plans
from tidewright.operators import extraction, provenance
from tidewright.plans import documents


@pytest.fixture
def no_broadcast(spark):
    """Spark takes every table for a small one, and fails where it would send one to all executors."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "1g", "spark.sql.maxBroadcastTableSize": "1b"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def few(tmp_path_factory):
    """40 customers."""
    folder = str(tmp_path_factory.mktemp("memory"))
    duckdb.sql(f"COPY (SELECT * FROM '{SF}/customer.parquet' WHERE c_custkey < 40) TO '{folder}/customer.parquet'")
    return folder


@pytest.mark.parametrize("name", ["wrap_fields", "payslip_period", "period_group_max", "period_ties", "runner_up_margin", "alt_salary_margin", "parse_payslip_ocr"])
def test_no_documents_are_sent_to_the_driver(spark, no_broadcast, few, name):
    df, con = plans.queries()[name](spark, few), duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{few}/customer.parquet'")
    sql = con.sql(plans.oracles()[name])
    got, expected = rows(df.columns, map(tuple, df.collect())), rows(sql.columns, sql.fetchall())
    assert len(got) == len(expected) > 0
    for a, b in zip(got, expected, strict=True):
        assert all(x == y or isinstance(x, float) and x == pytest.approx(y, rel=1e-9) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("kind", ["payslip", "pensionReport"])
def test_a_text_is_cleaned_once_to_be_assessed(spark, kind):
    """Each of a text's labels and signs would else clean it anew: two passes for the search form, two for the signs, each with the ends."""
    plan = spark.createDataFrame([("Insured salary 8,000",)], "text string").select(provenance.assess_text(F.col("text"), kind).alias("assessed"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 7


def test_files_are_dealt_to_all_tasks(spark, few, monkeypatch):
    """The table that all of extract() reads is made by as many tasks as a shuffle has, though its input is one small file."""
    parts = []

    def stop(df):
        parts.append(df.rdd.getNumPartitions())
        raise StopIteration

    monkeypatch.setattr(extraction, "settled", stop)
    with pytest.raises(StopIteration):
        extraction.extract(documents._files(documents.seed(spark, few)))
    assert parts == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
