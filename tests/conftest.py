import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from weblens.plans.context import configure
    from weblens.session import ensure_checkpoint_dir

    s = (SparkSession.builder.master("local[*]")
         .config("spark.driver.memory", "8g")
         .config("spark.sql.ui.retainedExecutions", "5")
         .config("spark.ui.retainedJobs", "20")
         .config("spark.ui.retainedStages", "20")
         .config("spark.ui.retainedTasks", "1000")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    configure(s)
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def duck():
    from weblens.plans.compare import duck_connect

    return duck_connect(SF_SMALL)


@pytest.fixture(scope="module", autouse=True)
def drop_tables():
    """What a module's queries keep is dropped behind it."""
    yield
    from weblens.plans import context

    context.clear()


def make_tables(spark, pages):
    """pages: list of (page_id, url, html)."""
    from weblens.plans.context import Tables

    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return Tables(df)
