import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def people(spark):
    """Missing, NaN, blank, tied, constant, all-missing and dotted columns."""
    nan = float("nan")
    rows = [
        (0, 10.0, "x", " ", True, 5.0, None, 1),
        (1, 20.0, "y", "a@b", None, 5.0, None, 2),
        (2, nan, "y", None, False, 5.0, None, None),
        (3, None, "x", "\t\n", True, 5.0, None, 4),
        (4, 40.0, None, " ", True, 5.0, None, 5),
        (5, 1000.0, "Z", "c", False, 5.0, None, 7),
    ]
    return spark.createDataFrame(
        rows,
        "id long, age double, sex string, email string, member boolean, flat double, none double, `n.o` int",
    ).repartition(3)
