import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def docs(spark):
    """A small corpus with every awkward byte."""
    texts = [
        "the cat sat on the mat\nthe dog\tsat too", "aaaa aaa aa a", "", "   \t\n ", "x", "Café naïve 你好 \U0001f600",
        "one\x0btwo\x0cthree\rfour", "seen\x00hidden words", "The the THE", "low lower lowest new newer newest wide widest",
        "ab" * 700 + " " + "abc" * 300,
    ]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
