from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.default.parallelism", "8")
               .config("spark.driver.memory", "8g")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_corpus(spark):
    """Corpus of ``{topic: [token string, ...]}``; documents are numbered per topic."""
    from topicweave.plans.tables import materialise

    def build(topics):
        rows = [(topic, i, f"{topic}/{i}", text.split()) for topic, texts in topics.items() for i, text in enumerate(texts)]
        return materialise(spark.createDataFrame(
            rows, "topic string, doc_id long, orgpath string, tokens array<string>"), "corpus")

    return build
