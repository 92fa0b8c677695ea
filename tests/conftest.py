import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from corpusguard.session import build_session
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "4g", "spark.ui.enabled": "false",
        "spark.driver.host": "127.0.0.1", "spark.driver.bindAddress": "127.0.0.1",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def corpus_of(spark):
    """A corpus of one repository from (path, text) pairs."""
    from corpusguard.sources.readers import CORPUS_SCHEMA

    def build(*files, repo="r"):
        return spark.createDataFrame([(repo, p, t, i) for i, (p, t) in enumerate(files)], CORPUS_SCHEMA)
    return build
