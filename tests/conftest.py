import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tokenweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.driver.memory": "8g",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def coder(spark):
    from tokenweave.functions.bpe import BytePairCoder, default_rank_file

    if default_rank_file() is None:
        pytest.skip("no byte-pair rank file here")
    return BytePairCoder(spark)


@pytest.fixture(scope="session")
def plain(coder):
    """The same vocabulary in this process, for brute-force comparison."""
    from tokenweave.functions.bpe import _encoding

    return _encoding(coder._name, coder._ranks.value)
