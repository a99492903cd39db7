import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from salesloom.session import local_session

    session = local_session(8, "tests", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def star(spark):
    from compare import SMALL
    from salesloom.sources.trade import trade_star

    return trade_star(spark, SMALL)


@pytest.fixture(scope="session")
def edge(spark):
    from edge_star import edge_star

    return edge_star(spark)


@pytest.fixture(scope="session")
def edge_db():
    from edge_star import edge_database

    return edge_database()
