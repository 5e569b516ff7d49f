import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sqltally.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.sparkContext.setLogLevel("OFF")
    yield session


@pytest.fixture(scope="session")
def sf():
    return SMALL


@pytest.fixture(scope="session")
def staff(spark):
    """A small database: people, teams, who leads which."""
    return {
        "staff": {
            "person": spark.createDataFrame(
                [(1, "Ann", 63.5, "Ohio"), (2, "Bob", 41.0, None), (3, "Cid", 66.0, "Iowa"), (4, "Dee", 37.0, "Ohio")],
                "person_id int, name string, age double, born string",
            ),
            "team": spark.createDataFrame(
                [(1, "Parks", 3.5), (2, "Roads", 8.25), (3, "Water", 120.0)],
                "team_id int, name string, budget double",
            ),
            "leads": spark.createDataFrame([(2, 4), (3, 1)], "team_id int, person_id int"),
        }
    }
