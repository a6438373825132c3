import os

import pytest

from quernwork.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        master=f"local[{os.environ.get('TEST_CPUS', '8')}]",
        conf={
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
