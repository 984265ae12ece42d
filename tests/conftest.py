import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from surfpop.session import build

    session = build("tests", "local[8]", 8, **{
        "spark.driver.memory": "8g", "spark.log.level": "FATAL", "spark.ui.showConsoleProgress": "false",
    })
    yield session
    session.stop()
