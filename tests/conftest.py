import pytest

from tessera.session import session, ship


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", "tests", 4, **{"spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s
