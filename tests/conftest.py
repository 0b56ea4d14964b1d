import pytest

from plumbline.session import build_session, ship


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 4, spark__driver__memory="6g", spark__sql__warehouse__dir="/tmp/plumbline-warehouse", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    return session
