from __future__ import annotations

import datetime as dt

import pytest

from wattloom.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("local[4]", "tests", 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("spark")))
    s.conf.set("spark.sql.session.timeZone", "America/New_York")  # no operator may depend on it
    yield s
    s.stop()


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


READINGS = "reading_id long, zone_id int, datetime timestamp_ntz, load_mw double"
