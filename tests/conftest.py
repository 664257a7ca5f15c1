import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from duelframe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions=4, spark__ui__enabled="false", spark__driver__memory="6g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def random_matches(spark):
    """300 matches of two leagues and seasons: ties in the date, unplayed rows, gaps."""
    import datetime as dt
    import random

    rng = random.Random(7)
    rows = []
    for i in range(300):
        home, away = rng.sample(range(6), 2)
        played = rng.random() > 0.15
        number = lambda top: float(rng.randrange(top)) if rng.random() > 0.1 else None  # noqa: B023, E731
        rows.append(
            (
                f"m{i:03d}", f"L{rng.randrange(2)}", f"s{rng.randrange(2)}",
                dt.datetime(2020, 1, 1) + dt.timedelta(days=rng.randrange(60)),
                f"t{home}", f"t{away}",
                rng.randrange(5) if played else None, rng.randrange(5) if played else None,
                number(30) if played else None, number(30) if played else None,
                number(9) if played else None, number(9) if played else None,
            )
        )
    return spark.createDataFrame(
        rows,
        "match_id string, league_id string, season string, date timestamp_ntz, home_team string, away_team string, "
        "home_goals int, away_goals int, home_xg double, away_xg double, home_shots double, away_shots double",
    )
