import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from chartline.layout import Layout, readings_schema  # noqa: E402
from chartline.session import local_session  # noqa: E402

ONE = Layout(signals=("hr",))


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    yield session
    session.stop()


def at(text: str) -> dt.datetime:
    """A time on 2024-01-02, or a full timestamp."""
    return dt.datetime.fromisoformat(text if "-" in text else f"2024-01-02 {text}")


@pytest.fixture(scope="session")
def hr(spark):
    """Readings of one signal from (time, value) pairs, or (patient, time, value) triples."""

    def build(*rows):
        full = [r if len(r) == 3 else ("p", *r) for r in rows]
        return spark.createDataFrame(
            [(p, at(t), None if v is None else float(v)) for p, t, v in full], readings_schema(ONE)
        )

    return build


@pytest.fixture(scope="session")
def events_at(spark):
    """Point events from times, or (patient, time) pairs."""

    def build(*rows):
        full = [r if isinstance(r, tuple) else ("p", r) for r in rows]
        return spark.createDataFrame(
            [(p, at(t)) for p, t in full], "patient_id string, seizure_time timestamp_ntz"
        )

    return build


def rows(df, *columns):
    """Sorted tuples of the chosen columns."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
