import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from milemark import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("spark") / "warehouse"
    s = session.local("tests", 4, "4g", spark_sql_warehouse_dir=str(warehouse))
    yield s
    s.stop()
