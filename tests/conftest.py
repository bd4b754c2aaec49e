import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

os.environ.setdefault("VIGIL_SCRATCH", tempfile.mkdtemp(prefix="vigil-tests-"))

from vigil.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", app="vigil-tests", shuffle_partitions=8,
                      extra={"spark.sql.warehouse.dir": os.path.join(os.environ["VIGIL_SCRATCH"], "wh")})
    yield s
    s.stop()
