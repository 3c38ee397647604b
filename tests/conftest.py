import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from opsward.session import local_session
    s = local_session("*", app="opsward-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="opsward-test-ckpt-")})
    yield s
    s.stop()


def _key(t):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in t)


def rows(df, *cols):
    """Order-insensitive, NULL-safe row list."""
    cols = cols or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_key)
