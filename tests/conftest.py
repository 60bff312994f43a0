import os
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")]).rstrip(os.pathsep)
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

import pytest  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from keelson.session import local_session

    made = local_session(8, 4, "4g")
    made.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF
