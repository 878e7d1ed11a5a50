import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

@pytest.fixture(scope="session")
def spark():
    from shipledger.session import get_spark, stage_root

    s = get_spark("local[4]", partitions=4, app="shipledger-tests")
    stage_root(s)  # a private temporary stage folder (the session has none configured)
    yield s


@pytest.fixture(scope="session")
def fixture_build(spark):
    from shipment_rows import COLS, FIXTURE

    from shipledger.plans.build import build_from_frames

    df = spark.createDataFrame(FIXTURE, ", ".join(f"{c} string" for c in COLS))
    return build_from_frames(spark, {"wms_export.csv": df})
