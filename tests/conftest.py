import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest

from caselink.schema import CASE_COLUMNS, CASE_SCHEMA
from caselink.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    # The plans are wide and the tables tiny: compiling them would take most of the time.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    return session


@pytest.fixture(scope="session")
def make_cases(spark):
    """Build a case table from dicts; columns left out are null."""

    def build(*rows):
        return spark.createDataFrame([tuple(r.get(c) for c in CASE_COLUMNS) for r in rows], CASE_SCHEMA)

    return build
