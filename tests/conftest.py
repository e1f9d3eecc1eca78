import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from claimloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", partitions=4, app="tests")
    yield session
    session.stop()


SPAN = "array<struct<start:int,end:int,claim_type:string,text:string>>"
PRED = "array<struct<start:int,end:int,claim_type:string,text:string,confidence:double>>"
