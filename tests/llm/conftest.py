import os
import sys

import pytest
from panelstats.llm.common import ship

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))  # plain versions beside the tests


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)
