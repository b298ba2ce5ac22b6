import pytest

from variantlake.llm.common import Workspace


@pytest.fixture
def work(spark):
    return Workspace(spark, "test")
