import pytest

from colweave.llm.common import setup


@pytest.fixture(scope="session")
def llm_spark(spark):
    return setup(spark)
