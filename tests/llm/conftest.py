import pytest


@pytest.fixture(autouse=True)
def _tables(spark, tmp_path_factory):
    """Every session has its shared folder; tables that operators write are deleted after a test."""
    yield
    from weftline.llm.common import release

    release()
