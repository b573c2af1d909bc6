import pytest

from provenor.llm.queries import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def model(spark):
    from provenor.llm.fertility import model_bytes
    from provenor.llm.queries import PIECE_MODEL

    return model_bytes(spark, PIECE_MODEL)
