import pytest


@pytest.fixture(scope="session")
def vocab():
    import public_tokenizers

    return public_tokenizers.path
