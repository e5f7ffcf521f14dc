import hashlib

import pytest


@pytest.fixture(scope="session")
def sha():
    return lambda raw: hashlib.sha256(raw).hexdigest()


@pytest.fixture
def tables(tmp_path):
    """Write DataFrames as the tables of a folder: ``tables(documents=df)`` gives the folder."""

    def write(**frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
