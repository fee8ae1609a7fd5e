import pytest

from tests.llm.fixtures import edge_rows, write


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("edge"), edge_rows())


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [])


@pytest.fixture(scope="session")
def docs():
    """doc_id to text of the small driver table."""
    import duckdb

    return dict(duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id").fetchall())
