"""Every registered query against its SQL, on the small tables."""

import pytest

import check
from evolens import catalog

QUERIES = catalog.queries()
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    return check.connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, folder, duck):
    df = QUERIES[name](spark, folder)
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLES:
        same, note = check.compare(duck, df, ORACLES[name])
        assert same, note
    else:
        assert df.count() > 0


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert not [n for n in QUERIES if "pipeline" in n]


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["repo_name", "file_path", "n_commits"]


DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", ["features_all", "before_after_delta", "selection_quality", "validate_text"])
def test_types(name, spark, folder, duck):
    spark_types = {c: DUCK_TYPES[t] for c, t in QUERIES[name](spark, folder).dtypes}
    duck_types = {r[0]: r[1] for r in duck.execute("DESCRIBE " + ORACLES[name]).fetchall()}
    assert spark_types == duck_types
