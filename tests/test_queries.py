"""Every query of the core against its SQL, on the smallest tables."""

import pytest

from echoline.plans import catalog, scan
from tests.conftest import same_rows


_FOUND = {}


@pytest.fixture(autouse=True)
def groups_once(monkeypatch):
    """Queries share the tables of groups, which most of them begin with, to save time; each way to find them is run once."""
    find = scan.groups_of

    def once(spark, directory, min_lines=4, same_file=True):
        key = (directory, min_lines, same_file)
        if key not in _FOUND:
            _FOUND[key] = find(spark, directory, min_lines, same_file)
        return _FOUND[key]

    monkeypatch.setattr(scan, "groups_of", once)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    same_rows(catalog.QUERIES[name](spark, data), duck, catalog.ORACLES[name])


def test_queries_without_sql(spark, data):
    """Those on documents of changing shape: stated cases are in test_schema_drift; here they run over whole tables."""
    assert catalog.QUERIES.keys() - catalog.ORACLES.keys() == {"p1_found", "p1_types", "p1_table", "p1_union"}
    deliveries = spark.read.parquet(f"{data}/report_files.parquet").where("payload LIKE '{%}'").count()
    given = {r.field_path for r in spark.read.parquet(f"{data}/report_fields.parquet").collect()}
    kinds = {r.change_kind for r in catalog.QUERIES["p1_found"](spark, data).collect()}
    assert kinds and kinds <= {"added", "removed", "renamed", "retyped"}
    assert given <= {r.field_path for r in catalog.QUERIES["p1_types"](spark, data).collect()}
    for name in ("p1_table", "p1_union"):
        table = catalog.QUERIES[name](spark, data)
        assert 0 < table.count() <= deliveries
        assert {"delivery_id", "feed", "run_no", "unheld", *(p for p in given if "." not in p)} == set(table.columns)


def test_entry_imports_without_the_training_operators():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
