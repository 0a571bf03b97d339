"""Queries of the training-data operators against SQL."""

import pytest

from echoline.llm import catalog
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    same_rows(catalog.QUERIES[name](spark, data), duck, catalog.ORACLES[name])


def test_nothing_else_imports_the_package():
    import pathlib

    import echoline

    root = pathlib.Path(echoline.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "echoline.llm" not in path.read_text()
