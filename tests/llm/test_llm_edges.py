import pytest

import __spark_entry__ as entry
from gridquill.llm import queries as llm
from tests.conftest import holds_on_variants


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_nulls_empty_tables_and_clashing_names(spark, small, variants, name):
    holds_on_variants(entry.queries()[name], spark, small, variants)
