"""The SQL of an operator gives the rows of its query, also where the smallest tables have few cases."""

import pytest
import twin

from flowlens.llm import queries


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_merkle_manifest", "op13_suffix_decontamination"])
def test_query_equals_its_sql(spark, folder, name):
    assert twin.compare(spark, twin.connect(folder), queries.QUERIES[name], queries.TWINS[name], folder) == []
