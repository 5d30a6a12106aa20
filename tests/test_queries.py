import pytest

from compare import compare
from siltstone.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    fn = registry.QUERIES[name]
    if name in registry.ORACLES:
        assert compare(spark, SF, fn, registry.ORACLES[name]) == ""
    else:
        assert fn(spark, SF).columns and fn(spark, SF).limit(1).collect()


def test_entry_without_the_llm_folders(spark):
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
