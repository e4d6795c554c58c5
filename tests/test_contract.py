"""The driver contract: names, flagship query and SQL agreement of every registered query."""

import re

import pytest

import __spark_entry__ as contract
import check

INVENTORY = (
    [f"S{i}" for i in range(1, 15)] + [f"P{i}" for i in range(1, 25)] + [f"J{i}" for i in range(1, 10)]
    + [f"A{i}" for i in range(1, 9)] + [f"W{i}" for i in range(1, 4)] + [f"L{i}" for i in range(1, 7)]
    + [f"U{i}" for i in range(1, 4)] + [f"F1{c}" for c in "abcdef"] + [f"F{i}" for i in range(2, 10)]
    + [f"Q{i}" for i in range(1, 8)] + ["T1"]
)


def test_every_inventory_id_has_a_query_with_sql():
    own = {name for name in contract.queries() if re.match(r"[A-Z]\d", name)}
    ids = {re.match(r"[A-Z]\d+[a-f]?", name).group() for name in own}
    assert not set(INVENTORY) - ids
    assert own <= set(contract.oracle_sql()) <= set(contract.queries())


def test_flagship(spark):
    df = contract.entry(spark)
    assert df.columns == ["group_id", "id", "source", "target", "label", "fact"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(name for name in contract.oracle_sql() if re.match(r"[A-Z]\d", name)))
def test_agreement_with_sql(spark, sf_dir, name):
    good, note = check.compare(spark, check.connect(sf_dir), name, sf_dir)
    assert good, note
