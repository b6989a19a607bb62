from __future__ import annotations

import __spark_entry__


def test_entry_and_registries(spark):
    assert __spark_entry__.entry(spark).columns == ["sid", "y_rare"]
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known) and len(known) > 70
