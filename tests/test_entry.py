from __future__ import annotations

import __spark_entry__


def test_entry_and_names(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and {r["mode"] for r in df.collect()} <= {"Motor", "Foot", None}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
