"""The bound of report tables."""

import pytest

from lexarium.sources import writers


def test_report_tables_are_whole(spark):
    assert writers.markdown("t", spark.range(1000)).count("\n| ") == 1001
    with pytest.raises(ValueError, match="more than 1,000"):
        writers.markdown("t", spark.range(1001))
