"""Numbers of random draws."""

import __spark_entry__

DATA = "/root/testdata"


def test_draws_of_bootstrap_jsd(spark):
    rows = __spark_entry__.queries()["bootstrap_jsd"](spark, f"{DATA}/sf0.01").collect()
    assert rows
    for r in rows:  # p counts 1,000 permutations, the percentile 300 draws
        assert abs(r.p * 1001 - round(r.p * 1001)) < 1e-6 and abs(r.percentile * 3 - round(r.percentile * 3)) < 1e-6
    assert any(abs(r.p * 201 - round(r.p * 201)) > 1e-6 for r in rows)
