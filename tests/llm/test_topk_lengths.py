"""Top-k search over vectors of several lengths against brute force."""

import random

from lexarium.llm import topk


def test_each_length_is_searched(spark):
    rng = random.Random(9)
    rows = [(i, [rng.randint(-9, 9) for _ in range(2 if i % 4 == 0 else 5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.top_k(df, df.filter("vec_id % 3 = 0"), k=3, query_block=7).collect()
    want = []
    for q, x in rows[::3]:
        best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q and len(y) == len(x))
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best[:3], 1)]
    assert sorted(map(tuple, got)) == sorted(want)
