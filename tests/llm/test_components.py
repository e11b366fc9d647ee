"""Connected components: few edges do not cost a file for every shuffle partition and round."""

from larder.llm.common import components


def test_few_edges_lie_in_few_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        found = components(spark.createDataFrame([(i, i + 1) for i in range(60) if i != 30], "a long, b long"))
        rows = sorted(map(tuple, found.collect()))
        parts = found.rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert rows == [(i, 0 if i <= 30 else 31) for i in range(61)]
    assert parts <= 2
