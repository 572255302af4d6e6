from bidlake import common
from bidlake.plans.views import raw_contracts

SF = "/root/testdata/sf0.001"


def test_shuffles_of_large_tables_have_as_many_partitions_as_the_files_need(spark, monkeypatch):
    before = {c: spark.conf.get(c) for c in (common.PARTITIONS, common.ADVISORY, common.SPLIT)}
    try:
        raw_contracts(spark, SF)
        assert spark.conf.get(common.PARTITIONS) == before[common.PARTITIONS]  # small tables need no more
        monkeypatch.setattr(common, "PARTITION_BYTES", 4 << 10)
        raw_contracts(spark, SF)
        assert int(spark.conf.get(common.PARTITIONS)) > int(before[common.PARTITIONS]) and spark.conf.get(common.ADVISORY) == "8192b" and spark.conf.get(common.SPLIT) == "4096b"
        spark.conf.set(common.PARTITIONS, "1000")
        spark.conf.set(common.ADVISORY, "4k")
        raw_contracts(spark, SF)
        assert spark.conf.get(common.PARTITIONS) == "1000" and spark.conf.get(common.ADVISORY) == "4k"
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
