"""Plans that grow with their input: work dealt over all cores."""

from declara.plans.bridges import spread, table, view


def test_narrow_table_is_dealt_before_rowwise_work(spark, data):
    cores = spark.sparkContext.defaultParallelism
    assert table(spark, data, "part").rdd.getNumPartitions() < cores
    rows = view(spark, data, "label_text", "part")
    assert rows.rdd.getNumPartitions() >= 3 * cores
    assert rows.count() == table(spark, data, "part").count()


def test_few_splits_of_texts_are_dealt(spark, data):
    docs = table(spark, data, "documents")
    assert spread(docs).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    many = docs.repartition(40)
    assert spread(many) is many
