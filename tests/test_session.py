"""Intermediate tables and who removes them."""

from fleetlens import session


def test_tables_are_stored_and_discarded(spark):
    rows = session.written(spark.range(5), "test-discard")
    assert rows.count() == 5
    path = session._GIVEN[spark.sparkContext.applicationId][-1]
    assert "test-discard" in path
    kept = session._GIVEN[spark.sparkContext.applicationId][:-1]
    session._GIVEN[spark.sparkContext.applicationId] = [path]
    assert session.discard_tables(spark) == 1
    session._GIVEN[spark.sparkContext.applicationId] = kept
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
