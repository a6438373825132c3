"""Reading tables, folders for written data, and session settings."""

from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quernwork.plans import registered
from quernwork.session import TARGET_PARTITION_BYTES, build_session, shuffle_partitions
from quernwork.sources import Tables, ensure_checkpoint_dir, new_folder
from quernwork.sources.schemas import SCHEMAS

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", SCHEMAS)
def test_schema_is_that_of_the_file(spark, name):
    found = spark.read.parquet(f"{FOLDER}/{name}.parquet").schema
    assert Tables(spark, FOLDER).read(name).schema == found


def test_columns_and_unknown_tables(spark):
    tables = Tables(spark, FOLDER + "/")
    assert tables.read("nation", "n_name").columns == ["n_name"]
    assert tables.read("labels").columns == ["doc_id", "quality", "toxic"]


def test_a_lacking_column_is_an_error(spark, tmp_path):
    Tables(spark, FOLDER).read("region").drop("r_name").write.parquet(f"{tmp_path}/region.parquet")
    with pytest.raises(ValueError, match="lacks r_name"):
        Tables(spark, str(tmp_path)).read("region")


def test_props_that_are_no_numbers_are_nulls(spark, tmp_path):
    events = Tables(spark, FOLDER).read("events").limit(2)
    props = F.when(F.col("event_id") % 2 == 0, '{"k": "x"}').otherwise('{"k": 3}')
    events.withColumn("event_type", F.lit("t")).withColumn("props", props).write.parquet(
        f"{tmp_path}/events.parquet"
    )
    found = registered()["props_by_type"].run(Tables(spark, str(tmp_path))).first()
    assert (found["n_k"], found["sum_k"]) == (1, 3)


def test_partitions_are_set_only_from_a_size():
    set_ = []
    builder = SimpleNamespace(getOrCreate=lambda: None)
    builder.appName = lambda app: builder
    builder.config = lambda key, value: set_.append(key) or builder
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("quernwork.session.SparkSession", SimpleNamespace(builder=builder))
        build_session()
        assert "spark.sql.shuffle.partitions" not in set_
        assert "spark.cleaner.referenceTracking.cleanCheckpoints" in set_
        build_session(shuffled_bytes=10 * 2**40, cores=400)
        assert "spark.sql.shuffle.partitions" in set_


def test_a_table_may_be_a_folder_of_files(spark, tmp_path):
    events = Tables(spark, FOLDER).read("events")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    tables = Tables(spark, str(tmp_path))
    assert tables.read("events").count() == events.count()
    sink = str(tmp_path / "sink")
    query = (
        tables.stream("events", max_files=1).writeStream.format("parquet").option("path", sink)
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.read.parquet(sink).count() == events.count()
    assert len(list(Path(tmp_path / "checkpoint" / "offsets").glob("[0-9]*"))) == 3


def test_new_folders_lie_in_the_shared_folder_and_differ(spark):
    shared = ensure_checkpoint_dir(spark)
    one, other = new_folder(spark, "x"), new_folder(spark, "x")
    assert one != other
    assert one.startswith(shared.rstrip("/") + "/")


def test_a_cluster_without_a_shared_folder_is_refused():
    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf={})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(session)


def test_the_folder_the_session_names_is_used():
    chosen = []
    context = SimpleNamespace(
        master="yarn",
        getCheckpointDir=lambda: chosen[0] if chosen else None,
        setCheckpointDir=chosen.append,
    )
    session = SimpleNamespace(sparkContext=context, conf={"spark.checkpoint.dir": "hdfs://shared/x"})
    assert ensure_checkpoint_dir(session) == "hdfs://shared/x"
    assert chosen == ["hdfs://shared/x"]


def test_shuffle_partitions():
    assert shuffle_partitions(0, 8) == 8
    assert shuffle_partitions(10 * TARGET_PARTITION_BYTES + 1, 8) == 11
    assert shuffle_partitions(10 * 2**40, 4000) == 52429
