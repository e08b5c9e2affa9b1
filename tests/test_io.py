import pytest

from checks.fixtures import grants
from rosterlink.operators.classifying import classify_with_provenance
from rosterlink.operators.normalizing import normalize_grants
from rosterlink.sources import tables
from rosterlink.streaming import intake
from tests.conftest import SMALL


def test_csv_with_newlines_quotes_and_bad_bytes(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_bytes(b'ref_number,name\n007,"two\nlines"\n008,"say ""hi"""\n009,caf\xe9\n010,\n')
    rows = tables.read_grants_csv(spark, str(path), ["ref_number", "name"]).collect()
    assert [tuple(r) for r in rows] == [
        ("007", "two\nlines"), ("008", 'say "hi"'), ("009", "caf�"), ("010", None)]


def test_stage_is_overwritten(spark, tmp_path):
    path = str(tmp_path / "stage")
    for n in (5, 3):
        tables.write_stage(spark.range(n).selectExpr("id", "id % 2 AS k"), path, ["k"])
    assert tables.read_stage(spark, path, ["id"]).count() == 3


def test_tables_are_written_to_the_shared_folder(spark):
    written = tables.materialize(spark.range(3), "x")
    assert all(f.startswith("file:" + spark.conf.get("spark.checkpoint.dir")) for f in
               [x.replace("file://", "file:") for x in written.inputFiles()])


def test_stream_and_batch_agree(spark, tmp_path):
    raw = grants(spark, SMALL)
    raw.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    query = intake.append_labelled(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = classify_with_provenance(normalize_grants(spark.read.parquet(str(tmp_path / "in"))))
    columns = ["gid", "ref_number", "recipient_type_new", "recipient_type_source"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, batch.select(*columns).collect()))


def test_no_shared_folder_on_a_cluster():
    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host"

    with pytest.raises(ValueError):
        tables.shared_folder(Elsewhere)
