import os

from quillspan.session import checkpoint_dir, cut, release, stored


def test_stored_rows_come_back_and_go(spark):
    df = stored(spark.createDataFrame([(1, "a", None), (2, None, [b"x"])], "i int, s string, b array<binary>"))
    assert df.count() == 2 and df.schema.simpleString() == "struct<i:int,s:string,b:array<binary>>"
    path = df._stored_path.removeprefix("file:")
    assert os.path.isdir(path) and df._stored_path.startswith(checkpoint_dir(spark).rstrip("/"))
    release(df)
    assert not os.path.exists(path)
    release(spark.range(1))


def test_cut_keeps_rows(spark):
    assert cut(spark.range(5)).count() == 5


def test_a_cluster_must_name_its_checkpoint_folder(spark, monkeypatch):
    from types import SimpleNamespace

    import pytest

    from quillspan import session

    unset = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True))
    sc = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda *_: None), _jsc=SimpleNamespace(sc=lambda: unset), master="spark://host:7077")
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None)))
