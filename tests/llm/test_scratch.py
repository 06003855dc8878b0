"""Intermediate tables go, results stay."""

import os

from runlore.llm.common import scratch, written


def test_scratch(spark):
    df = spark.range(3)
    folder = lambda d: d.inputFiles()[0].removeprefix("file:").rpartition("/")[0]
    free = written(df, "free")
    with scratch(spark):
        with scratch(spark):
            with scratch(spark):
                inner, up = written(df, "inner"), written(df, "up", keep=True)
                paths = folder(inner), folder(up)
            assert not os.path.isdir(paths[0]) and up.count() == 3
            kept = written(df, "kept", keep=True)
            inner_most = folder(kept)
        assert not os.path.isdir(paths[1]) and kept.count() == 3
        last = written(df, "last", keep=True)
    assert not os.path.isdir(inner_most) and last.count() == 3 and free.count() == 3
