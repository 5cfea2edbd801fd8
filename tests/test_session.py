"""Work folders of a scope go when it ends."""

import os
import subprocess
import sys

import pytest

from tracewell.session import materialize, scope, work_dir


def test_scope_removes_its_work_folders(spark, tmp_path):
    with scope(spark) as outer:
        kept = materialize(spark.range(9), "a")
        with pytest.raises(RuntimeError), scope(spark) as inner:
            assert inner.startswith(outer) and materialize(spark.range(3), "b").count() == 3
            raise RuntimeError
        assert not os.path.exists(inner) and kept.count() == 9
        kept.write.parquet(f"{tmp_path}/out")
    assert not os.path.exists(outer) and spark.read.parquet(f"{tmp_path}/out").count() == 9
    assert not work_dir(spark, "c").startswith(outer)


@pytest.mark.parametrize("missing, fine", [("corpus_pipeline", True), ("tracewell.llm.queries", True), ("some_library", True), ("tracewell.operators.absent", False)])
def test_the_optional_part_may_be_absent_but_not_broken(missing, fine):
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        f"        if name == 'corpus_pipeline': raise ModuleNotFoundError('gone', name={missing!r})\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'verdicts' in e.queries() and 'pipeline' not in e.queries()\n"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert (done.returncode == 0) == fine
