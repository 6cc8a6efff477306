from __future__ import annotations

import ast
import pathlib
import types

import pytest

from lumenframe.llm import scratch

LLM = pathlib.Path(scratch.__file__).parent


def session(**conf):
    held = dict(conf)
    get = lambda k, d=None: held.get(k, d)
    return types.SimpleNamespace(conf=types.SimpleNamespace(get=get, set=held.__setitem__))


def test_folder_is_read_from_the_session():
    assert scratch.shared_dir(session(**{"spark.checkpoint.dir": "s3a://x/y/", "spark.master": "yarn"})) == "s3a://x/y"


@pytest.mark.parametrize("master", ["yarn", "spark://a:7077", "local-cluster[2,1,1024]", "k8s://x"])
def test_a_cluster_must_name_a_folder(master):
    with pytest.raises(ValueError):
        scratch.shared_dir(session(**{"spark.master": master}))


def test_a_local_session_gets_one_of_its_own():
    spark = session(**{"spark.master": "local[2]"})
    assert scratch.shared_dir(spark) == scratch.shared_dir(spark)


def test_tables_are_written_and_discarded(spark):
    a = scratch.materialize(spark.range(3), "t")
    b = scratch.materialize(spark.range(4), "t")
    assert (a.count(), b.count()) == (3, 4)
    scratch.discard(a)
    scratch.discard(None)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(a._lumen_path).count()
    assert b.count() == 4


def test_nothing_else_imports_the_subpackage():
    root = LLM.parent
    for path in root.rglob("*.py"):
        if LLM not in path.parents:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), path


def test_no_local_checkpoints_or_swallowed_imports():
    for path in [*LLM.glob("*.py"), LLM.parent.parent / "corpus_pipeline.py"]:
        text = path.read_text() if path.exists() else ""
        assert "localCheckpoint" not in text and "ImportError" not in text


@pytest.mark.parametrize("name", ["mixing", "pseudonyms", "quality", "urlfilter", "bloom"])
def test_native_operators_use_no_python_functions(name):
    text = (LLM / f"{name}.py").read_text()
    for word in ("udf", "mapIn", "applyIn", ".rdd", "import pandas", "import pyarrow", "toPandas"):
        assert word not in text, (name, word)
