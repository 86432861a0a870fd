"""Driver contract: entry(), queries(), oracle_sql()."""

from __future__ import annotations

import __spark_entry__ as E
from linkwatch.plans import catalog


def test_entry_flagship(spark):
    df = E.entry(spark)
    assert df.columns == ["target_host", "start_time", "end_time", "duration_seconds"]
    assert df.schema.simpleString() == (
        "struct<target_host:string,start_time:timestamp_ntz,end_time:timestamp_ntz,duration_seconds:double>"
    )
    assert df.count() > 0


def test_registry_consistent():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    own, own_sql = catalog.queries(), catalog.oracle_sql()
    assert len(own) >= 80 and set(own) <= set(qs)
    assert set(own) == set(own_sql)  # each has its SQL


def test_without_the_corpus_operators(tmp_path):
    """The other queries stand without the llm subpackage and the pipeline."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py", "linkwatch"):
        src = os.path.join(root, name)
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 80 and not any(k.startswith('op') for k in q); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.strip() == "fine", done.stderr[-500:]
