"""The driver's entry points, with and without the training-data subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_names():
    import __spark_entry__

    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_imports_without_the_subpackage(tmp_path):
    for folder, _, names in os.walk(os.path.join(ROOT, "lattica")):
        if "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    to = tmp_path / os.path.relpath(folder, ROOT)
                    to.mkdir(parents=True, exist_ok=True)
                    (to / n).write_text(open(os.path.join(folder, n)).read())
    (tmp_path / "__spark_entry__.py").write_text(open(os.path.join(ROOT, "__spark_entry__.py")).read())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bfs' in q and not any(k.startswith('op') for k in q); assert 'pipeline' not in q"
    env = {**os.environ, "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
