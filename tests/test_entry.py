import inspect
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_a_query():
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known)
    assert all(len(inspect.signature(f).parameters) == 2 for f in known.values())


def test_imports_without_the_training_part():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('linkmill.llm', 'corpus_pipeline')):\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert 'baseline' in q and 'pipeline' not in q and not any(n[:2] == 'op' and n[2].isdigit() for n in q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_a_missing_library_is_not_hidden():
    code = (
        "import sys\n"
        "sys.modules['linkmill.llm'] = None\n"
        "import __spark_entry__ as e\n"
        "assert 'baseline' in e.queries()\n"
        "del sys.modules['linkmill.llm']\n"
        "import importlib\n"
        "def missing(name): raise ModuleNotFoundError('no', name='tokenizers')\n"
        "importlib.import_module = missing\n"
        "try:\n    e.queries()\nexcept ModuleNotFoundError:\n    sys.exit(0)\nsys.exit(1)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(0 <= r.f05 <= 1 for r in rows)
