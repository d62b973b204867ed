"""The registry imports anywhere: without PySpark's jars folder in reach, and without the training-data package."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as E
from tabsmith.plans import catalog_features

ROOT = Path(E.__file__).resolve().parent

NO_JARS = """
import sys
def hook(event, args):
    if event in ("open", "os.listdir", "os.scandir") and "/jars" in str(args[0]):
        raise PermissionError(args[0])
sys.addaudithook(hook)
"""
NAMES = "import json, __spark_entry__ as E; print(json.dumps([sorted(E.queries()), sorted(E.oracle_sql())]))"


def names(folder, before=""):
    done = subprocess.run([sys.executable, "-c", before + NAMES], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    return json.loads(done.stdout.splitlines()[-1])


def test_import_reads_no_jar():
    assert names(ROOT, NO_JARS) == [sorted(E.queries()), sorted(E.oracle_sql())]


def test_registry_stands_without_the_training_data_package(tmp_path):
    for name in ("tabsmith", "__spark_entry__.py", "corpus_pipeline.py"):
        if not (ROOT / name).exists():
            continue
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=lambda d, fs: [f for f in fs if f in ("llm", "__pycache__")])
        else:
            shutil.copy(ROOT / name, tmp_path / name)
    queries, sql = names(tmp_path)
    assert set(sql) <= set(queries) and len(queries) > 150
    assert not [q for q in queries if q.startswith("op") or q == "pipeline"]


def test_stop_words_of_the_sql_are_those_of_the_operator(spark):
    from tabsmith.operators.features import default_stop_words
    assert sorted(catalog_features.STOP_WORDS) == sorted(default_stop_words())
