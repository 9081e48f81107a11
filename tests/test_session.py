import os
import subprocess
import sys

import pytest

FOLDER = os.environ.get("FLOWLENS_TABLES", "/root/testdata/sf0.001")
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

JOB = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from flowlens.session import build_session
spark = build_session("elsewhere", "local[2]", **{"spark.checkpoint.dir": sys.argv[3], "spark.sql.shuffle.partitions": "4"})
print("rows", entry.queries()["b14_drop_correlated"](spark, sys.argv[2]).count())
"""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
def test_workers_find_the_package_from_another_folder(folder):
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", JOB, REPO, FOLDER, f"{folder}/shared"], cwd=folder, env=clean,
                          capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "rows" in done.stdout, done.stderr[-2000:]


def test_queries_without_a_library_of_the_corpus_operators():
    import subprocess
    import sys
    from pathlib import Path
    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; n = list(e.queries()); print(len(n), [x for x in n if x.startswith('op')])"
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    n, _, names = said.stdout.strip().partition(" ")
    assert int(n) > 150 and names == "[]", said.stderr
