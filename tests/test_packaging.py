"""Work in Python workers from another working directory, where the package is on the driver's path alone."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from tallyshelf.session import build_session
spark = build_session("elsewhere", "local[2]")
from tallyshelf.plans import tables
from tallyshelf.operators import neighbours, tfidf
lines = spark.createDataFrame([("{{'user_id': u'a', 'items': [{{'item_id': '1' 'x', 'item_name': r'b'}}]}}",)], "value string")
rows = tables.flat_items(lines).collect()
docs = spark.createDataFrame([(1, "one two"), (2, "two three")], "id long, text string")
near = neighbours.nearest_to(docs.select("id"), tfidf.tfidf_vectors(docs), docs.select("id")).count()
print("FOUND", len(rows), rows[0]["item_id"], near)
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    run = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "FOUND 1 1x 2" in run.stdout, run.stderr[-2000:]
