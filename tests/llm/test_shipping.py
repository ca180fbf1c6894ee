"""Functions that run in tasks travel by value: they work where the package cannot be imported."""

import subprocess
import sys

from pyspark import cloudpickle

from foliotab.llm import linedup, neardup

CODE = """
import pickle, sys
sys.modules["foliotab"] = None
import pyarrow as pa
runs = pickle.load(open(sys.argv[1], "rb"))
text = "one line of quite a few words, longer than most of the others here\\nshort words in this second line"
batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, None])], names=["doc", "text"])
for run in runs:
    print(sum(len(b) for b in run(iter([batch]))))
"""


def test_blind_worker(tmp_path):
    runs = [linedup._scan(5, False, 0.9), linedup._scan(5, True), neardup._signatures(5, 256)]
    (tmp_path / "runs").write_bytes(cloudpickle.dumps(runs))
    out = subprocess.run([sys.executable, "-I", "-c", CODE, str(tmp_path / "runs")], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.split() == ["2", "2", "2"], out.stderr
