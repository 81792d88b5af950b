"""Workers outlive their tasks: what a task has freed must not stay with them."""

import ctypes
import subprocess
import sys
from pathlib import Path

import public_tokenizers
import pytest
from pyspark import cloudpickle

from tallyfold.llm.packing import tokenised

WORKER = """
import ctypes, pickle, re, sys
import numpy as np
import pyarrow as pa

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    rng = np.random.default_rng(3)
    for k in range(10):
        letters = rng.integers(97, 123, (400, 5000), dtype=np.uint8)
        letters[rng.random(letters.shape) < 0.15] = 32
        yield pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([x.tobytes().decode() for x in letters])], ["doc_id", "text"])

run = pickle.load(open(sys.argv[1], "rb"))
print(sum(out.num_rows for out in run(batches())))
after = held()
pa.default_memory_pool().release_unused()
ctypes.CDLL(None).malloc_trim(0)
print(after - held())
"""


class TakenFunction:
    """Stands for a DataFrame and keeps the function that tasks would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="glibc only")
def test_packing_task_gives_freed_memory_back(spark, tmp_path):
    taken = tokenised(TakenFunction(), public_tokenizers.path("word_bpe_49k.json"), 2)
    (tmp_path / "run").write_bytes(cloudpickle.dumps(taken.run))
    root = Path(__file__).parents[2]
    said = subprocess.run([sys.executable, "-c", WORKER, tmp_path / "run"], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) >= 10 * 400
    assert float(said[1]) < 15  # MB
