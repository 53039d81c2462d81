"""What the pipeline's Python workers hold once a task has ended."""

import re
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from pyspark.sql.classic.dataframe import DataFrame

from glyphflow.llm import language_id

HELD = """
import re
import pyarrow as pa
from glyphflow.llm.common import giving_back

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

kept = []
def f(batches):
    for batch in batches:
        parts = [bytearray(10_000) for _ in range(20_000)]
        kept.extend(parts[::500])  # here and there on the heap: what lies below stays the process's
        yield batch

before = held()
task = giving_back(f) if WITH else f
for _ in task(iter([pa.RecordBatch.from_arrays([pa.array([1])], names=["a"])])):
    pass
print(held() - before)
"""


def grown(wrapped: bool) -> float:
    out = subprocess.run([sys.executable, "-c", f"WITH = {wrapped}\n{HELD}"], cwd=Path(corpus_pipeline.__file__).parent, capture_output=True, text=True, check=True)
    return float(out.stdout)


def test_a_task_gives_its_memory_back():
    assert grown(False) > 100  # MB; else this shows nothing
    assert grown(True) < 30


def test_every_stage_gives_its_memory_back(spark, sf, monkeypatch):
    seen, plain = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *a, **b: (seen.append(f.__qualname__), plain(self, f, *a, **b))[1])
    monkeypatch.setattr(language_id, "learn", lambda docs: None)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 20")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf)
    assert len(seen) >= 10 and [x for x in seen if not re.match("giving_back", x)] == []
