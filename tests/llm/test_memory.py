"""What a step holds at once, measured on rows of its own."""

import random
import tracemalloc

import pyarrow as pa

from galley.llm import lattice_lm, words


class _Task:
    @staticmethod
    def get():
        return _Task()

    def partitionId(self):
        return 0


def test_parts_of_a_batch_are_small(monkeypatch):
    monkeypatch.setattr(lattice_lm, "TaskContext", _Task)
    monkeypatch.setattr(words, "_powers", {})
    rand = random.Random(5)
    texts = [" ".join(str(int(rand.paretovariate(0.4)) % 99_999) for _ in range(500)) for _ in range(1500)]
    n = len(texts)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n)), pa.array(texts), pa.array([True] * n), pa.array([False] * n)], names=["doc_id", "text", "trains", "held_out"]
    )
    tracemalloc.start()
    text_rows, word_rows = lattice_lm._parts(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert text_rows.num_rows == n
    assert sum(word_rows.column("learned").to_pylist()) == 501 * n
    assert peak < 20 * batch.nbytes
