"""Buckets of op2 are compared share by share: the same starts go, in a bounded part of the memory."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from dataprobe.llm import suffix_dedup
from dataprobe.llm.runs import LENGTH


def test_shares_of_a_bucket(spark):
    rng = random.Random(3)
    words = [f"{rng.getrandbits(24):x}" for _ in range(3000)]
    lines = [" ".join(rng.choice(words) for _ in range(16)) for _ in range(2500)]
    texts = ["; ".join(rng.choice(lines) for _ in range(200)).encode() for _ in range(50)]
    packed = [suffix_dedup._packed(t) for t in texts]
    every = np.arange(max(map(len, texts)), dtype=np.uint32)
    counts = [len(suffix_dedup.runs(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0]) for t in texts]
    rows = spark.createDataFrame([(i, bytearray(p), bytearray(every[:n].tobytes()), i) for i, (p, n) in enumerate(zip(packed, counts, strict=True))], "id bigint, text binary, runs binary, k1 bigint")
    table = suffix_dedup._run_texts(rows.repartition(3), 1).toArrow()
    tracemalloc.start()
    found = suffix_dedup._removed_starts(4)((), table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    gone = {i: np.zeros(len(t), bool) for i, t in enumerate(texts)}
    ids, keys = suffix_dedup._join(found["ids"], np.int64), suffix_dedup._join(found["keys"], np.int64)
    for i, k, f, n in zip(ids.tolist(), keys.tolist(), *(suffix_dedup._join(found[c], np.uint32).tolist() for c in ("firsts", "sizes")), strict=True):
        assert i == k and n > 0
        gone[i][f : f + n] = True
    seen = set()
    for i, t in enumerate(texts):
        own = [t[j : j + LENGTH] for j in range(len(t) - LENGTH + 1)]
        assert gone[i][: len(own)].tolist() == [s in seen for s in own]
        seen.update(own)
    assert isinstance(table, pa.Table) and peak < 150e6, peak
