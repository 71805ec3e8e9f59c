"""Memory of the driver: what training lays out, and what is given back between jobs."""

import os
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from rowloom.llm import common, langid


def anonymous_mb(pid):
    with open(f"/proc/{pid}/smaps_rollup") as f:
        return int(re.search(r"\nAnonymous:\s+(\d+)", f.read())[1]) / 1024


def leave_freed_memory(jvm, n=600):
    """Have the JVM free most of many small pieces of native memory, so that malloc keeps all of it; the pieces that stay."""
    rest, noise = [], bytearray(os.urandom(1 << 16))
    for k in range(n):
        d = jvm.java.util.zip.Deflater()
        d.setInput(noise)
        d.finish()
        d.deflate(bytearray(1 << 17))
        rest.append(d)
    for k, d in enumerate(rest):
        if k % 20:
            d.end()
    return rest[::20]


def test_cut_gives_the_drivers_freed_memory_back(spark):
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    common.cut(spark.range(3))
    rest = leave_freed_memory(jvm)
    before = anonymous_mb(pid)
    assert sorted(r.id for r in common.cut(spark.range(3)).collect()) == [0, 1, 2]
    assert anonymous_mb(pid) < before - 40
    for d in rest:
        d.end()


def test_training_lays_its_rows_out_once():
    rng, n = np.random.default_rng(1), 800
    x = rng.random((n, langid.DIMS), np.float32)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float16)
    langs = [["en", "fr", "ru", "zh", "fi", "tr", "hi", "ar"][k % 8] for k in range(n)]
    rows = pa.table({"l": pa.array(langs), "x": pa.array([r.tobytes() for r in x], pa.binary())})
    tracemalloc.start()
    try:
        model = langid.Model(*langid.assemble(rows), ones=True)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.5 * 4 * n * (langid.DIMS + 1)
    order = sorted(range(n), key=lambda k: (langs[k], x[k, :8].astype(np.float32).tobytes()))
    plain = langid.Model(x.astype(np.float32)[order], [langs[k] for k in order])
    assert model.langs == plain.langs and model.floor == plain.floor
    assert np.array_equal(model.family_w, plain.family_w) and all(np.array_equal(model.pairs[k], plain.pairs[k]) for k in plain.pairs)
