import gc
import os
import re
import time
from pathlib import Path

import pytest

from eventlake.llm.shared import shrinking, written


@pytest.mark.skipif(not os.path.exists("/proc/self/status"), reason="reads the JVM's memory from /proc")
def test_tables_leave_no_freed_memory_with_the_drivers_jvm(spark):
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    resident = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) / 1024
    buffers = jvm.java.util.ArrayList()
    for _ in range(4000):
        buffers.add(jvm.java.nio.ByteBuffer.allocateDirect(1 << 16))
    last = buffers.get(3999)  # holds the end of what was allocated, so that the rest can't be cut off there
    del buffers
    for _ in range(3):
        gc.collect()
        jvm.System.gc()
        time.sleep(0.5)
    before = resident()
    written(spark, spark.range(10), "small")
    assert before - resident() > 100 and last is not None


@pytest.mark.skipif(not os.path.exists("/proc/self/status"), reason="reads the process's memory from /proc")
def test_workers_give_freed_memory_back():
    resident = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024
    ends = []

    def batches(it):
        for _ in it:
            held = [bytearray(b"x" * 60_000) for _ in range(4000)]
            ends.append(held[-1])  # what lies before can't be cut off
            yield len(held)
        del held

    start = resident()
    assert list(shrinking(batches)(iter([0]))) == [4000] and len(ends) == 1
    assert resident() - start < 100
