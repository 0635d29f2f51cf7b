"""Memory that the driver gives back between the steps of a long chain."""

import gc
import re
import time
from pathlib import Path

import pytest

from knotwork.runtime import release


def test_freed_native_memory_leaves_the_driver(spark):
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    if not status.exists():
        pytest.skip("resident memory is read from /proc")
    resident = lambda: int(re.search(r"RssAnon:\s+(\d+)", status.read_text())[1]) / 1024
    release(spark)
    # small buffers come from the C library's arenas; every 16th stays, so that no arena is free as a whole
    buffers = [jvm.java.nio.ByteBuffer.allocateDirect(1 << 16) for _ in range(3200)]
    held = resident()
    buffers = buffers[::16]
    for _ in range(3):  # buffers are freed a moment after they are collected
        gc.collect()
        release(spark)
        time.sleep(0.5)
    assert held - resident() > 100
