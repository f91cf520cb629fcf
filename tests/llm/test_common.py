"""What the driver holds between stages."""

from pathlib import Path

from convlens.llm import common


def test_the_drivers_jvm_gives_back_what_it_has_freed(spark):
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    held = lambda: next(int(x.split()[1]) for x in status.read_text().splitlines() if x.startswith("VmRSS")) / 1024
    jvm.System.gc()
    # Some 250 KB each outside the heap; those that stay keep the freed ones between them from going back by themselves.
    made = [jvm.java.util.zip.Deflater() for _ in range(800)]
    for i, x in enumerate(made):
        if i % 20:
            x.end()
    jvm.System.gc()
    before = held()
    common.collect_garbage(spark)
    after = held()
    for x in made[::20]:
        x.end()
    assert after < before - 50
