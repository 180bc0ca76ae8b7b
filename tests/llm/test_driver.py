"""What operators leave with the driver."""

import random
import re
import time
from pathlib import Path

from corpus_rows import table_of, words

from vectide.llm import langid, near_dedup


def own_mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_training_gives_memory_back(spark):
    rng = random.Random(3)
    rows = [(k, words(rng, 1500), f"l{k % 3}", "s") for k in range(900)]
    docs = table_of(spark, rows)
    langid.train(docs.limit(30))
    before = own_mb()
    models = langid.train(docs)
    del models
    assert own_mb() - before < 25


def test_near_duplicates_leave_no_broadcasts(spark, odd):
    used = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().memoryStore().memoryUsed
    before = used()
    out = near_dedup.near_duplicates(odd)
    end = time.time() + 20
    while used() > before + (1 << 20) and time.time() < end:
        time.sleep(0.5)
    assert used() <= before + (1 << 20)
    assert out.count() == odd.count()
