import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from rowloom.llm import chat, langid, quality, simhash
docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
assert quality.assess(docs, None).count() == 2
assert {{r.component_id for r in simhash.near_duplicates(docs).collect()}} == {{1}}
assert langid.recognised(docs, None).count() == 0
assert chat.digests(chat.render(chat.canonical_json(chat.probe(spark), "conv_id", "record"))).count() == 1
print("shipped")
"""


def test_workers_need_not_share_the_drivers_path(tmp_path):
    root = str(Path(__file__).resolve().parents[2])
    got = subprocess.run([sys.executable, "-c", CODE.format(root=root)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "shipped" in got.stdout, got.stderr[-2000:]
