"""Token files hold all that reading them takes."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

from stemma.llm import token_binary, tokens

READ = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
from stemma.llm import token_binary
for r in token_binary.read_token_blocks(spark, {path!r}).orderBy("start").collect():
    print(r["doc_id"], r["start"], *r["ids"])
"""


def test_a_fresh_session_reads_the_path_alone(spark):
    from tokenizers import Tokenizer

    rows = [(5, "a river of stone"), (None, "no key"), (3, None), (9, "word " * 5000), (9, "x"), (None, ""), (-(2**63), "least")]
    path = token_binary.write_token_blocks(spark.createDataFrame(rows, "doc_id long, text string"), block_ids=300)
    root = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))}
    said = subprocess.run([sys.executable, "-c", READ.format(root=root, path=path)], capture_output=True, text=True, timeout=300, env=env).stdout
    got = [line.split(" ") for line in said.splitlines() if line and (line[0].isdigit() or line[0] in "-N")]
    library = Tokenizer.from_file(tokens.default_path())
    want = sorted((str(k), [*library.encode(t or "", add_special_tokens=False).ids, 0]) for k, t in rows)
    assert sorted((k, [int(x) for x in ids]) for k, _, *ids in got) == want
    at = 0
    for _, start, *ids in got:
        assert int(start) == at
        at += len(ids)
    assert [k for k, *_ in got] == ["None", "None", str(-(2**63)), "3", "5", "9", "9"]
