"""Time the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from textloom import plans  # noqa: E402
from textloom.session import build_session  # noqa: E402

HEADLINE = (
    "t10_tokenize",
    "f02_sentences",
    "a07_sentence_lengths",
    "d04_vocabulary",
    "f01_post_words",
    "f03_user_moods",
    "w06_tfidf",
    "e04_sentence_vectors",
    "q03_semantic_topk",
    "q05_batch",
    "q07_multi_query",
    "k03_ranked_search",
    "m05_auc",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        began = time.time()
        plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))[2:]}))
    spark.stop()


if __name__ == "__main__":
    main()
