"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from glossa.plans.registry import queries
from glossa.session import local_session

NAMES = ["tokenize", "detect_language", "lang_model", "doc_norm", "accuracy_by_lang", "bigram_counts", "train_test_split", "merge_consecutive_lines", "item_tag_window_4", "info_gain_root"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in NAMES:
        began = time.time()
        queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total query seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
