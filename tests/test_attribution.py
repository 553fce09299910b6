"""Attribution of quotes: candidates come from all significant words."""

from __future__ import annotations

import random

from leafmill.plans.searches import QUERIES


def test_altered_start(spark, tmp_path):
    r = random.Random(5)
    texts = [" ".join("".join(r.choices("bcdfglmnrstaeiou", k=7)) for _ in range(80)) for _ in range(30)]
    words = texts[7].split()[20:60]
    quote = " ".join(["altered", words[1], "changed", *words[3:]])
    spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, quote), (2, "two words")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = QUERIES["v10_attribution"](spark, str(tmp_path)).collect()
    assert [(x.quote_id, x.rank, x.key) for x in out] == [(1, 1, 7)] and out[0].verdict in ("close", "distorted")
