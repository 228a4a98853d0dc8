"""Columns of any name pass through the operators that keep their input's columns."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lowtide.llm import minhash_dedup, quality_classifier, quality_rules, substring_dedup

NAMES = ["_path", "_host", "_slot", "_spans", "_keep", "_rank", "_kept_digest", "_alone", "_row", "_key", "_text", "_digest", "c0", "c9", "path", "host", "n", "node", "doc", "spans"]


def _docs(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(90)) for _ in range(30)]
    texts += [texts[0], texts[1] + " and more", None, ""]
    rows = [(i, t, *[f"{n}:{i}" for n in NAMES]) for i, t in enumerate(texts)]
    rows.append((None, texts[2] + " without an id", *[f"{n}:none" for n in NAMES]))
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))


def test_columns_stay_as_they_were(spark):
    docs = _docs(spark)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 11 == 0)) for i in range(30)], "doc_id long, quality int, toxic int")
    before = {r["c9"]: r for r in docs.collect()}
    kept = [
        quality_classifier.keep_good(docs, labels, F.col("_host"), F.concat_ws("/", "_host", "_path")),
        quality_rules.keep_good(docs),
        minhash_dedup.keep_first(docs, pct=80),
        substring_dedup.without_repeats(docs),
    ]
    for found in kept:
        assert found.schema.names == docs.schema.names
        rows = found.collect()
        assert rows
        for r in rows:
            same = ["doc_id", *NAMES] + (["text"] if found is not kept[-1] else [])
            assert [r[c] for c in same] == [before[r["c9"]][c] for c in same]
