"""Learned partitions with many parts, on queries that are not in the fitting sample."""

import numpy as np
from pyspark.sql import functions as F

from tidecast.llm import ann

from llm_fixtures import _shipped  # noqa: F401


def test_recall_with_many_parts_outside_the_sample(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = ann.usable(df)
    sample = 1000
    router, probes = ann.fit(vectors, sample_size=sample, part_rows=125)
    parts = router.b2.shape[0]
    assert parts == 16 and 1 <= probes <= parts
    inside = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("id")
    queries = vectors.join(inside, "id", "left_anti").orderBy("id").limit(200)
    got = ann.nearest(vectors, queries, (router, probes)).toPandas()
    p = vectors.toPandas()
    points, ids = np.stack(p.v), p.id.to_numpy()
    asked = [r.id for r in queries.select("id").collect()]
    assert len(asked) == 200
    hit = 0
    for q in asked:
        score = points @ points[np.flatnonzero(ids == q)[0]]
        score[ids == q] = -np.inf
        mine = got[got.query_id == q]
        assert sorted(mine["rank"]) == list(range(1, 21))
        hit += len(set(ids[np.lexsort((ids, -score))[:20]]) & set(mine.vec_id))
    recall = hit / (20 * len(asked))
    print(f"parts {parts}, probed {probes}, recall {recall:.3f}")
    assert recall >= 0.9
