"""Flags kept as a stream's state, against the batch operators."""

import random

from pyspark.sql import functions as F

from lakeleaf.operators import feedback as FB
from lakeleaf.streaming.flags import EVENTS, follow_flags, live_flags


def test_flags_follow_additions_and_deletions(spark, tmp_path):
    rng = random.Random(7)
    kinds = ["document_canonical", "document_stale", "relationship_wrong", "relationship_add"]
    rows, live, seq = [], {}, 0
    for turn in range(3):
        batch = []
        for _ in range(60):
            seq += 1
            if live and rng.random() < 0.4:
                old = live.pop(rng.choice(sorted(live)))
                batch.append((*old[:4], seq, True))
            else:
                kind = rng.choice(kinds)
                row = (f"e{seq}", FB.KINDS[kind], f"t{rng.randrange(12)}", kind)
                live[row[0]] = (*row, seq)
                batch.append((*row, seq, rng.choice([False, None])))
        rng.shuffle(batch)  # a deletion may come before what it deletes
        rows += batch
        folder = str(tmp_path / "in")
        spark.createDataFrame([*batch, (None, "document", "t1", "document_stale", seq, False)], EVENTS).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(EVENTS).parquet(folder)
        follow_flags(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        got = live_flags(spark.read.parquet(str(tmp_path / "out")))
        log = spark.createDataFrame(list(live.values()), "id string, target_kind string, target_id string, feedback_kind string, seq long")
        for name, kind in (("canonical", "document_canonical"), ("stale", "document_stale"), ("wrong", "relationship_wrong")):
            want = {r["id"] for r in FB.targets(log, kind).collect()}
            assert {r["target_id"] for r in got.filter(F.col(name) & (F.col("target_kind") == FB.KINDS[kind])).collect()} == want, (turn, name)
    assert got.count() == len({(r[1], r[2]) for r in rows})
