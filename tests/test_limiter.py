"""The streaming limiter over micro-batches with restarts equals the batch form, and its state ends."""

import random

from ledgerlark.streaming import limiter as L


def test_stream_with_restarts_equals_batch_and_state_ends(spark, tmp_path):
    rng = random.Random(3)
    rows, at = [], 1_000_000.0
    for i in range(400):
        at += rng.choice((0.0, 0.5, 3.0, 20.0))
        rows.append((i, f"k{rng.randrange(4)}", at))
    rows.append((1_000, "last", at + 10_000))
    rows.append((1_001, "last", at + 20_000))
    kind = "event_id long, key string, at double"
    spark.conf.set(*L.STATE_STORE)
    try:
        state = []
        for lo in (*range(0, 400, 80), 400, 401):
            hi = lo + 80 if lo < 400 else lo + 1
            spark.createDataFrame(rows[lo:hi], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            asked = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
            q = L.rate_limit_stream(asked, 3, 60.0).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
            q.awaitTermination()
            state.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    finally:
        spark.conf.unset(L.STATE_STORE[0])
    got = {r["event_id"]: r["accepted"] for r in spark.read.schema("event_id long, accepted boolean").parquet(f"{tmp_path}/out").collect()}
    want = {r["event_id"]: r["accepted"] for r in L.rate_limit(spark.createDataFrame(rows, kind), 3, 60.0).collect()}
    assert got == want and not all(want.values())
    # keys with state: only the last one's is left once the watermark has passed all others
    assert max(state) == 4 and state[-1] == 1
