import heapq
import random

from pyspark.sql import functions as F

from plumbline.llm.mixing import apportion, capped_targets, mix

SCHEMA = "doc_id long, text string, source string, size string"


def brute_targets(sizes, weights, share, cap):
    total, capped = share * sum(sizes), set()
    while True:
        left = total - sum(cap * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        over = {i for i, w in enumerate(weights) if i not in capped and left * w / weight > cap * sizes[i]}
        if not over:
            return [cap * s if i in capped else left * weights[i] / weight for i, s in enumerate(sizes)]
        capped |= over


def test_targets(spark):
    r = random.Random(1)
    for _ in range(6):
        sizes = [r.choice([0, r.randint(1, 50), r.randint(1, 5000)]) for _ in range(7)]
        if not sum(sizes):
            continue
        weights = [(3, 1, 2)[i % 3] for i in range(7)]
        df = spark.createDataFrame([(i, s, float(w)) for i, (s, w) in enumerate(zip(sizes, weights))], "source_rank long, source_size long, weight double")
        got = [x.target for x in capped_targets(df, 1.5, 2.0).orderBy("source_rank").collect()]
        want = brute_targets(sizes, weights, 1.5, 2.0)
        assert all(abs(a - b) < 1e-6 * max(1, b) for a, b in zip(got, want))


def test_apportion_gives_the_highest_quotients(spark):
    r = random.Random(2)
    rows, want = [], {}
    for g in range(8):
        votes = [r.choice([0, 1, r.randint(1, 10), r.randint(1, 10000)]) for _ in range(r.randint(1, 9))]
        seats, heap = r.choice([0, 1, 7, 200]), []
        for i, v in enumerate(votes):
            heapq.heappush(heap, (-v, i, 1))
            want[g, i] = 0
            rows.append((g, i, v, seats))
        for _ in range(seats if sum(votes) else 0):
            _, i, k = heapq.heappop(heap)
            want[g, i] += 1
            heapq.heappush(heap, (-votes[i] / (2 * k + 1), i, k + 1))
    df = spark.createDataFrame(rows, "g long, i long, votes long, seats long")
    assert {(x.g, x.i): x.quota for x in apportion(df, "votes", "seats", ["g"], ["i"]).collect()} == want


def test_mix(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" * r.randint(1, 40)), r.choice(["a", "b", "b", "b", "B", "é", None]), "extra") for i in range(600)]
    rows += [(600, None, "a", "x"), (601, "", "b", "x"), (602, " \t ", None, "x"), (None, "one two", "b", "x"), (7, "twice", "b", "x"), (7, "twice", "b", "x"), (700, "solo word x", "new", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    for shard_rows in (100_000, 50):
        out = mix(df, block=4, shard_rows=shard_rows)
        got = out.collect()
        assert len(got) == len(rows)
        assert all(0 <= x.taken <= 2 * x.size for x in got)
        assert {x.doc_id: x.size for x in got}[700] == 2
        by = out.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.countDistinct("shard").alias("s")).collect()
        assert all(abs(x.t - x.n) <= 4 * (1 + x.s) for x in by)
        again = mix(df.repartition(7), block=4, shard_rows=shard_rows).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))
    assert mix(df.limit(0)).count() == 0
