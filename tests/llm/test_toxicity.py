import random
import zlib

import numpy as np

from plumbline.llm import toxicity as tox

DOCS, LABELS = "doc_id long, text string, label string, score string", "doc_id long, toxic int"


def corpus(n=1500, seed=1):
    """Toxic is an insult with a group; either alone is not, which no additive weights can tell."""
    r, docs, labels = random.Random(seed), [], []
    for i in range(n):
        words = ["".join(r.choices("abcdefgh", k=3)) for _ in range(r.randint(5, 60))]
        insult, group = r.random() < 0.5, r.random() < 0.5
        words += [r.choice(["Zanky,", "BROLT", "vexo"])] * insult + [r.choice(["Marsians", "Lunars!"])] * group
        r.shuffle(words)
        docs.append((i, " ".join(words), "x", "y"))
        labels.append((i, int(insult and group)))
    return docs, labels


def test_pairs_are_learnt_and_held_out_rows_are_not_used(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, DOCS)
    machine = tox.fit(df, spark.createDataFrame(labels, LABELS))
    rows = {r.doc_id: r for r in tox.score(df, machine).collect()}
    truth = dict(labels)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [i for i, r in rows.items() if r.held_out]
    assert np.mean([rows[i].predicted == truth[i] for i in held]) > 0.97
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    again = tox.fit(df.repartition(3), spark.createDataFrame(flipped, LABELS))
    assert np.array_equal(again.weights, machine.weights) and np.array_equal(again.vectors, machine.vectors)


def test_gradient_is_that_of_the_loss():
    r = np.random.default_rng(0)
    w, v = r.normal(size=9), r.normal(size=(9, 3))
    x = [np.array([0, 2, 5]), np.array([], int), np.array([8])]
    z, _ = tox._forward(np.concatenate(x), np.array([3, 0, 1]), 0.3, w, v)
    pairs = v[0] @ v[2] + v[0] @ v[5] + v[2] @ v[5]
    assert np.allclose(z, [0.3 + w[[0, 2, 5]].sum() + pairs, 0.3, 0.3 + w[8]])


def test_edges(spark):
    docs = [(1, None, "", ""), (2, "", "", ""), (None, "a", "", ""), (3, "w " * 50_000, "", ""), (3, "w", "", "")]
    df = spark.createDataFrame(docs, DOCS)
    labels = [(1, None), (2, 1), (None, 1), (3, 0), (3, 0), (9, 1), (4, 7)]
    for given in (labels, []):
        machine = tox.fit(df, spark.createDataFrame(given, LABELS))
        rows = tox.score(df, machine).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
        assert next(r for r in rows if r.doc_id is None).held_out
    assert tox.score(df.limit(0), machine).count() == 0
