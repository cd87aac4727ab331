import random

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import quality as q

DOCS = "doc_id long, text string, source string, lang string, score string"


def corpus(n=1200, seed=1):
    r, docs, labels = random.Random(seed), [], []
    for i in range(n):
        good = r.random() < 0.8
        words = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(r.randint(8, 80))]
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)
        docs.append((i, text, r.choice(["hot", "hot", f"s{r.randint(1, 30)}", None]), r.choice(["en", "de"]), "x"))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_documents(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, DOCS)
    rows = q.score(df, q.fit(df, spark.createDataFrame(labels, "doc_id long, quality int")), F.col("source"), F.col("lang")).collect()
    truth = dict(labels)
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(docs) and np.mean([r.keep == bool(truth[r.doc_id]) for r in held]) > 0.98


def test_posteriors_against_brute_force(spark):
    docs, labels = corpus(300, 2)
    df = spark.createDataFrame(docs, DOCS)
    classifier = q.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    rows = q.score(df, classifier, F.col("source"), F.col("lang")).collect()
    e = {r.doc_id: round(r.evidence * 1e6) / 1e6 for r in rows}
    mean = sum(e.values()) / len(e)

    def strength(groups):
        n = np.array([len(g) for g, _ in groups])
        share = np.array([np.mean([e[i] for i in g]) for g, _ in groups])
        whole = np.array([w for _, w in groups])
        spread = (n * ((share - whole) ** 2 - whole * (1 - whole) / n)).sum() / n.sum()
        return min(1000, max(1, np.mean(whole * (1 - whole)) / spread - 1)) if spread > 0 else 1000

    hosts, paths = {}, {}
    for r in rows:
        hosts.setdefault(r.host, []).append(r.doc_id)
        paths.setdefault((r.host, r.path), []).append(r.doc_id)
    k_host = strength([(g, mean) for g in hosts.values()])
    k_path = strength([(g, np.clip(np.mean([e[i] for i in hosts[h]]), 1e-4, 1 - 1e-4)) for (h, _), g in paths.items()])
    for r in rows:
        host = (sum(e[i] for i in hosts[r.host]) - e[r.doc_id] + k_host * mean) / (len(hosts[r.host]) - 1 + k_host)
        path = (sum(e[i] for i in paths[r.host, r.path]) - e[r.doc_id] + k_path * host) / (len(paths[r.host, r.path]) - 1 + k_path)
        assert abs(r.host_posterior - host) < 1e-6 and abs(r.path_posterior - path) < 1e-6


def test_sparse_groups_shrink_toward_the_level_above(spark):
    docs, labels = corpus(600, 3)
    docs += [(5000 + i, "WORSE!! TEXT!! THAN!! OTHERS!! HERE!!", "bad", "en", "x") for i in range(40)] + [(9000, "plain words in a plain text here.", "bad", "fr", "x"), (9001, "plain words in a plain text here.", "lone", "fr", "x")]
    df = spark.createDataFrame(docs, DOCS)
    rows = {r.doc_id: r for r in q.score(df, q.fit(df, spark.createDataFrame(labels, "doc_id long, quality int")), F.col("source"), F.col("lang")).collect()}
    assert rows[9000].path_posterior < rows[9001].path_posterior and rows[9000].score < rows[9001].score
    assert abs(rows[9000].path_posterior - rows[9000].host_posterior) < 1e-6


def test_edges(spark):
    docs = [(1, None, None, None, ""), (2, "", "a", "en", ""), (3, " \n ", "a", "en", ""), (None, "word", "a", None, ""), (4, "w " * 50_000, "a", "en", ""), (4, "w", "a", "en", "")]
    df = spark.createDataFrame(docs, DOCS)
    classifier = q.fit(df, spark.createDataFrame([(2, 1)], "doc_id long, quality int"))
    rows = q.score(df, classifier, F.col("source"), F.col("lang")).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0 and not r.keep for r in rows if r.doc_id in (1, 2, 3))
    for empty in (df.limit(0), df.where("doc_id <= 3")):
        assert q.score(empty, classifier, F.col("source"), F.col("lang")).count() == empty.count()


def test_sites_of_addresses(spark):
    rows = ["http://WWW.a.example.com/fr/825?page=2", "https://m.b.example.net:8080/en/25#top", "http://c.org", "no address", None, "http://d.org/"]
    host, path = q.site(F.col("u"))
    got = [tuple(r) for r in spark.createDataFrame([(u,) for u in rows], "u string").select(host, path).collect()]
    assert got == [("a.example.com", "fr"), ("m.b.example.net", "en"), ("c.org", ""), (None, None), (None, None), ("d.org", "")]


def test_paths_of_hosts_have_their_own_posteriors(spark):
    """Scores by host and path of addresses: a good path of a host lifts its documents over those of a bad one."""
    r = random.Random(3)
    docs, labels = [], []
    for i in range(400):
        good = i % 2 == 0
        words = " ".join("".join(r.choices("abcdefghij", k=r.randint(3, 8))) for _ in range(40)) + "."
        docs.append((i, words if good else "!!! $$$ 1 2 3 4 $$$ " * 5, f"http://h{i % 3}.org/{'good' if good else 'bad'}/{i}"))
        labels.append((i, int(good)))
    df, lab = spark.createDataFrame(docs, "doc_id long, text string, url string"), spark.createDataFrame(labels, "doc_id long, quality int")
    out = q.score(df, q.fit(df, lab), *q.site(F.col("url"))).collect()
    mean = lambda p: sum(x.path_posterior for x in out if x.path == p) / 200
    assert {x.host for x in out} == {"h0.org", "h1.org", "h2.org"} and mean("good") > 0.8 > 0.2 > mean("bad")
