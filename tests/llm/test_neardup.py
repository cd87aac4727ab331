import random
import re

import numpy as np

from plumbline.llm import neardup
from plumbline.llm.neardup import Shingler, components, near_duplicates, odd_sketch_limit, odd_sketch_similarity

SCHEMA = "doc_id long, text string, set_id string, band string"


def brute_sets(documents, words):
    out = []
    for doc_id, text in documents:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        out.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return out


def brute(documents, words=4, percent=80):
    sets = brute_sets(documents, words)
    ids = [d for d, _ in documents]
    label = list(range(len(ids)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, d in enumerate(ids))


def corpus(seed=1, groups=12, copies=25, length=60):
    r, out = random.Random(seed), []
    word = lambda: "".join(r.choices("abcdefgéß", k=r.randint(2, 6)))
    for _ in range(groups):
        base = [word() for _ in range(r.randint(5, length))]
        for _ in range(r.randint(1, copies)):
            text = base[:]
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                text[r.randrange(len(text))] = word()
            out.append(r.choice([" ", "  ", "\n"]).join(text))
    out += ["", None, " \t\n", "a", "A", "a b", "a b", "a b c d", "A B\x0bC\x0cD", "İ x y z", "i̇ x y z"]
    r.shuffle(out)
    return list(enumerate(out, 100))


def rows_of(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_against_brute_force(spark):
    documents = corpus()
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in documents], SCHEMA)
    assert rows_of(near_duplicates(df, words=4)) == brute(documents)


def test_one_big_group_is_whole(spark, monkeypatch):
    r = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    documents = []
    for i in range(250):
        text = base[:]
        for _ in range(r.randint(0, 4)):
            text[r.randrange(80)] = f"x{r.random()}"
        documents.append((i, " ".join(text)))
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in documents], SCHEMA)
    for waves in (1, 2):
        monkeypatch.setattr(neardup, "WAVES", waves)
        assert rows_of(near_duplicates(df, words=4)) == brute(documents)


def test_ids_that_are_null_or_repeat_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e", "", ""), (3, "a b c d e", "", ""), (3, "a b c d e", "", ""), (4, "A b c d e", "", ""), (3, "other words are in here", "", "")], SCHEMA)
    got = sorted(map(str, (tuple(r) for r in near_duplicates(df).collect())))
    assert got == sorted(map(str, [(None, 1, None, False), (3, 1, 3, True), (3, 1, 3, True), (4, 1, 3, False), (3, 1, 3, True)]))
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(61), 100, 101, 200]], "node long")
    assert {r.node: r.component for r in components(nodes, links).collect()} == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 200: 200}


def test_odd_sketches_estimate_high_similarities():
    s, r = Shingler(4, 28, 5, 512), np.random.default_rng(0)
    limit = odd_sketch_limit(140, 512, 0.8)
    wrong, passed = [], 0
    for _ in range(200):
        a = r.integers(0, 2**63, 900, np.uint64)
        b = np.concatenate([a[:800], r.integers(0, 2**63, 100, np.uint64)])  # 800 of 1000
        _, sketch = s.signatures([np.unique(a), np.unique(b)])
        apart = int(np.unpackbits((sketch[0, :8] ^ sketch[1, :8]).view(np.uint8)).sum())
        wrong.append(odd_sketch_similarity(apart, 140, 512) - 0.8)
        passed += apart <= limit
    assert passed == 200 and abs(np.mean(wrong)) < 0.01 and np.std(wrong) < 0.06


def test_a_link_beside_a_pivot_that_is_alike_to_none(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefgh", k=8))
    shingler = Shingler(1, 1, 5, 512)
    for _ in range(5_000):
        base = [word() for _ in range(100)]
        texts = [" ".join(base[:80] + [word() for _ in range(20)]), " ".join(base), " ".join(base[:97] + [word() for _ in range(3)])]
        bands, _ = shingler.signatures([shingler.shingles(t) for t in texts])
        sets = [neardup.set_id(shingler.shingles(t)) for t in texts]
        if len(set(bands[:, 0])) == 1 and sets[0] == min(sets):
            break
    df = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts, 1)], SCHEMA)
    got = rows_of(near_duplicates(df, words=1, bands=1, rows=5))
    assert [(d, c) for d, _, c, _ in got] == [(1, 1), (2, 2), (3, 2)]


def test_different_texts_of_one_id_have_each_their_links(spark):
    a, b = [" ".join(f"{c}{i}" for i in range(80)) for c in "ab"]
    documents = [(3, a), (7, a + " x"), (3, b), (1, b + " x"), (9, "y " + b), (8, "y " + a)]
    got = rows_of(near_duplicates(spark.createDataFrame([(d, t, "", "") for d, t in documents], SCHEMA), words=4))
    assert got == brute(documents) and [(d, c) for d, _, c, _ in got] == [(1, 1), (3, 1), (3, 3), (7, 3), (8, 3), (9, 1)]


def test_links_of_several_waves_come_together(spark, monkeypatch):
    """One band of one sample: buckets of many unlike classes, whose links are found wave by wave."""
    r, documents = random.Random(11), []
    common = [f"c{i}" for i in range(40)]
    for group in range(12):
        base = common + [f"g{group}x{i}" for i in range(r.randint(5, 40))]
        for _ in range(r.randint(1, 9)):
            text = base[:]
            for _ in range(r.randint(0, 5)):
                text[r.randrange(40, len(text))] = f"y{r.random()}"
            documents.append((len(documents) + 1, " ".join(text)))
    met, joined = [], neardup._joined
    monkeypatch.setattr(neardup, "_joined", lambda labels, *rest: met.append(labels is not None) or joined(labels, *rest))
    df = spark.createDataFrame([(d, t, "", "") for d, t in documents], SCHEMA)
    shingler = Shingler(1, 1, 1, 512)
    bucket = {d: shingler.signatures([shingler.shingles(t)])[0][0, 0] for d, t in documents}
    got = rows_of(near_duplicates(df, words=1, bands=1, rows=1))
    # links that share the band, by brute force
    sets, label = brute_sets(documents, 1), {d: d for d, _ in documents}
    for _ in documents:
        for i, (a, _) in enumerate(documents):
            for j, (b, _) in enumerate(documents[:i]):
                both = len(sets[i] & sets[j])
                if bucket[a] == bucket[b] and 100 * both >= 80 * len(sets[i] | sets[j]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {d: c for d, _, c, _ in got} == label and any(met) and len(set(label.values())) < len(documents) - 10


def test_many_near_copies_and_a_text_of_a_megabyte(spark):
    r, base = random.Random(2), [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[:i], f"x{r.random()}", *base[i + 1 :]]) for i in (r.randrange(60) for _ in range(5_000))]
    long = " ".join(f"v{r.random()}" for _ in range(60_000))
    documents = [*enumerate(texts), (6_000, long), (6_001, long + " end"), (6_002, "other words of a clean text")]
    got = rows_of(near_duplicates(spark.createDataFrame([(d, t, "", "") for d, t in documents], SCHEMA).repartition(8), words=4))
    assert len(long) > 1_000_000
    assert [(d, c) for d, _, c, _ in got] == [(i, 0) for i in range(5_000)] + [(6_000, 6_000), (6_001, 6_000), (6_002, 6_002)]


def test_pairs_go_to_the_sets_unless_they_are_too_many(spark, monkeypatch):
    """Confirming shuffles the sets that pairs need by their pivots alone; it shuffled all sets by node, too."""
    sets = spark.createDataFrame([(i, [*range(i % 7, 40 + i % 7)]) for i in range(60)], "id long, shingles array<long>")
    found = [(p, n) for p in range(0, 60, 20) for n in range(60) if n != p]
    shared = lambda p, n: 40 - abs(p % 7 - n % 7)
    want = sorted((p, n) for p, n in found if 100 * shared(p, n) >= 90 * (80 - shared(p, n)))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for most in (neardup.BROADCAST_ROWS, 0):
            monkeypatch.setattr(neardup, "BROADCAST_ROWS", most)
            out = neardup._confirmed(spark.createDataFrame(found, "pivot long, node long"), sets, 90, neardup.Tables(spark))
            assert sorted(map(tuple, out.collect())) == want and 20 < len(want) < len(found)
            assert ("hashpartitioning(node" in out._jdf.queryExecution().executedPlan().toString()) == (not most)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_rows_equal_in_id_and_text_give_one_set(spark):
    a = " ".join(f"a{i}" for i in range(80))
    documents = [(1, a), (1, a), (2, a + " x"), (2, a + " x"), (3, a + " y")]
    got = rows_of(near_duplicates(spark.createDataFrame([(d, t, "", "") for d, t in documents], SCHEMA), words=4))
    assert got == [(1, 77, 1, True)] * 2 + [(2, 78, 1, False)] * 2 + [(3, 78, 1, False)]
