import hashlib
import random

from plumbline.llm import fingerprint as fp

SCHEMA = "doc_id long, text string, part string, tail string"


def brute_gear(data, at):
    return sum(int(fp.GEAR[data[at - j]]) << j for j in range(min(32, at + 1))) % 2**32


def text_of(r, n):
    return " ".join("".join(r.choices("abcdefgéß", k=r.randint(1, 9))) for _ in range(n))


def test_gear_hashes_and_chunks():
    r = random.Random(1)
    for n in (0, 1, 2, 31, 32, 33, 700):
        data = r.randbytes(n)
        assert fp.gear_hashes(data).tolist() == [brute_gear(data, i) for i in range(n)]
        pieces = fp.chunks(data)
        assert b"".join(pieces) == data
        assert all(24 <= len(c) <= 256 for c in pieces[:-1])
        start = 0
        for c in pieces[:-1]:
            end = start + len(c)
            stops = [e for e in range(start + 24, min(start + 256, n) + 1) if brute_gear(data, e - 1) >> (25 if e < start + 64 else 27) == 0]
            assert end == min(stops[:1] + [start + 256])
            start = end


def test_insertions_leave_far_chunks_alone():
    text = text_of(random.Random(2), 2000)
    a, b = fp.fingerprint(text), fp.fingerprint("new start " + text[:5000] + "x" + text[5000:])
    assert 0.9 < fp.likeness(a, b) < 1
    assert fp.likeness(a, a) == 1 and fp.likeness(a, fp.fingerprint(text_of(random.Random(3), 2000))) < 0.05
    assert fp.likeness(a, fp.fingerprint(text[: len(text) // 4])) > 0.95  # containment


def brute(documents):
    documents = sorted(((d, t or "") for d, t in documents), key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5(x[1].encode()).hexdigest()))
    out = []
    for i, (doc, text) in enumerate(documents):
        after = documents[(i + 1) % len(documents)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        a, b, c = map(fp.fingerprint, (text, changed, after))
        out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), fp.to_string(a), fp.to_string(b), fp.likeness(a, b), fp.likeness(a, c), len(a)))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(3)
    documents = [(i * 7 - 100, text_of(r, r.choice([0, 1, 5, 60, 300]))) for i in range(60)]
    documents += [(2**40, None), (5, "tie"), (5, "tie"), (5, "other tie"), (None, "no id"), (None, "")]
    for rows in (documents, documents[:1], [(1, None), (2, "a")]):
        df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(5)
        assert sorted((tuple(x) for x in fp.fingerprints(df).collect()), key=str) == brute(rows)
    small = fp.with_next
    monkeypatch.setattr(fp, "with_next", lambda *a: small(*a, rows_per_range=7))
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in documents], SCHEMA).repartition(5)
    assert sorted((tuple(x) for x in fp.fingerprints(df).collect()), key=str) == brute(documents)
    assert fp.fingerprints(df.limit(0)).count() == 0
