import hashlib
import math
import random
import re
from collections import defaultdict

from plumbline.llm import secrets as sec

SCHEMA = "doc_id long, text string, base string, runs string"


def brute_base(text):
    text = text or ""
    keyword = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    assign = re.compile(r"""(%s|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""" % keyword)
    out = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def brute_battery(token):
    name, alphabet = next((n, a) for n, (p, a) in sec.ALPHABETS.items() if re.search(p, token))
    v = [alphabet.index(c) for c in token.rstrip("=")]
    n, k = len(v), len(alphabet)
    tail = lambda z: math.erfc(z / 2**0.5) / 2
    chi = k / n * sum(v.count(c) ** 2 for c in set(v)) - n
    p1 = tail(((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / (2 / (9 * (k - 1))) ** 0.5)
    turns = sum((a >= k / 2) != (b >= k / 2) for a, b in zip(v, v[1:]))
    p2 = 2 * tail(abs(turns - (n - 1) / 2) / ((n - 1) / 4) ** 0.5)
    r = sum((a - (k - 1) / 2) * (b - (k - 1) / 2) for a, b in zip(v, v[1:])) / ((n - 1) * (k * k - 1) / 12) * (n - 1) ** 0.5
    p3 = 2 * tail(abs(r))
    x = -sum(math.log(min(1, max(p, 1e-30))) for p in (p1, p2, p3))
    return f"{name}:{int(math.log2(n))}", n, math.exp(-x) * (1 + x + x * x / 2)


def brute(documents, alpha=0.05):
    rows, steps = [], defaultdict(list)
    for doc, text in documents:
        base = brute_base(text)
        runs = []
        for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}", text or ""):
            if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not any(b[0] < m.end() and m.start() < b[2] for b in base):
                stratum, _, p = brute_battery(m[0])
                step = max(0, min(int(-math.log10(p) * sec.STEPS) if p else sec.LAST, sec.LAST))
                runs.append((m.start(), m.end(), stratum, step))
                steps[stratum].append(step)
        rows.append((doc, base, runs))
    cuts = {}
    for stratum, found in steps.items():
        cuts[stratum] = min((s for s in found if 10 ** (-s / sec.STEPS) * len(found) <= alpha * sum(t >= s for t in found)), default=sec.LAST + 1)
    return [(doc, base, [(s, 3, e, "random") for s, e, stratum, step in runs if step < cuts[stratum]]) for doc, base, runs in rows]


def digested(doc, base, extra):
    said = lambda x: ",".join(f"{k}:{s}:{e}" for s, _, e, k in x)
    counts = [sum(b[3] == k for b in base) for k in ("assign", "access", "hex")]
    return (doc, *counts, hashlib.sha256(said(base).encode()).hexdigest(), said(sorted(base + extra)), len(extra))


def corpus(seed=1):
    r = random.Random(seed)
    pick = lambda a, n: "".join(r.choices(a, k=n))
    url, b64, hexa = sec.ALPHABETS["base64url"][1], sec.ALPHABETS["base64"][1], "0123456789abcdef"
    out = []
    for _ in range(150):
        words = [pick("abcdefghilmnorstué🙂", r.randint(1, 9)) for _ in range(r.randint(1, 25))]
        words += r.choice([[], [pick(b64, r.choice([20, 33, 64])) + "=="], [pick(url, 40)], ["AKIA" + pick("ABCDEFG0123", 16)], [pick(hexa, r.choice([23, 24, 40]))], ["path/to/some/longer/file-name-1/index"], ["aaaaaaaaaaaaaaaaaaaa1111111"], ["abcdefghijklmnopqrstuvwxyz012345"], [pick("0123456789", 30)]])
        r.shuffle(words)
        out.append(" ".join(words))
    out += ["passwd=token:abcdefghi", "Secret = 'tok=en.1234'", "API_KEY:\"abcde\"", "api key=abcdefgh", "pAssWord==abcdef", "toKen=abcdefgh ſecret=abcdefgh", "AKIAAKIA" + "A" * 11 + " AKIA" + "0" * 16, "token=" + "f0" * 20, "", None, "é🙂 token=abcdef", "x" * 50_000 + " token=abcdef1", "token=abcdef\n" * 300, pick(url, 5000)]
    return list(enumerate(out))


def test_against_brute_force(spark):
    documents = corpus() + [(3, "token=abcdef"), (3, "token=abcdef"), (None, "AKIA" + "B" * 16)]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in documents], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in sec.digest(sec.scan(df)).collect()), key=str)
    want = sorted((digested(*x) for x in brute(documents)), key=str)
    assert got == want
    assert sum(x[-1] for x in want) > 20  # random strings are found ...
    spans = {x[0]: x for x in want if x[0] is not None and x[0] < 150}
    made_up = [i for i, t in documents[:150] if re.search("path/to|aaaa|abcdefghijkl", t)]
    assert made_up and all(spans[i][-1] == 0 for i in made_up)  # ... and ordered ones are not


def test_p_values(spark):
    r = random.Random(9)
    tokens = [(t,) for _, t in zip(range(40), iter(lambda: "".join(r.choices(sec.ALPHABETS["base62"][1], k=r.randint(20, 90))), None))]
    tokens += [("ab12" * 12,), ("0123456789abcdef" * 4,), ("A" * 30 + "7",)]
    rows = spark.createDataFrame(tokens, "t string").select("t", sec.battery(sec.F.col("t")).alias("b")).collect()
    for row in rows:
        p = brute_battery(row.t)[2]
        assert abs(row.b.p - p) <= 1e-5 * p + 1e-12


def test_empty_table(spark):
    assert sec.digest(sec.scan(spark.createDataFrame([], SCHEMA))).count() == 0
