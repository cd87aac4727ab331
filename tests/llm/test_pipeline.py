import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_neardup import brute as brute_near

pipeline = pytest.importorskip("corpus_pipeline")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 6)))
    docs, labels, common = [], [], "one line that stands in very many documents"
    bases = [[word() for _ in range(40)] for _ in range(12)]
    for i in range(700):
        toxic = r.random() < 0.2
        lines = [" ".join(word() for _ in range(r.randint(3, 30))) for _ in range(r.randint(1, 5))]
        if i % 10 == 0:
            text = r.choice(bases)[:]
            text[r.randrange(40)] = word()
            lines = [" ".join(text)]
        if toxic:
            lines[0] += " ZORKY blastard"
        if r.random() < 0.3:
            lines.append(common)
        docs.append((i, "\n".join(lines), "en", r.choice(["a", "a", "a", "b", "c", None]), 0))
        labels.append((i, int(toxic), 1))
    docs += [(1000, None, "en", "a", 0), (1001, "", None, "b", 0)]
    path = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def test_each_stage_does_its_work_on_what_the_one_before_kept(spark, folder, tmp_path):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{len(out)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(out)}")
        out[len(out)] = docs.collect()
        assert name == pipeline.STAGES[-1][0] or docs.columns == columns
    raw = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    # toxic documents go, clean ones stay as they were
    assert {r.doc_id for r in out[0]} == {i for i, r in raw.items() if "ZORKY" not in (r.text or "")}
    assert all(r == raw[r.doc_id] for r in out[0])
    # lines
    want = {(d, t) for d, *_, t in brute_lines([(r.doc_id, r.text) for r in out[0]], 1, 20)}
    assert {(r.doc_id, r.text) for r in out[1]} == want and len(out[1]) == len(out[0])
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out[1])
    # one of each group
    kept = {d for d, _, _, k in brute_near([(r.doc_id, r.text) for r in out[1]], 5) if k}
    assert {r.doc_id for r in out[2]} == kept and len(kept) < len(out[1]) and set(out[2]) <= set(out[1])
    # the mix
    texts, sizes, taken = {}, defaultdict(int), defaultdict(int)
    for r in out[2]:
        texts[r.doc_id] = r.text or ""
        sizes[r.source] += len(WORD.findall(r.text or ""))
    for r in out[3]:
        assert texts[r.doc_id].lstrip(" \t\n").startswith(r.text.lstrip(" \t\n")) and r.n_chars == len(r.text)
        taken[r.source] += len(WORD.findall(r.text))
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < 200
    assert all(taken[s] <= 2 * sizes[s] for s in sizes)
    # the ids of all copies, packed
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = Counter(i for r in out[3] for i in tokenizer.encode(r.text, add_special_tokens=False).ids + [1])
    assert ids == Counter(int(i) for p in out[4] for i in np.frombuffer(p.ids, "<u4"))
    fill = Counter()
    for p in out[4]:
        fill[p.sequence_id] += p.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in fill.values())


def test_run(spark, folder):
    rows = pipeline.run(spark, folder)
    assert rows.count() > 0 and "sequence_id" in rows.columns
    fill = Counter()
    for p in rows.collect():
        fill[p.sequence_id] += p.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in fill.values())


def test_stages_on_an_empty_table(spark, folder):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, empty, folder)
        assert out.count() == 0 and (name == pipeline.STAGES[-1][0] or out.columns == empty.columns), name
