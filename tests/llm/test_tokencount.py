import random

import numpy as np
import public_tokenizers
import pytest

from plumbline.llm.tokencount import attribute, encoding, section_tokens, token_spans

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = ["", None, "one", "a\n\nb c\n", "Öl für 東京 🙂🙂 é\n\n\nx", "tab\tand  spaces \n end", "word " * 4000, "\n"]


def brute(spans, sections, rule):
    tokens, crossing = [0.0] * len(sections), [0] * len(sections)
    for s, e in spans:
        meets = [(min(e, b) - max(s, a), i) for i, (a, b) in enumerate(sections) if min(e, b) > max(s, a)]
        for n, i in meets:
            crossing[i] += n < e - s
            if rule == "share":
                tokens[i] += n / (e - s)
            elif rule == "start" and sections[i][0] <= s < sections[i][1]:
                tokens[i] += 1
        if rule == "most" and meets:
            tokens[max(meets, key=lambda m: (m[0], -m[1]))[1]] += 1
    return tokens, crossing


def test_spans_tile_the_text():
    encoder, _ = encoding(PATH, PATTERN)
    for text in TEXTS:
        text = text or ""
        spans = token_spans(text, PATH, PATTERN)
        assert len(spans) == len(encoder.encode_ordinary(text))
        covered = np.zeros(len(text), int)
        for s, e in spans:
            assert 0 <= s < e <= len(text)
            covered[s:e] += 1
        assert (covered > 0).all()
    plain = token_spans("hello brave new world", PATH, PATTERN)
    assert ["hello brave new world"[s:e] for s, e in plain] == ["hello", " brave", " new", " world"]


@pytest.mark.parametrize("rule", ["start", "most", "share"])
def test_attribution_against_brute_force(rule):
    r = random.Random(1)
    for _ in range(200):
        cuts = sorted(r.sample(range(60), r.choice([0, 2, 4, 8])))
        sections = [(cuts[i], cuts[i + 1]) for i in range(0, len(cuts), r.choice([1, 2])) if i + 1 < len(cuts)]
        ends = sorted(r.sample(range(1, 61), 15))
        spans = [(max(0, s - r.choice([0, 0, 1])) if s else 0, e) for s, e in zip([0, *ends], ends)]
        tokens, crossing = attribute(np.array(spans).reshape(-1, 2), np.array(sections, np.int64).reshape(-1, 2), rule)
        want = brute(spans, sections, rule)
        assert np.allclose(tokens, want[0]) and crossing.tolist() == want[1]


def test_lines_hold_all_tokens(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a\nb", "x"), (1, "a\nb", "x")], "doc_id long, text string, sections string")
    rows = section_tokens(df, PATH, PATTERN).collect()
    for i, text in enumerate(TEXTS):
        own = sorted((r for r in rows if r.doc_id == i and (i != 1 or r.doc_tokens != 3)), key=lambda r: r.section)
        assert "".join((text or "")[r.start : r.end] for r in own) == (text or "")
        assert sum(r.tokens for r in own) == own[0].doc_tokens and len(own) == (text or "").count("\n") + 1
    assert sum(r.doc_id is None for r in rows) == 2
    assert section_tokens(df.limit(0), PATH, PATTERN).count() == 0


def test_given_sections(spark):
    df = spark.createDataFrame([(1, "title body", [("body", 6, 99), ("title", 0, 6)]), (2, "x", []), (3, "x", None), (4, None, [("t", 0, 4)])], "doc_id long, text string, parts array<struct<name:string,start:bigint,end:bigint>>")
    rows = sorted(section_tokens(df, PATH, PATTERN, sections_col="parts", rule="share").collect(), key=lambda r: (r.doc_id, r.section))
    assert [(r.doc_id, r.name, r.start, r.end, r.tokens, r.crossing) for r in rows] == [(1, "title", 0, 6, 1.2, 1), (1, "body", 6, 10, 0.8, 1), (4, "t", 0, 0, 0.0, 0)]
    with pytest.raises(ValueError):
        section_tokens(df, PATH, PATTERN, rule="none")
