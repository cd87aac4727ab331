import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from plumbline.llm import packing
from plumbline.llm.packing import ENDS, ChunkEncoder, SumOfSquares, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length string"
TEXTS = ["", None, "one", "it's 12 o'clock\tnow\r\n again", "É é Σ. ΟΔΟΣ ok\x1c\x0bx", "<|endoftext|> a<|startoftext|>b", "word " * 5000, "x" * 3000, "  ", "Été. DES!! wort### ÀÇÑ ß; naïve, e\u0301te x\u00b2 ǅ Ⅷ ª", "<|ENDOFTEXT|> \u0130I ſs", "e\u0301. a.b. 's 'S it'S. 12. a1."]


def brute_level(counts, size, n):
    best = None
    for h in range(size - n, -1, -1):
        if h and not counts[h]:
            continue
        after = counts.copy()
        if h:
            after[h] -= 1
        if h + n < size:
            after[h + n] += 1
        cost = sum(after**2)
        if best is None or cost < best[0]:
            best = cost, h
    return best[1]


def test_chunks_are_the_whole_texts_ids():
    encoder, plain = ChunkEncoder(PATH), Tokenizer.from_file(PATH)
    for text in TEXTS:
        assert encoder(text).tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_level_minimises_the_sum_of_squares():
    r = random.Random(5)
    packer = SumOfSquares(16)
    for _ in range(400):
        n = r.randint(1, 15)
        assert packer.level(n) == brute_level(packer.counts, 16, n)
        list(packer.place(0, np.arange(n, dtype="<u4")))


def check(rows, documents, size):
    plain = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    want = defaultdict(list)
    for doc_id, text in documents:
        want[doc_id].append(plain.encode(text or "", add_special_tokens=False).ids + [1])
    for doc_id, lists in want.items():
        if len(lists) == 1:
            pieces = sorted(by_doc[doc_id], key=lambda r: r.start)
            got = [int(i) for r in pieces for i in np.frombuffer(r.ids, "<u4")]
            assert got == lists[0]
            at = 0
            for r in pieces:
                assert (r.start, r.doc_tokens, r.length) == (at, len(got), len(r.ids) // 4)
                assert r.ids_crc32 == zlib.crc32(r.ids)
                at += r.length
        else:
            assert sum(r.length for r in by_doc[doc_id]) == sum(map(len, lists))
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    assert padding == 0


def test_pieces(spark):
    documents = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(100, "tie"), (100, "tie"), (None, "no id")]
    df = spark.createDataFrame([(i, t, "extra") for i, t in documents], SCHEMA)
    for shard_chars in (10**9, 9_000):
        rows = pack(df, PATH, size=64, shard_chars=shard_chars).collect()
        check(rows, documents, 64)
        again = pack(df.repartition(5), PATH, size=64, shard_chars=shard_chars).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again))


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_special_tokens_in_capitals_are_words():
    encoder, plain = ChunkEncoder(PATH), Tokenizer.from_file(PATH)
    for text in ("<|ENDOFTEXT|>", "A Word <|EndOfText|> and MORE <|STARTOFTEXT|>.", "Plain <|endoftext|> TEXT"):
        assert encoder(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_ids_of_every_code_point_beside_marks():
    """Each code point after and before a letter, with every mark that the encoder cuts off, in texts of their own."""
    encoder, plain = ChunkEncoder(PATH, words=1_000), Tokenizer.from_file(PATH)
    points = [c for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}{m} {chr(c)}{m} X{chr(c)}b{m}" for c in points for m in (".", "!" if c % 2 else ",")]
    texts += [f"A{chr(c)}{m}{m} {chr(c)}e{m}\n{m}{chr(c)}" for c in points[:0x3000] for m in ENDS]
    wrong = []
    for at in range(0, len(texts), 20_000):
        found = plain.encode_batch_fast(texts[at : at + 20_000], add_special_tokens=False)
        wrong += [t for t, x in zip(texts[at : at + 20_000], found, strict=True) if encoder(t).tolist() != x.ids]
    assert wrong == []


def test_a_text_of_a_megabyte(spark):
    text = "Some words of a very long text, é and क़. " * 25_000
    rows = pack(spark.createDataFrame([(1, text, ""), (2, None, "")], SCHEMA), PATH).collect()
    check(rows, [(1, text), (2, None)], 2048)


def test_a_worker_forgets_other_work():
    from plumbline.llm import common, toxicity

    words = toxicity.terms_of(64)
    assert words["word"] and toxicity.terms_of(64) is words
    encoder = packing.encoder_of(public_tokenizers.path("word_bpe_49k.json"), 10)
    common.forget(packing.encoder_of)
    assert toxicity.terms_of(64) is not words and packing.encoder_of(public_tokenizers.path("word_bpe_49k.json"), 10) is encoder
    common.forget()
    assert packing.encoder_of.cache_info().currsize == 0
