"""Operator 6: packing token sequences by the online sum-of-squares rule.

A document's ids (those of its text, then one end id) are cut into whole windows and a
tail. Tails are placed one after the other: a tail may open a window or go into any
partially filled one that has room, and the rule picks the fill level for which the sum of
the squared numbers of partially filled windows grows least; ties take the fullest level.
The numbers are kept in an array by level, so a placement is one vectorised look at that
array. Documents are dealt to shards by a hash of their id, each shard of about
``shard_chars`` characters, so no source or id gathers in one task, and a shard is packed
as a stream in the order of doc_id. When a shard ends, the few windows still open are
closed: their pieces are cut again into full windows, and what is left over into sequences
whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WordCache, forget, remembered

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


#: Letters beyond Latin, and one whose lower case is two characters: texts with those are left to the tokenizer.
OTHER = re.compile("[\u0130\u0250-\U0010ffff]")
#: Marks that end a word and make a part of their own; an apostrophe would not.
ENDS = ".,!?;:#*%$&"
#: A full stop or comma alone after a letter or digit is a part of its own, whatever stands before it. Beyond Latin only
#: after ASCII ones, as the tokenizer's normaliser makes a letter and a mark of some letters, and the mark takes the stop.
#: What stands before is looked at last, as a search for two marks is quicker than one for a place.
STOP = re.compile(r"[.,](?<=[^\W_][.,])(?=[ \n]|$)")
ASCII_STOP = re.compile(r"[.,](?<=[A-Za-z0-9][.,])(?=[ \n]|$)")


def _is_latin(text: str) -> bool:
    """Whether no letter beyond Latin is there; most texts are of the 256 first code points, which is seen sooner."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not OTHER.search(text)
    return True


class ChunkEncoder:
    """Ids of whole texts by a lower-casing byte-pair ``tokenizers`` file whose words never span white space.

    A text is cut at spaces, tabs and line ends, which such a tokenizer always splits at
    and drops, so the ids of the parts in turn are the ids of the text; parts repeat, and
    their ids are remembered as little-endian unsigned 32-bit integers. A part of Latin
    letters goes straight to the tokenizer's model, in the letters that stand for its bytes.
    """

    def __init__(self, path: str, words: int = 200_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.latin = {i: level.pre_tokenize_str(chr(i))[0][0][-1] for i in range(0x80)}
        for i in range(0x80, 0x250):
            shown = level.pre_tokenize_str(chr(i))[0][0]
            for byte, letter in zip(chr(i).encode(), shown, strict=True):
                self.latin[byte] = letter
        self.cache = WordCache(self._encode, limit=words)

    def _encode(self, part: str) -> bytes:
        core = part.rstrip(ENDS)
        if core != part and core.isalpha() and not OTHER.search(core):
            return self.cache[core] + self.cache[part[len(core) :]]
        if part.isalpha() and part == part.lower() and not OTHER.search(part):
            shown = part.encode().decode("latin-1").translate(self.latin)
            ids = [t.id for t in self.model.tokenize(shown)]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """The ids, four bytes each."""
        cache, text = self.cache, text or ""
        # Special tokens are matched on the raw text, so what may be one keeps its case.
        latin = _is_latin(text)
        if latin and "<|" not in text:
            text = text.lower()
        parts = (STOP if latin else ASCII_STOP).sub(r" \g<0>", text).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join([cache[p] for p in parts if p])

    def __call__(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode(text), "<u4")


@remembered
def encoder_of(path: str, words: int) -> ChunkEncoder:
    """One encoder for each worker process, which keeps what it has learnt from task to task."""
    return ChunkEncoder(path, words)


class SumOfSquares:
    """Windows of ``size`` filled online; :meth:`place` yields finished pieces, :meth:`close` the rest.

    A piece is ``(doc_id, start, ids, doc_tokens, sequence, offset)``. ``counts[h]`` is the
    number of windows filled to ``h``, ``open[h]`` holds those windows, each a list of items.
    """

    def __init__(self, size: int):
        self.size, self.counts, self.open, self.sequences = size, np.zeros(size + 1, np.int64), {}, 0

    def level(self, n: int) -> int:
        """The fill level that takes ``n`` more ids at the least growth of the sum of squares."""
        before, after = self.counts[: self.size - n + 1], self.counts[n:]
        growth = 2 * (after - before) + 2
        growth[before == 0] = np.iinfo(np.int64).max
        growth[0] = 2 * after[0] + 1
        growth[-1] = 1 - 2 * before[-1] if before[-1] and len(before) > 1 else growth[-1]
        if len(growth) == 1:
            growth[0] = 0
        return len(growth) - 1 - int(np.argmin(growth[::-1]))

    def place(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) - len(ids) % self.size
        for start in range(0, whole, self.size):
            yield from self._seal([(doc_id, start, ids[start : start + self.size], len(ids))])
        tail = (doc_id, whole, ids[whole:], len(ids))
        n = len(tail[2])
        if not n:
            return
        at = self.level(n)
        window = self.open[at].pop() if at else []
        if at:
            self.counts[at] -= 1
        window.append(tail)
        if at + n == self.size:
            yield from self._seal(window)
        else:
            self.counts[at + n] += 1
            self.open.setdefault(at + n, []).append(window)

    def _seal(self, items: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in items:
            yield doc_id, start, ids, total, self.sequences, offset
            offset += len(ids)
        self.sequences += 1

    def close(self) -> Iterator[tuple]:
        left = [w for level in sorted(self.open, reverse=True) for w in self.open[level]]
        items = [item for window in left for item in window]
        total = sum(len(item[2]) for item in items)
        rest = total % self.size
        lengths = [self.size] * (total // self.size) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        items.reverse()
        for length in lengths:
            window, room = [], length
            while room:
                doc_id, start, ids, n = items.pop()
                if len(ids) > room:
                    items.append((doc_id, start + room, ids[room:], n))
                    ids = ids[:room]
                window.append((doc_id, start, ids, n))
                room -= len(ids)
            yield from self._seal(window)
        self.counts[:] = 0
        self.open.clear()


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    size: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_chars: int = 16_000_000,
    with_ids: bool = True,
    cache_words: int = 200_000,
) -> DataFrame:
    """All documents as pieces of sequences of at most ``size`` ids.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if
    ``with_ids``, ids (little-endian unsigned 32-bit). A sequence's pieces are gapless from
    offset 0; ``sequence_id`` is shard * 2**32 + a number in the shard. A null or empty text
    is the end id alone; a null doc_id is packed as such; repeated rows are packed each for
    itself; an empty table gives no rows; other columns of ``docs`` are not read. A worker keeps
    the ids of at most twice ``cache_words`` words.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chars = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    shards = max(1, -(-chars // shard_chars))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget(encoder_of)
        encoder, end = encoder_of(tokenizer_path, cache_words), np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for at in range(0, len(whole), 512):
                pdf = whole.iloc[at : at + 512]
                yield pd.DataFrame({"shard": pdf["shard"], "doc_id": pdf["doc_id"], "ids": [encoder.encode(t) + end for t in pdf["text"]]})

    def frame(shard: int, pieces: list[tuple]) -> pd.DataFrame:
        doc, start, ids, total, sequence, offset = zip(*pieces, strict=True)
        return pd.DataFrame(
            {
                "doc_id": pd.array(doc, "Int64"),
                "start": start,
                "length": [len(x) for x in ids],
                "ids_crc32": [zlib.crc32(x) for x in ids],
                "doc_tokens": total,
                "sequence_id": [(shard << 32) + s for s in sequence],
                "offset": offset,
                "ids": [x.tobytes() for x in ids] if with_ids else None,
            }
        )

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()  # the words and the tokenizer, which are not needed beside a shard's ids
        shard, packer, done = None, None, []
        for pdf in batches:
            for now, doc_id, ids in zip(pdf["shard"], pdf["doc_id"], pdf["ids"], strict=True):
                if now != shard:
                    if packer:
                        done.extend(packer.close())
                        if done:
                            yield frame(shard, done)
                    shard, packer, done = now, SumOfSquares(size), []
                done.extend(packer.place(None if pd.isna(doc_id) else int(doc_id), np.frombuffer(ids, "<u4")))
                if len(done) >= 1024:
                    yield frame(shard, done)
                    done = []
        if packer:
            done.extend(packer.close())
            if done:
                yield frame(shard, done)

    shard = F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards)).cast("long")
    encoded = rows.withColumn("shard", shard).mapInPandas(encode, "shard long, doc_id long, ids binary")
    order = encoded.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", F.crc32("ids"))
    packed = order.mapInPandas(fill, PIECES)
    return packed if with_ids else packed.drop("ids")
