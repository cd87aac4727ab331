"""Operator 3: token counts of sections by offset-mapped attribution.

A whole document is encoded once, by a byte-level tokenizer whose tokens tile its bytes, so
token lengths summed up give each token's span, first in bytes and, by counting the bytes
that begin a character, in characters. Sections are spans of characters, and tokens are
joined to them by interval: two binary searches over the sorted spans. A token that crosses
a boundary goes where an explicit rule says:

* ``start``: the section that holds its first character;
* ``most``: the section that holds most of its characters, ties to the earlier;
* ``share``: every section it meets, in proportion to the characters there.

A token that covers only part of a character is where that character is.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("start", "most", "share")
COUNTS = "doc_id long, section int, name string, start long, end long, tokens double, crossing long, doc_tokens long"


@functools.cache
def encoding(path: str, pattern: str):
    """The tokenizer of a ranks file, and the byte length of each of its tokens; one for each worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def token_spans(text: str, path: str, pattern: str) -> np.ndarray:
    """Character spans [start, end) of the tokens of a whole text, a row each."""
    encoder, lengths = encoding(path, pattern)
    data = text.encode("utf-8", "replace")
    ends = np.cumsum(lengths[np.array(encoder.encode_ordinary(data.decode()), np.int64)]) if data else np.zeros(0, np.int64)
    # before[i]: characters that begin before byte i
    before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    first = before[np.minimum(starts + 1, len(data))] - 1
    return np.stack([first, before[ends]], axis=1)


def attribute(spans: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing) for sections that are sorted, without overlap, perhaps with gaps.

    ``tokens`` is what the rule gives each section; characters in gaps give nothing.
    ``crossing`` counts tokens that reach over one of the section's ends.
    """
    tokens, crossing = np.zeros(len(sections)), np.zeros(len(sections), np.int64)
    if not len(spans) or not len(sections):
        return tokens, crossing
    low = np.searchsorted(sections[:, 1], spans[:, 0], side="right")
    high = np.searchsorted(sections[:, 0], spans[:, 1], side="left")
    meets = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(spans)), meets)
    at = low[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(meets) - meets, meets)
    start, end = spans[owner].T
    inside = np.minimum(end, sections[at, 1]) - np.maximum(start, sections[at, 0])
    np.add.at(crossing, at, inside < end - start)
    if rule == "share":
        np.add.at(tokens, at, inside / (end - start))
    elif rule == "start":
        np.add.at(tokens, at, (sections[at, 0] <= start) & (start < sections[at, 1]))
    else:
        order = np.lexsort((at, -inside, owner))
        np.add.at(tokens, at[order[np.unique(owner[order], return_index=True)[1]]], 1)
    return tokens, crossing


def section_tokens(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "start") -> DataFrame:
    """Tokens of every section of every document, by ``rule``.

    ``sections_col`` is an array of structs (name, start, end) in code points; they must not
    overlap. Without it, a text's lines are its sections, each with its line end. Returns
    doc_id, section (from 0, by start), name, start, end, tokens, crossing, doc_tokens (of
    the whole text). Null and empty texts have one empty line and no tokens; null or no
    sections give no rows; spans are cut to the text; repeated rows are counted each; an
    empty table gives no rows; other columns are not read. Unpaired surrogates count as the
    replacement character. No shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    chosen = [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    if sections_col:
        chosen.append(F.col(sections_col).cast("array<struct<name:string,start:bigint,end:bigint>>").alias("sections"))

    def given(pdf: pd.DataFrame) -> Iterator[list[tuple]]:
        for text, found in zip(pdf["text"], pdf["sections"] if sections_col else [None] * len(pdf), strict=True):
            if sections_col:
                found = [] if found is None else found
                yield sorted((max(0, min(s["start"], len(text))), max(0, min(s["end"], len(text))), s["name"]) for s in found)
            else:
                at, out = 0, []
                while (cut := text.find("\n", at) + 1) > 0:
                    out.append((at, cut, "line"))
                    at = cut
                yield [*out, (at, len(text), "line")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                pdf, out = whole.iloc[at : at + 512], []
                for doc, text, found in zip(pdf["doc_id"], pdf["text"], given(pdf), strict=True):
                    spans = token_spans(text, path, pattern)
                    tokens, crossing = attribute(spans, np.array([f[:2] for f in found], np.int64).reshape(-1, 2), rule)
                    doc = None if pd.isna(doc) else int(doc)
                    out += [(doc, i, f[2], f[0], f[1], t, c, len(spans)) for i, (f, t, c) in enumerate(zip(found, tokens.tolist(), crossing.tolist(), strict=True))]
                frame = pd.DataFrame(out, columns=[c.split()[0] for c in COUNTS.split(", ")])
                yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    return docs.select(*chosen).mapInPandas(run, COUNTS)
