"""Token counts by offset-mapped attribution (operator 5).

Each document is encoded once, whole, and every token keeps its character span
in the text.  The sections of a document (here: its lines, each with its line
break; or any list of boundaries) are intervals of the same characters, and an
interval join gives each token to a section.  A token that crosses a boundary
is allocated by the rule named in ``rule``:

* ``most``: to the section that holds most of its characters, the earlier one
  on a tie (default);
* ``first`` / ``last``: to the section of its first / last character.

So the sections' counts always sum to the document's count.  A token that is
part of a character has that character's span.

Defined cases: a null or empty text has one section of no characters and no
tokens.  Repeated rows are counted each.  Other columns are not read.  A long
text is cut only where a token ends.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_batches
from quarry.llm.packing import Encoder, tokenizer_path

LINE = r"\n"
RULES = ("most", "first", "last")


class Spans(Encoder):
    """Token spans of a text, from the byte widths of its tokens."""

    def __init__(self, path: str):
        super().__init__(path)
        self.widths = np.zeros(self.encoding.n_vocab, np.int64)
        for token in self.encoding.token_byte_values():
            self.widths[self.encoding.encode_single_token(token)] = len(token)

    def spans(self, text: str) -> np.ndarray:
        """(n, 2) first character, last character + 1 of each token."""
        ends = np.cumsum(self.widths[np.frombuffer(self.ids(text), "<u4")])
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        if not text.isascii():
            lead = (np.frombuffer(text.encode("utf-8", "replace"), np.uint8) & 0xC0) != 0x80
            char = np.cumsum(lead) - 1  # of each byte
            starts, ends = char[starts], char[ends - 1] + 1
        return np.column_stack((starts, ends))


@lru_cache(maxsize=2)
def span_encoder(path: str) -> Spans:
    return Spans(path)


def allocate(spans: np.ndarray, bounds: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens per section; section k is
    [bounds[k], bounds[k + 1])."""
    n = len(bounds) - 1
    lo = np.searchsorted(bounds, spans[:, 0], "right") - 1
    hi = np.searchsorted(bounds, np.maximum(spans[:, 1] - 1, spans[:, 0]), "right") - 1
    to = {"first": lo, "last": hi, "most": lo.copy()}[rule]
    crossing = np.flatnonzero(hi > lo)
    if rule == "most":
        for i in crossing:  # few: only tokens over a boundary
            a, b = spans[i]
            cut = np.clip(bounds[lo[i]: hi[i] + 2], a, b)
            to[i] = lo[i] + int(np.argmax(np.diff(cut)))
    return np.bincount(to, minlength=n), np.bincount(to[crossing], minlength=n)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", boundary: str = LINE,
                 rule: str = "most", tokenizer: str | None = None) -> DataFrame:
    """doc_id, section, start, end, n_tokens, n_crossing: a row per section; a
    section ends after each match of ``boundary``."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = tokenizer or tokenizer_path()

    def run(it):
        enc = span_encoder(path)
        cut = re.compile(boundary)
        for b in it:
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            ids, n = b.column(0), []
            for text in b.column(1).to_pylist():
                text = text or ""
                ends = [m.end() for m in cut.finditer(text)]
                bounds = np.unique(np.array([0, *ends, len(text)], np.int64))
                if len(bounds) == 1:
                    bounds = np.array([0, 0])
                tokens, crossing = allocate(enc.spans(text), bounds, rule) if text else (np.zeros(1, int), np.zeros(1, int))
                n.append(len(bounds) - 1)
                for c, v in zip(cols, (np.arange(n[-1]), bounds[:-1], bounds[1:], tokens, crossing)):
                    c.append(v)
            if n:
                doc = ids.take(pa.array(np.repeat(np.arange(len(n)), n)))
                out = [pa.array(np.concatenate(c).astype(np.int64)) for c in cols]
                yield pa.RecordBatch.from_arrays([doc, *out], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, section long, start long, end long, n_tokens long, n_crossing long")
