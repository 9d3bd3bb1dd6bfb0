"""Quality rules by repetition coverage.

For every whole text, rolling hashes of several n-gram lengths (numpy prefix sums, no Python loop over words)
find the words that lie in n-grams occurring twice or more, and the lines equal to an earlier line; the share
of the text's word characters that they cover decides.  One pass over the rows, no shuffle.

Defined results: a null or blank text has no words (all counts 0) and fails the base rule; null ids, repeated
rows and ties are judged row by row; an empty table gives no rows; columns other than id and text are ignored
by ``measure`` and kept by ``keep``, whose helper columns never clash with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ledgerloom.llm import words as W
from ledgerloom.llm.store import map_batches

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Rules:
    """Largest shares of word characters inside duplicated n-grams (by n) and inside later copies of lines."""

    min_words: int = 50
    max_repeat_percent: int = 50
    ngram_share: tuple[tuple[int, float], ...] = ((4, 0.40), (6, 0.30), (10, 0.25))
    line_share: float = 0.30
    symbol_share: float = 0.10


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")


def _lines(v: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word that equal an earlier line of it, and the word characters in them."""
    n = len(v.data)
    cut = v.data == 0x0A
    begin = np.zeros(n + 1, bool)
    begin[1:][cut] = True
    begin[v.offs] = True
    start = np.flatnonzero(begin[:n])
    end = np.append(start[1:], n)
    size = end - start - (cut[np.maximum(end - 1, 0)] & (end > start))  # without the line end
    lead = np.zeros(n + 1, np.int64)
    np.cumsum((v.data & 0xC0) != 0x80, out=lead[1:])
    inside = np.zeros(n + 1, np.int64)
    np.cumsum(v.inside & ((v.data & 0xC0) != 0x80), out=inside[1:])
    chars = inside[end] - inside[start]
    doc = np.searchsorted(v.offs, start, "right") - 1
    real = chars > 0
    start, size, doc, chars = start[real], size[real], doc[real], chars[real]
    raw, digest = v.data.tobytes(), xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(raw[a : a + m]) for a, m in zip(start.tolist(), size.tolist(), strict=True)), W.U, len(start))
    again = W.later(W.in_doc(h, doc))
    k = len(v.count)
    return np.bincount(doc[again], minlength=k), np.bincount(doc[again], chars[again], minlength=k).astype(np.int64)


def measure_column(column: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    """The counts of each text of an Arrow column, and ``base_failed`` and ``kept``."""
    parts: list[dict[str, np.ndarray]] = []
    for _, _, data, offs in W.slices(column):
        v = W.Words(data, offs)
        lead = (data & 0xC0) != 0x80
        width = np.zeros(len(data) + 1, np.int64)
        np.cumsum(lead, out=width[1:])
        chars = width[v.end] - width[v.start]  # of each word
        symbols = np.zeros(len(data) + 1, np.int64)
        np.cumsum(SYMBOL[data], out=symbols[1:])
        h, doc = v.hashes(), v.doc()

        def inside(n: int, h=h, doc=doc, v=v) -> np.ndarray:
            at, g = W.windows(h, v.first, n)
            return W.covered(at[W.repeated(W.in_doc(g, doc[at]))], n, len(h))

        part = {"n_words": v.count, "word_chars": W.per_doc(chars, v.first), "n_symbols": symbols[offs[1:]] - symbols[offs[:-1]], "n_repeat_words": W.per_doc(inside(3), v.first)}
        part["n_dup_lines"], part["dup_line_chars"] = _lines(v)
        for n, _ in rules.ngram_share:
            part[f"chars_{n}"] = W.per_doc(np.where(inside(n), chars, 0), v.first)
        parts.append(part)
    names = [*COUNTS, *(f"chars_{n}" for n, _ in rules.ngram_share)]
    out = {k: np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in names}
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * out["n_words"])
    bad = (out["dup_line_chars"] > rules.line_share * out["word_chars"]) | (out["n_symbols"] > rules.symbol_share * out["word_chars"])
    for n, share in rules.ngram_share:
        bad |= out[f"chars_{n}"] > share * out["word_chars"]
    out["kept"] = ~out["base_failed"] & ~bad
    return out


def measure(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, the counts, ``base_failed`` and ``kept``."""
    names = [*COUNTS, *(f"chars_{n}" for n, _ in rules.ngram_share)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = measure_column(b.column(1), rules)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[k]) for k in names), pa.array(got["base_failed"]), pa.array(got["kept"])], [id_col, *names, "base_failed", "kept"])

    picked = docs.select(id_col, text_col)
    schema = f"`{id_col}` {picked.schema[0].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean"
    return map_batches(picked, run, schema)


def keep(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(measure_column(b.column(at), rules)["kept"]))

    return map_batches(docs, run, docs.schema)
