"""Tokens and normalised texts of whole Arrow batches: those of ``text``, made in a few passes over the bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.functions import text as T

#: Bytes of text that are looked at together, about.
STEP_BYTES = 4 << 20
_STEM = re.compile(T.stem_pattern())
#: Letters of ``text.TOKEN`` in UTF-8: single bytes, and which byte may follow 0xD0 and 0xD1.
_SINGLE, _AFTER_D0, _AFTER_D1 = (np.zeros(256, bool) for _ in range(3))
for _c in map(chr, range(0x500)):
    if re.fullmatch(T.TOKEN, _c):
        _b = _c.encode()
        if len(_b) == 1:
            _SINGLE[_b[0]] = True
        else:
            {0xD0: _AFTER_D0, 0xD1: _AFTER_D1}[_b[0]][_b[1]] = True
#: Fixed value: what ``(?U)\s`` of Java is.
_SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def lowered(c: Column) -> Column:
    """What ``tokens`` takes; lower case stays the JVM's, since libraries differ in it."""
    return F.lower(F.coalesce(c, F.lit("")))


def steps(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts): slices of about STEP_BYTES, one row at least."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0)), dtype=np.int64)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_BYTES, "right")))
        yield at, texts.slice(at, end - at)
        at = end


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each text begins, and the end)."""
    texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    cut = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    found = np.frombuffer(data, np.uint8)[cut[0] : cut[-1]] if data is not None else np.zeros(0, np.uint8)
    return found, cut - cut[0]


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, token) in order, as ``text.tokenize`` has them. texts: strings of ``lowered``, without nulls."""
    b, cut = _bytes(texts) if len(texts) else (np.zeros(0, np.uint8), None)
    if not len(b):
        return np.zeros(0, np.int64), pa.array([], pa.string())
    inside, lead = _SINGLE[b], np.zeros(len(b), bool)
    lead[:-1] = ((b[:-1] == 0xD0) & _AFTER_D0[b[1:]]) | ((b[:-1] == 0xD1) & _AFTER_D1[b[1:]])
    inside |= lead
    inside[1:] |= lead[:-1]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = cut[(cut > 0) & (cut < len(b))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size = last - first
    offsets = np.zeros(len(first) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    found = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(b[inside]))
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(first, cut)))
    if lead.any():
        leads = np.concatenate(([0], np.cumsum(lead)))
        cyrillic = leads[last] - leads[first]
        long = pa.array((cyrillic > 0) & (size - cyrillic >= 5))
        coded = found.filter(long).dictionary_encode()
        stems = pa.array([_STEM.sub(r"\1", t) for t in coded.dictionary.to_pylist()], pa.string())
        found = pc.replace_with_mask(found, long, stems.take(coded.indices))
    return row, found


def half_normalized(c: Column) -> Column:
    """What ``normalized`` takes: placeholders are looked for only where a text has ``ref``, in any case."""
    t = F.coalesce(c, F.lit(""))
    return F.lower(F.when(F.contains(F.lower(t), F.lit("ref")), F.regexp_replace(t, "(?U)" + T.PLACEHOLDER, " ")).otherwise(t))


def normalized(texts: pa.Array) -> pa.Array:
    """``text.normalize_evidence`` of strings of ``half_normalized``."""
    return pc.utf8_trim(pc.replace_substring_regex(texts, _SPACE, " "), " ")
