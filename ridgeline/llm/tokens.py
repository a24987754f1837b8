"""Exact token ids of whole texts by the tokenizers library, with each distinct word encoded once.

Both vocabularies split text at white space, and between a letter and a stop or comma, before they merge anything, so a
word and the stops behind it always get the same ids. A bounded cache keeps where the ids of the pieces between spaces are in one
array. The words of pieces not in it (in lower case, where the vocabulary has only that) reach the library many at a time,
and their ids are cut apart again. Texts where white space follows white space are encoded whole if white space stays in the
ids, and so are texts that hold an added token such as <|endoftext|>, which the library takes out before it splits.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ridgeline.llm.common import slices, utf8

_MARK = "\x00"
#: A space to the library but not to Python.
_ALSO_SPACE = "᠎"
_GROUP = 256


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; ``name`` may be a path already."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _odd(piece: str) -> bool:
    return not piece or piece[0].isspace() or piece[-1].isspace() or piece[0] == _ALSO_SPACE or piece[-1] == _ALSO_SPACE


class Encoder:
    """Token ids as little-endian unsigned integers of ``dtype``.

    ``spaced``: white space stays in the ids, so a piece takes the space before it along (byte-level vocabularies);
    else white space only separates (vocabularies with word ends). A null text has no ids.
    """

    def __init__(self, name: str, spaced: bool, cache_pieces: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        self.all_whole = any(" " in t.content or t.normalized for t in added)  # such tokens show in the normalised text only, or across pieces
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 65536 else "<u4")
        self.spaced, self.limit = spaced, cache_pieces
        self.opens = np.zeros(max(size, 1), bool)  # ids that begin with a space
        self.closes = np.zeros(max(size, 1), bool)  # ids that end a word
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i], self.closes[i] = token.startswith("Ġ"), token.endswith("</w>")
        if not spaced:
            (self.mark,) = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.pool, self.used = np.zeros(1 << 20, self.dtype), 0  # ids of all entries
        self.first, self.count, self.entries = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0
        self.cache: dict[str, int] = {}  # entry of a piece, as it is after a space; -1 if the text must be encoded whole
        self.heads: dict[str, int] = {}  # entry of a piece, as it is at the start of a text
        self.nothing = int(self._add(np.zeros(0, self.dtype), [0])[0])

    def _add(self, ids: np.ndarray, counts) -> np.ndarray:
        """Numbers of new entries whose ids follow each other in ``ids``."""
        counts = np.asarray(counts, np.int32)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while self.entries + len(counts) > len(self.first):
            self.first, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.count))
        self.pool[self.used : self.used + len(ids)] = ids
        new = np.arange(self.entries, self.entries + len(counts))
        self.first[new], self.count[new] = self.used + np.cumsum(counts) - counts, counts
        self.used, self.entries = self.used + len(ids), self.entries + len(counts)
        return new

    def _gather(self, entries: np.ndarray) -> np.ndarray:
        """Ids of the entries, end to end."""
        n = self.count[entries].astype(np.int64)
        ends = np.cumsum(n)
        return self.pool[np.repeat(self.first[entries] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, into: dict[str, int], pieces: list[str], texts: list[str]) -> None:
        found = self._whole(texts)
        into.update(zip(pieces, self._add(np.concatenate([np.zeros(0, self.dtype), *found]), [len(x) for x in found]).tolist()))

    def _joined(self, into: dict[str, int], pieces: list[str], between: str, counts) -> list[str]:
        """Encodes pieces by the group; what can't be cut into as many parts as it has pieces comes back. ``counts``: ids (and marks) by part."""
        rest: list[str] = []
        groups = [pieces[i : i + _GROUP] for i in range(0, len(pieces), _GROUP)]
        before, after = (" ", "") if self.spaced else ("", between)
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([before + between.join(g) + after for g in groups], add_special_tokens=False)):
            ids = np.array(got.ids, self.dtype)
            ends = counts(ids)
            if len(ends) != len(group):
                rest += group
                continue
            n = np.diff(ends, prepend=0)
            if between != " ":  # marks are no part of the pieces
                ids, n = np.delete(ids, ends - 1), n - 1
            into.update(zip(group, self._add(ids, n).tolist()))
        return rest

    def _opened(self, ids: np.ndarray) -> np.ndarray:
        return np.append(np.flatnonzero(self.opens[ids])[1:], len(ids))

    def _closed(self, ids: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.closes[ids]) + 1

    def _marked(self, ids: np.ndarray) -> np.ndarray:
        return np.flatnonzero(ids == self.mark) + 1

    def _learn(self, missing: list[str]) -> None:
        """Entries of pieces: words by the group, cut where one ends or opens; a word gives one part, unless the vocabulary's idea of a letter differs."""
        words = [p for p in missing if p.isalpha()]
        rest = self._joined(self.cache, words, " ", self._opened if self.spaced else self._closed)
        others = [p for p in missing if not p.isalpha()]
        if self.spaced:
            behind = [p for p in others if p[:1] == _MARK and not _odd(p)]
            self._alone(self.cache, behind, [p[1:] for p in behind])
            odd = [p for p in others if _odd(p)]
            self.cache.update(dict.fromkeys(odd, -1))
            usual = list(set(others).difference(odd, behind))
            rest += self._joined(self.cache, usual, " ", self._opened)
        else:
            odd = [p for p in others if _odd(p) or _MARK in p]
            rest += odd + self._joined(self.cache, list(set(others).difference(odd)), f" {_MARK} ", self._marked)
        self._alone(self.cache, rest, [" " + p if self.spaced else p for p in rest])

    def _prepared(self, texts: pa.Array) -> pa.Array:
        """A space between a letter and stops, with a mark if white space counts; if it only separates, A-Z in lower case and line ends as spaces, too."""
        if self.spaced:
            return pc.replace_substring_regex(texts, "([A-Za-z])([.,;:!?])", r"\1 " + _MARK + r"\2")
        return pc.replace_substring_regex(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), "([a-z])([.,;:!?])", r"\1 \2")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        if len(self.cache) > self.limit or len(self.heads) > 40_000:
            self._forget()
        whole = np.full(n, self.all_whole)
        for a in self.added:
            whole |= np.asarray(pc.match_substring(texts, a, ignore_case=True))  # lower case makes one of <|EndOfText|>, too
        if self.spaced:
            whole |= np.asarray(pc.match_substring(texts, _MARK))
        split = pc.split_pattern(self._prepared(pc.if_else(pa.array(whole), "", texts)), " ")
        at = np.asarray(split.offsets).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        pieces, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices)
        heads: list[str] = []
        if self.spaced:  # the first piece of a text has no space before it
            heads = [pieces[i] for i in index[at[:-1]].tolist()]
            new = list({h for h in heads if not _odd(h)}.difference(self.heads))
            self._alone(self.heads, new, new)
            later = np.ones(len(index), bool)
            later[at[:-1]] = False
            needed = np.zeros(len(pieces), bool)
            needed[index[later]] = True
        else:
            needed = np.ones(len(pieces), bool)
        get, unknown = self.cache.get, -2
        entry = np.array([get(p, unknown) for p in pieces], np.int64)
        missing = np.flatnonzero((entry == unknown) & needed).tolist()
        self._learn([pieces[i] for i in missing])
        entry[missing] = [self.cache[pieces[i]] for i in missing]
        found = entry[index] if len(index) else np.zeros(0, np.int64)
        if self.spaced:
            found[at[:-1]] = [-1 if _odd(h) and h else self.heads[h] if h else self.nothing for h in heads]
            # a text that begins with a space has an empty head, too
            whole |= np.asarray(pc.match_substring_regex(texts, "^ "))
            whole |= np.logical_or.reduceat(found < 0, at[:-1])
        found[np.repeat(whole, np.diff(at))] = self.nothing
        ids = self._gather(found)
        offsets = np.concatenate(([0], np.cumsum(self.count[found], dtype=np.int64)))[at]
        for i in missing:
            if len(pieces[i]) > 100:  # hardly comes again
                self.cache.pop(pieces[i], None)
        if whole.any():
            some = np.flatnonzero(whole)
            parts = [ids[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            for i, got in zip(some.tolist(), self._whole(texts.take(pa.array(some)).to_pylist())):
                parts[i] = got
            ids, offsets = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))
        return ids, offsets


def encoded(found: Encoder, texts: pa.Array, end_id: int, run: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(rows i to j, ids with an end id after each text, offsets) for runs of texts of about ``run`` bytes."""
    _, offsets = utf8(texts)
    for i, j in slices(offsets, run):
        yield i, j, *ended(*found.encode(texts.slice(i, j - i)), end_id)


def ended(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with an end id after each."""
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))


@functools.lru_cache(2)
def encoder(name: str, spaced: bool) -> Encoder:
    """One encoder for all tasks of a Python worker, with what it has cached so far."""
    return Encoder(name, spaced, 700_000 if spaced else 400_000)
