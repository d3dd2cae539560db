"""Token ids of whole texts with a tokenizer file of the ``tokenizers`` library.

Both supported kinds of file split a text before encoding it, and never across a
single space between two non-space characters (byte-level BPE puts the space at the
front of what follows; word BPE lower-cases and drops white space).  A batch of
texts is cut there, each distinct piece is looked up once in a bounded table per
Python worker, and unknown pieces are encoded by the library, many at a time.
"""

from __future__ import annotations

import os
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: a space next to another white-space character (every kind that Python or the library knows)
_WHITE = "\\t\\n\\x0b\\x0c\\r \\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_ODD = f" [{_WHITE}]|[{_WHITE}] "
_CUT = re.compile(r"(?<=\S) (?=\S)")
CACHE = 250_000
CACHED_BYTES = 32
GROUP = 128
AT_ONCE = 32


class _Known:
    """Ids of distinct pieces, as arrays."""

    def __init__(self, words: pa.Array, size: np.ndarray, ids: np.ndarray):
        self.words, self.size, self.ids = words, size, ids
        self.begin = np.cumsum(size) - size

    def take(self, at: np.ndarray) -> "_Known":
        size = self.size[at]
        where = np.repeat(self.begin[at] - (np.cumsum(size) - size), size)
        return _Known(self.words.take(pa.array(at)), size, self.ids[where + np.arange(len(where))])

    def plus(self, other: "_Known") -> "_Known":
        return _Known(pa.concat_arrays([self.words, other.words]), np.concatenate([self.size, other.size]),
                      np.concatenate([self.ids, other.ids]))


_NONE = _Known(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, "<u4"))


class Encoder:
    """``encode(texts)``: all ids (unsigned 32-bit) and each text's offsets into them.

    Unknown pieces are encoded together with a mark between them that has an id of
    its own and that ids never cross: a special token of the file, or for word BPE a
    control character among spaces, which is faster.
    """

    def __init__(self, path: str, keep_space: bool, special: str = "<|endoftext|>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.load = path, Tokenizer.from_file
        self.marked = Tokenizer.from_file(path)
        self.keep_space = keep_space
        self.mark = special if keep_space else " \x01 "
        (self.mark_id,) = self.marked.encode(self.mark, add_special_tokens=False).ids
        self.known = [_NONE, _NONE]

    @cached_property
    def lib(self):
        lib = self.load(self.path)
        lib.encode_special_tokens = True  # their strings in a text are ordinary text
        return lib

    def _raw(self, pieces: list[str]) -> list[np.ndarray]:
        out: dict[str, np.ndarray] = {}
        plain = [p for p in pieces if "<|" not in p and "\x01" not in p]
        groups = [plain[lo:lo + GROUP] for lo in range(0, len(plain), GROUP)]
        for lo in range(0, len(groups), AT_ONCE):  # the library's results are far larger than the ids
            some = groups[lo:lo + AT_ONCE]
            coded = self.marked.encode_batch_fast([self.mark.join(g) for g in some], add_special_tokens=False)
            for part, code in zip(some, coded):
                ids = np.array(code.ids, "<u4")
                cuts = [-1, *np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
                out.update((p, ids[a + 1:b]) for p, a, b in zip(part, cuts, cuts[1:]))
        return [out[p] if p in out else np.array(self.lib.encode(p, add_special_tokens=False).ids, "<u4") for p in pieces]

    def _look_up(self, pieces: pa.Array, lead: str) -> _Known:
        """Ids of distinct pieces that follow ``lead``, in their order; the table keeps the short ones."""
        known = self.known[bool(lead)]
        at = pc.fill_null(pc.index_in(pieces, value_set=known.words), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(known.words) + len(new) > CACHE:  # what this batch has not seen goes
                used = np.flatnonzero(at >= 0)
                known = known.take(at[used])
                at[used] = np.arange(len(used))
            words = pieces.take(pa.array(new))
            ids = self._raw([lead + p for p in words.to_pylist()])
            at[new] = len(known.words) + np.arange(len(new))
            known = known.plus(_Known(words, np.fromiter(map(len, ids), np.int64, len(ids)), np.concatenate(ids)))
            short = pc.less_equal(pc.binary_length(known.words), CACHED_BYTES).to_numpy(zero_copy_only=False)
            self.known[bool(lead)] = known if short.all() else known.take(np.flatnonzero(short))
        return known.take(at)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        if self.keep_space:
            odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
            if odd.any():
                cut = pa.array([_CUT.split(t) if o else t.split(" ") for t, o in zip(texts.to_pylist(), odd)],
                               pa.list_(pa.string()))
            else:
                cut = pc.split_pattern(texts, " ")
        else:
            # a comma or full stop behind an ASCII letter or digit starts a token of its own
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), "([0-9a-z])([,.]) ", "\\1 \\2 ")
            cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        flat = cut.flatten()
        coded = flat.dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        own = self._look_up(coded.dictionary, " " if self.keep_space else "")
        if self.keep_space and len(texts):  # a text's first piece follows no space
            first = offsets[:-1]
            begins = pc.take(flat, pa.array(first)).dictionary_encode()
            code[first] = begins.indices.to_numpy().astype(np.int64) + len(own.words)
            own = own.plus(self._look_up(begins.dictionary, ""))
        lens = own.size[code]
        ends = np.concatenate([[0], np.cumsum(lens)])
        at = np.repeat(own.begin[code] - ends[:-1], lens)
        at += np.arange(len(at))
        return own.ids[at], ends[offsets]

    def encode_documents(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The same with ``end_id`` after every text."""
        ids, offsets = self.encode(texts)
        return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, keep_space: bool) -> Encoder:
    """The worker's encoder for a file."""
    if (path, keep_space) not in _ENCODERS:
        _ENCODERS[path, keep_space] = Encoder(path, keep_space)
    return _ENCODERS[path, keep_space]
