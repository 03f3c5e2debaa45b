"""Exact ids of whole texts from the tokenizers library, with a bounded cache of distinct chunks.

A byte-level BPE splits text before it merges, and always splits right before a single space that follows a non-space.
So a text cut at its spaces gives the same ids as the whole text, unless a space stands between other white space. Likewise
around a line break between other characters, and before a comma or full stop that follows a letter or digit and ends a chunk.
Each distinct chunk goes through the library once while it is in the cache; any text for which a cut could matter (such white
space, a special token, a NUL) is cut at spaces only, or goes through it whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np

#: Distinct chunks kept by one Python worker, about 150 bytes each.
CACHE_CHUNKS = 1_000_000
#: A comma or full stop at the end of a chunk that follows anything but these letters and digits: it may belong to a longer run.
UNSAFE_MARKS = re.compile(r"[.,](?=[ \n])(?<![A-Za-z0-9\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F][.,])")


def irregular(chunk: str) -> bool:
    """Whether a chunk shows white space next to a cut, where the cut could matter."""
    if not chunk:
        return True
    return chunk != "\n" and (chunk[-1].isspace() or chunk[chunk[0] == " "].isspace())


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class ChunkEncoder:
    """Ids of texts as little-endian integers: two bytes each if the vocabulary allows, else four."""

    def __init__(self, path: str | None = None, cache_chunks: int = CACHE_CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or tokenizer_path())
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes | None] = {}  # None: a chunk that shows that its text must go whole
        self.most = cache_chunks
        mark = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = mark[0] if len(mark) == 1 else None

    def _library(self, texts: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of regular chunks without line breaks: as the lines of one text, cut at the ids of the line breaks."""
        if len(chunks) > 1 and self.line is not None:
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(chunks)], add_special_tokens=False)[0].ids, self.dtype)
            at = np.flatnonzero(ids == self.line)
            if len(at) == len(chunks) - 1:
                raw, size = ids.tobytes(), self.dtype.itemsize
                starts, stops = [0, *((at + 1) * size).tolist()], [*(at * size).tolist(), len(raw)]
                return [raw[a:b] for a, b in zip(starts, stops)]
        return self._library(chunks)

    def encode(self, texts: Iterable[str | None], slice_chars: int = 1 << 19) -> Iterator[bytes]:
        """The ids of each text; texts are taken in slices of some ``slice_chars`` characters."""
        held, chars = [], 0
        for text in texts:
            text = text or ""
            if held and chars + len(text) > slice_chars:
                yield from self._slice(held)
                held, chars = [], 0
            held.append(text)
            chars += len(text)
        yield from self._slice(held)

    def _cut(self, text: str) -> list[str] | None:
        if "\x00" in text or any(s in text for s in self.special):
            return None
        marked = text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ")
        if not UNSAFE_MARKS.search(text):
            marked = marked.replace(",\x00", "\x00,\x00").replace(".\x00", "\x00.\x00")
        return marked.strip("\x00").split("\x00") if text else []

    def _slice(self, texts: list[str]) -> Iterator[bytes]:
        cache = self.cache
        cut = [self._cut(t) for t in texts]
        new: set[str] = set()
        for chunks in cut:
            if chunks:
                new.update(set(chunks).difference(cache))
        breaks = new.intersection(("\n",))
        fresh = [c for c in new if c != "\n" and not irregular(c)]
        cache.update(zip(breaks, self._library(list(breaks))))
        cache.update((c, None) for c in new.difference(fresh, breaks))
        cache.update(zip(fresh, self._chunks(fresh)))
        get = cache.__getitem__
        for text, chunks in zip(texts, cut):
            got = list(map(get, chunks)) if chunks is not None else [None]
            yield self._library([text])[0] if None in got else b"".join(got)
        if len(cache) > self.most:  # full: what came first stays, as common chunks come early
            for c in new:
                del cache[c]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The encoder of this Python worker for the file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
