"""What the operators of this subpackage share: Arrow text access, words, row numbers, bounded label samples."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import every_column, spare
from ..sources.staging import discard, materialise, numbered, shared_path

__all__ = [
    "discard", "each", "every_column", "flat", "frequent_step", "labelled_sample", "materialise", "numbered", "raw_texts", "remainder", "runs", "shared_path", "spare", "step_of", "text_column",
    "tidy", "word_slices", "words",
]

#: Lower-cases A-Z, keeps 0-9, a-z and every byte of a non-ASCII character, turns the rest into spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def text_column(df: DataFrame, text_col: str = "text") -> Column:
    """The text as a non-null string: null counts as empty."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a batch, and the n+1 offsets of its texts in them; null counts as empty."""
    arr = texts.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and off[-1] else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def runs(offsets: np.ndarray, most: int = 1 << 19, texts: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at most ``texts`` texts, of at most ``most`` bytes in all; a longer text is a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        stop = min(stop, start + texts, n)
        yield start, stop
        start = stop


def tidy(batches: Iterable) -> Iterator:
    """The batches; at their end, freed memory goes back to the system, as an idle Python worker keeps what it holds."""
    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def each(texts: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """The texts one after the other, without a list of a whole batch."""
    for at in range(0, len(texts), rows):
        yield from texts.slice(at, rows).to_pylist()


def raw_texts(texts: pa.Array) -> Iterator[bytes]:
    """The texts as UTF-8, one after the other; null counts as empty."""
    data, off = flat(texts)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        yield data[a:b].tobytes()


def word_slices(raw: bytes, table: bytes = WORD_BYTES, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of one text that ``table`` leaves between spaces, some at a time: a slice of a long text ends where a word does."""
    raw, at = raw.translate(table), 0
    while at < len(raw):
        end = len(raw)
        if end - at > size:
            end = raw.rfind(b" ", at, at + size)
            end = raw.find(b" ", at + size) if end < 0 else end
            end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end + 1


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text after lower-casing A-Z, as UTF-8."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


def remainder(column: Column | str, n: int) -> Column:
    """crc32 of an id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary") if isinstance(column, str) else column.cast("string").cast("binary")) % n


def labelled_sample(labels: DataFrame, column: str, limit: int | None, holdout: tuple[int, int] | None = (5, 0)) -> DataFrame:
    """At most ``limit`` labelled rows (doc_id, y), one for each id (the larger label wins), chosen by a hash of the id; all without limit.

    Ids whose crc32 leaves the remainder ``holdout[1]`` modulo ``holdout[0]`` are left out. The bound lets callers broadcast it.
    """
    kept = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    if holdout:
        kept = kept.where(remainder("doc_id", holdout[0]) != holdout[1])
    kept = kept.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))
    if limit is None:
        return kept
    # The hash first leaves some more than ``limit`` rows, so that no task takes that many from every partition.
    share = int(min(1e6, 1.5e6 * limit / max(1, kept.count())) + 1)
    return kept.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def step_of(n: Column) -> Column:
    """A count on a coarse scale that keeps order: exact up to 64, then 32 steps for each doubling."""
    return F.when(n <= 64, n).otherwise(F.floor(F.log2(n) * 32) - 128).cast("int")


def frequent_step(counts: DataFrame, n: str, most: int, weight: Column | None = None) -> int:
    """The least step of ``step_of`` so that the rows at it and above weigh ``most`` at the most (their number, without a weight).

    What decides is a histogram of some 2,000 rows, so no task sorts or takes the rows themselves.
    """
    weight = F.lit(1) if weight is None else weight
    found = counts.groupBy(step_of(F.col(n)).alias("step")).agg(F.sum(weight).alias("w")).collect()
    total, cut = 0, 1 << 30
    for r in sorted(found, key=lambda r: -r["step"]):
        total += r["w"]
        if total > most:
            break
        cut = r["step"]
    return cut

