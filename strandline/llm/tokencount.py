"""Token counts: pieces are counted once for each distinct pre-token and joined to the pre-token frequencies of documents.

SentencePiece turns spaces into a mark that only begins pieces, so no piece crosses from a word to the mark after it, and a run
of spaces with the word behind it is a unit of its own. Nor does any piece hold a line break with anything else, or a comma or
full stop behind a letter; so these part units as well. All of this is checked on the vocabulary. The first pass counts the
distinct pre-tokens of the corpus; the library then sees each of them once. The most frequent ones, up to a number of bytes, are
broadcast; all others meet the documents in a shuffle join, long ones by their digest. Pre-tokens too long to be broadcast may be
frequent (a banner without a space), so their rows are dealt over salts. Nothing but counts is kept: no ids.

Defined cases: null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each. Very long texts are counted whole; no ties arise. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import tokenizer_path
from .common import each, frequent_step, materialise, step_of, text_column, tidy

#: Pre-tokens whose counts are broadcast: the most frequent of at most LONG bytes each, this many at WEIGHT bytes each, or fewer longer ones.
FREQUENT, WEIGHT, LONG = 1 << 17, 64, 1024
#: Pre-tokens of more bytes are shuffled as digests.
PLAIN = 64
SALTS = 16
MARK = "▁"
LETTERS = "A-Za-z0-9\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
#: A comma or full stop behind a letter and before white space or the end: always one piece.
POINT = re.compile(rf"[.,](?<=[{LETTERS}][.,])(?=[ \n]|\Z)")
UNIT = re.compile(r" +[^ \n]+|\n[^ \n]*| +")


def pretokens(text: str) -> tuple[list[str], int]:
    """Units whose piece counts add up to that of the text, but for the points that were cut off, which are the second result.

    A unit is a word with all but one of the spaces before it (the library adds a mark where a text begins, as for a space), a
    line break with the word behind it, or a run of marks for spaces that no word follows.
    """
    if not text:
        return [], 0
    text, points = POINT.subn("", text.replace(MARK, " "))
    if "  " not in text and " \n" not in text and text[:1] not in (" ", "\n", "") and text[-1] != " ":
        return text.replace("\n", " \n").split(" "), points
    return [u if u[0] == "\n" else u[1:] if u[-1] != " " else MARK * len(u) for u in UNIT.findall(" " + text)], points


class PieceCounter:
    """Pieces of pre-tokens by the library."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = re.compile(rf"[^{MARK}]{MARK}|\n.|.\n|[{LETTERS}][.,]", re.S)
        for i in range(self.sp.vocab_size()):
            if crossing.search(self.sp.id_to_piece(i)):
                raise ValueError("a piece crosses a cut: counts by pre-token would not add up")
        for text, want in (("a", [MARK + "a"]), ("a,", [MARK + "a", ","]), ("a.", [MARK + "a", "."])):
            if [self.sp.id_to_piece(i) for i in self.sp.encode(text)] != want:
                raise ValueError("the model doesn't put a mark before the text, or has no piece for a point")

    def count(self, units: list[str]) -> list[int]:
        """The library puts a mark before each text: too many before a line break, and it counts as one of a run of marks."""
        plain = [" " * (len(u) - 1) if u[:1] == MARK else u for u in units]
        got = [len(x) for x in self.sp.encode(plain, num_threads=1)]
        return [1 if u == MARK else n - (u[:1] == "\n") for u, n in zip(units, got)]


_counters: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def distinct_pretokens(docs: DataFrame, flush: int = 200_000, flush_chars: int = 1 << 25) -> DataFrame:
    """pretoken, n over the whole corpus; each task sums before the shuffle, in a table that is emptied at ``flush`` entries or texts of ``flush_chars``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pretoken", "n"])

        for batch in tidy(batches):
            for text in each(batch.column(0)):
                seen.update(pretokens(text)[0])
                size += len(text)
                if len(seen) >= flush or size >= flush_chars:
                    yield out()
                    seen.clear()
                    size = 0
        yield out()

    return docs.select(text_column(docs).alias("text")).mapInArrow(run, "pretoken string, n bigint").groupBy("pretoken").agg(F.sum("n").alias("n"))


def piece_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """pretoken, n, pieces: the library's count for every distinct pre-token of the corpus."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    @F.arrow_udf("int")
    def pieces(units: pa.Array) -> pa.Array:
        return pa.array(counter(path).count(units.to_pylist()), pa.int32())

    return distinct_pretokens(docs).withColumn("pieces", pieces.asNondeterministic()("pretoken"))


def count_tokens(docs: DataFrame, limit: int = 4096, path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) for every row."""
    table = materialise(piece_counts(docs, path), "pieces")
    short = table.where(F.octet_length("pretoken") <= LONG)
    cut = frequent_step(short, "n", frequent * WEIGHT, F.greatest(F.lit(WEIGHT), F.octet_length("pretoken")))
    top = short.where(step_of(F.col("n")) >= cut).select("pretoken", "pieces").toArrow()
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(top["pretoken"].to_pylist(), top["pieces"].to_pylist())))
    kind = "struct<known: bigint, rest: array<struct<pretoken: string, f: bigint>>>"

    @F.arrow_udf(kind)
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        get = known.value.get
        for batch in tidy(batches):
            sums, offsets, names, counts = [], [0], [], []
            for text in each(batch):
                units, points = pretokens(text)
                got = list(map(get, units))
                if None in got:
                    rest = Counter(u for u, n in zip(units, got) if n is None)
                    names.extend(rest.keys())
                    counts.extend(rest.values())
                sums.append(points + sum(n for n in got if n is not None))
                offsets.append(len(names))
            rest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["pretoken", "f"]))
            yield pa.StructArray.from_arrays([pa.array(sums, pa.int64()), rest], ["known", "rest"])

    text = text_column(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), split.asNondeterministic()(text).alias("s"))
    # One row for each rest; a document's own columns stand in the first alone, so the others are small to shuffle.
    flat = rows.select("row", "doc_id", "n_bytes", F.col("s.known").alias("known"), F.posexplode_outer("s.rest").alias("at", "r"))
    once = lambda c: F.when(F.coalesce("at", F.lit(0)) == 0, F.col(c)).alias(c)
    key = lambda c: F.when(F.octet_length(c) <= PLAIN, F.col(c).cast("binary")).otherwise(F.unhex(F.sha2(F.col(c).cast("binary"), 512)))
    salt = lambda c, long: F.when(F.octet_length(c) > LONG, long).otherwise(F.lit(0))
    # Rows without rest get a key of their own (longer than any other), so that they don't meet in one task.
    alone = F.concat(F.repeat(F.lit(" "), PLAIN), F.col("row").cast("string")).cast("binary")
    own = F.coalesce(salt("r.pretoken", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")), F.lit(0))
    flat = flat.select(F.coalesce(F.when(F.col("r.pretoken").isNotNull(), key("r.pretoken")), alone).alias("key"), own.alias("salt"), "row", F.col("r.f").cast("int").alias("f"), once("doc_id"), once("n_bytes"), once("known"))
    parts = F.explode(F.sequence(F.lit(0), salt("pretoken", F.lit(SALTS - 1))))
    joined = flat.join(table.select(key("pretoken").alias("key"), parts.alias("salt"), "pieces"), ["key", "salt"], "left")
    rest = F.sum(F.coalesce(F.col("f") * F.col("pieces"), F.lit(0))).alias("rest")
    got = joined.groupBy("row").agg(rest, *[F.max(c).alias(c) for c in ("doc_id", "n_bytes", "known")])
    total = F.col("known") + F.col("rest")
    return got.select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
