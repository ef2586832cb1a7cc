"""Fill-in-the-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of ``FRAME`` bytes with the running counts of its units and code
points at the end of each frame.  A cut after unit u lies in the first frame whose count reaches u: only that frame is
decompressed to find it, so choosing prefix, middle and suffix of a text costs two frames whatever its length.  Digests
stream the frames in output order, one frame in memory at a time; the exact text is rebuilt by reading the output as
it comes, marker by marker, into compressed segments that are then read in text order.  The store is a written table of
one row per document: nothing is shuffled, and a lost task repeats its own documents only.

A unit is white space (0x20, 0x09-0x0D) followed by other characters, or the white space that ends a text.  These bytes
never occur inside a longer UTF-8 character, so bytes and code points split alike.

Defined results: a null or empty text has no units, form plain and the digest of nothing.  A text that holds a marker
stays plain, so every marker in other outputs is one that was put there.  A null doc_id draws from ``42:``
alone.  Repeated rows are transformed alike, one row each.  Texts are never cut short.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

FRAME, LEVEL, FLUSH = 1 << 16, 1, 8 << 20
#: percent of texts that are transformed, and of these percent with the suffix first
RATE, SUFFIX_FIRST = 50, 80
MARKER = re.compile(rb"<[PSM]>")
ORDER = {"psm": "PSM", "spm": "SPM"}
STORE = "doc_id long, h1 long, h2 long, h3 long, h4 long, marked boolean, units array<long>, chars array<long>, frames array<binary>"
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
Place = tuple[int, int, int]  # frame, byte in it, code points before

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True


def _ends(data: bytes) -> np.ndarray:
    """Offsets where a unit ends before the last byte: other characters, then white space."""
    space = _space[np.frombuffer(data, np.uint8)]
    return np.flatnonzero(~space[:-1] & space[1:]) + 1


def _points(data: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))


class Frames:
    """A text as compressed frames with running counts."""

    def __init__(self, units: list[int], chars: list[int], frames: list[bytes]) -> None:
        self.units, self.chars, self.frames = units, chars, frames
        self.open = zstandard.ZstdDecompressor().decompress

    @classmethod
    def of(cls, text: bytes, compress: Callable[[bytes], bytes]) -> Frames:
        units, chars, frames, n, c = [], [], [], 0, 0
        for at in range(0, len(text), FRAME):
            data = text[at:at + FRAME]
            # one byte more shows whether a unit ends with the frame
            n += len(_ends(text[at:at + FRAME + 1])) + (at + FRAME >= len(text))
            c += _points(data)
            units.append(n)
            chars.append(c)
            frames.append(compress(data))
        return cls(units, chars, frames)

    @property
    def end(self) -> Place:
        return (len(self.frames), 0, self.chars[-1] if self.chars else 0)

    def cut(self, unit: int) -> Place:
        """Where the first ``unit`` units end; one frame is decompressed."""
        if not unit:
            return (0, 0, 0)
        f = bisect_left(self.units, unit)
        data = self.open(self.frames[f])
        ends = _ends(data)
        k = unit - (self.units[f - 1] if f else 0)
        if k > len(ends):  # the unit ends with the frame
            return (f + 1, 0, self.chars[f])
        at = int(ends[k - 1])
        return (f, at, (self.chars[f - 1] if f else 0) + _points(data[:at]))

    def stream(self, start: Place, end: Place) -> Iterator[bytes]:
        for f in range(start[0], min(end[0] + 1, len(self.frames))):
            if f == end[0] and not end[1]:
                return
            yield self.open(self.frames[f])[start[1] if f == start[0] else 0:end[1] if f == end[0] else None]


def output(text: Frames, form: str, first: Place, second: Place) -> Iterator[bytes]:
    """The transformed text, frame by frame."""
    parts = {"P": ((0, 0, 0), first), "M": (first, second), "S": (second, text.end)}
    if form == "plain":
        yield from text.stream((0, 0, 0), text.end)
    else:
        for name in ORDER[form]:
            yield f"<{name}>".encode()
            yield from text.stream(*parts[name])


def restored(chunks: Iterable[bytes], form: str, compress: Callable[[bytes], bytes]) -> Iterator[bytes]:
    """The text that an output was made of, from the output and its form alone."""
    if form == "plain":
        yield from chunks
        return
    parts: dict[bytes, list[bytes]] = {}
    held, name = b"", b""
    for chunk in chain(chunks, [None]):
        data = held + (chunk or b"")
        at, sure = 0, len(data) if chunk is None else len(data) - 2  # a marker may go on in the next chunk
        for m in MARKER.finditer(data):
            if name:
                parts[name].append(compress(data[at:m.start()]))
            name, at = m[0], m.end()
            parts[name] = []
        sure = max(at, sure, 0)
        if sure > at:
            parts[name].append(compress(data[at:sure]))
        held = data[sure:]
    opened = zstandard.ZstdDecompressor().decompress
    for name in (b"<P>", b"<M>", b"<S>"):
        yield from map(opened, parts[name])


def _digest(chunks: Iterable[bytes]) -> str:
    digest = hashlib.sha256()
    for chunk in chunks:
        digest.update(chunk)
    return digest.hexdigest()


def _compressor() -> Callable[[bytes], bytes]:
    return zstandard.ZstdCompressor(level=LEVEL).compress


def _batches(rows: Iterable[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of about FLUSH bytes of (row, bytes of the row)."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n + 200
        if size > FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compress = _compressor()
    longs = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), *((f"h{k}", pa.int64()) for k in (1, 2, 3, 4)), ("marked", pa.bool_()),
                        ("units", longs), ("chars", longs), ("frames", pa.list_(pa.binary()))])

    def rows() -> Iterator[tuple[tuple, int]]:
        for batch in batches:
            for *key, text in zip(*batch.columns, strict=True):
                text = text.as_py()
                found = Frames.of(text, compress)
                yield (*(x.as_py() for x in key), MARKER.search(text) is not None, found.units, found.chars, found.frames), len(text)

    return _batches(rows(), schema)


def store(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The frames of every text with the four draws of its doc_id: one row per input row."""
    digest = F.sha2(F.concat(F.lit("42:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *draws, text).mapInArrow(_stored, STORE)


def fill_in_middle(spark: SparkSession, frames: DataFrame, with_output: bool = False) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, if asked for, output."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in RESULT.split(", ")]
    schema = pa.schema([*zip(names, kinds, strict=True), *([("output", pa.string())] if with_output else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = _compressor()

        def rows() -> Iterator[tuple[tuple, int]]:
            for batch in batches:
                for row in zip(*batch.columns, strict=True):
                    doc_id, h1, h2, h3, h4, marked, *parts = (x.as_py() for x in row)
                    text = Frames(*parts)
                    n = text.units[-1] if text.units else 0
                    if not n or marked or h3 % 100 >= RATE:
                        form, first, second, lengths = "plain", text.end, text.end, (None, None)
                    else:
                        form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
                        first, second = map(text.cut, sorted((h1 % (n + 1), h2 % (n + 1))))
                        lengths = first[2], second[2] - first[2]
                    digests = (_digest(output(text, form, first, second)),
                               _digest(restored(output(text, form, first, second), form, compress)))
                    whole = (b"".join(output(text, form, first, second)).decode(),) if with_output else ()
                    yield (doc_id, n, form, *lengths, *digests, *whole), sum(map(len, whole))

        return _batches(rows(), schema)

    return frames.mapInArrow(run, RESULT + ", output string" * with_output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` transformed: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    frames = Scratch(spark, "frames").keep(store(spark, table(spark, sf_dir, "documents")))
    return fill_in_middle(spark, frames)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
             CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2,
             CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(w) AS BIGINT) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
