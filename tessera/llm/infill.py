"""Fill-in-the-middle: a text's lines are dealt into prefix, middle and suffix, and written in another order.

A text is its UTF-8 bytes seen as one big integer, a byte a place. ``bytes.translate`` makes masks of byte
classes; shifting the mask of line ends by one place marks where lines start; ``bit_count`` counts lines and code
points; the place of the k-th line is found by halving the mask again and again, always keeping the half that
holds it. No step walks over lines or characters one by one, and each is linear in the text.

Where a text is cut, in which form and whether at all hangs on a hash of seed and doc_id alone: rows with one doc_id
are cut by the same numbers. Defined cases: null and empty texts, and texts that hold a mark, stay plain; null
doc_ids hash as the word null; extra columns are ignored; an empty table gives no row. Every row gives a row.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel

#: The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

_LINE_END = bytes(int(b == 0x0A) for b in range(256))
_CODE_POINT = bytes(int(not 0x80 <= b < 0xC0) for b in range(256))

FORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def below(bits: int) -> int:
    """A mask of so many low places."""
    return (1 << bits) - 1


def mask(data: bytes, table: bytes) -> int:
    """Bit 8 i is set if byte i is in the class that the table marks with 1."""
    return int.from_bytes(data.translate(table), "little")


def line_starts(data: bytes) -> int:
    """Where lines start: at the first byte and after every line end that isn't the last byte."""
    return (mask(data, _LINE_END) << 8 | 1) & below(8 * len(data))


def select(bits: int, rank: int, width: int) -> int:
    """Place of the set bit that ``rank`` set bits stand below; width bounds the places."""
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & below(half)
        before = low.bit_count()
        if rank < before:
            bits, width = low, half
        else:
            bits, rank, at, width = bits >> half, rank - before, at + half, width - half
    return at


def cut(data: bytes, starts: int, n: int, k: int) -> int:
    """Bytes of the first k of n lines."""
    return len(data) if k >= n else select(starts, k, 8 * len(data)) >> 3


def numbers(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 from the hash of seed and doc_id."""
    name = "null" if doc_id is None else doc_id
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{name}".encode()).digest()[:16])


def formed(data: bytes, doc_id: int | None, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Lines, form, code points of prefix and middle, and the output of one text."""
    starts = line_starts(data)
    n = starts.bit_count()
    h1, h2, h3, h4 = numbers(seed, doc_id)
    if not data or PREFIX in data or SUFFIX in data or MIDDLE in data or h3 % 100 >= rate:
        return n, "plain", None, None, data
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = cut(data, starts, n, first), cut(data, starts, n, second)
    points = mask(data[:b], _CODE_POINT)
    before = (points & below(8 * a)).bit_count()
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < spm:
        form, parts = "spm", (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    else:
        form, parts = "psm", (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return n, form, before, points.bit_count() - before, b"".join(parts)


def _form(seed: int, rate: int, spm: int):
    @kernel.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = kernel.column(batch, "doc_id")
            for texts in kernel.slices(kernel.column(batch, "text"), 1 << 22):
                ids = doc.slice(texts.first, texts.n)
                n, form, prefix, middle, output = zip(*(formed(texts.text(i), d, seed, rate, spm) for i, d in enumerate(ids.to_pylist())), strict=True)
                whole = pa.array(output, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), whole], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """(doc_id, text) transformed: n (lines), form (plain, psm or spm), prefix_chars, middle_chars, output.

    rate: texts of a hundred that are transformed; spm: of a hundred of these, those with the suffix first.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_form(seed, rate, spm), FORMED)


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, from output and form alone."""
    part = F.split(output, "<[PSM]>", -1)
    back = F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1]))
    return F.when(form == "plain", output).otherwise(back)
