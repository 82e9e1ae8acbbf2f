"""Quality rules: base word counts and compression bands.

The method compresses every whole text, and chunks that cover all of it, with zstandard. Well
formed prose keeps its ratio (bytes in per byte out) within a band that depends on the
length: short texts hardly compress, long ones compress more. A ratio above the band
means repetition, one below it means noise: ``LEAST`` lies above what random base64
reaches at each length, in words of four or more characters, and below what prose reaches.
A text goes when its whole ratio leaves the band of its length, or when ``CHUNK_SHARE`` of
its chunks or more leave the band of theirs. Texts are cut into equal chunks of at most
``CHUNK`` bytes, two at least; below ``SPLIT`` bytes the text is its only chunk.

Under about 100 bytes nothing compresses and no limit parts noise from prose, but most such
texts have fewer than twenty words. Random hexadecimal digits carry four bits a byte, as much
as or less than short prose, so only texts of over 16,384 bytes have a limit above them.

Defined results: a null text counts as empty; a text without words has no repeated
words, fails the base rule of twenty words and is not kept. Repeated rows give repeated
rows. Other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from unitwise.llm.common import prepare, slices, words

LEVEL = 3
CHUNK = 4096
CHUNK_SHARE = 0.5
SPLIT = 512
#: (bytes, least ratio), straight lines between them.
LEAST = ((64, 0.30), (100, 0.97), (128, 1.03), (160, 1.07), (200, 1.13), (256, 1.17), (320, 1.22), (400, 1.26), (512, 1.30),
         (800, 1.37), (1024, 1.40), (2048, 1.44), (4096, 1.47), (8192, 1.50), (16384, 1.50), (16385, 2.03))
#: (bytes up to, largest ratio); the last band has no upper length.
BANDS = ((256, 3.0), (1024, 3.5), (4096, 4.0), (16384, 4.5), (None, 5.0))
CHUNK_MOST = 4.5

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
          " base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long")


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    copies = 0
    for line in text.split("\n"):
        if line in seen:
            copies += 1
        elif line.strip(_SPACES):
            seen.add(line)
    return copies


def repeated_words(tokens: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more, first ones included.

    Equal windows get equal numbers by numbering ever longer runs (2, 4, 8 words) exactly.
    """
    n = len(tokens)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    code = np.fromiter((number.setdefault(w, len(number)) for w in tokens), np.int64, n)
    span = 1
    while span < window:
        code = np.unique(code[:-span] * np.int64(n + 1) + code[span:], return_inverse=True)[1].astype(np.int64)
        span *= 2
    again = np.bincount(code)[code] > 1
    if not again.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def band_of(size: int) -> tuple[float, float]:
    least = float(np.interp(size, *zip(*LEAST, strict=True)))
    for top, high in BANDS:
        if top is None or size <= top:
            return least, high
    raise AssertionError("the last band is open")


def compression_verdict(data: bytes, compress) -> tuple[bool, float, int, int]:
    """(kept, whole ratio, chunks, chunks outside the band of their length)."""
    if not data:
        return False, 0.0, 0, 0
    ratio = len(data) / len(compress(data))
    low, high = band_of(len(data))
    if len(data) < SPLIT:
        bad = int(not low <= ratio <= high)
        return not bad, ratio, 1, bad
    chunks, bad = max(2, -(-len(data) // CHUNK)), 0
    cuts = [len(data) * k // chunks for k in range(chunks + 1)]
    for start, end in zip(cuts, cuts[1:], strict=False):
        chunk = (end - start) / len(compress(data[start:end]))
        bad += not band_of(end - start)[0] <= chunk <= CHUNK_MOST
    return low <= ratio <= high and bad < CHUNK_SHARE * chunks, ratio, chunks, bad


def measure(text: str | None, compress) -> tuple:
    text = text or ""
    tokens = words(text)
    n = len(tokens)
    repeated = repeated_words(tokens)
    failed = n < 20 or 100 * repeated > 30 * n
    kept, ratio, chunks, bad = compression_verdict(text.encode("utf-8", "replace"), compress)
    return (n, len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, SYMBOLS)), duplicate_lines(text),
            repeated, failed, kept and not failed, ratio, chunks, bad)


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard
    compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in slices(batches, "text", 8 << 20):
        rows = [measure(x.as_py(), compress) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))],
            names=names)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row of counts and verdicts per row of ``docs`` (columns of ``SCHEMA``)."""
    prepare(docs.sparkSession)
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(_rules, SCHEMA)
