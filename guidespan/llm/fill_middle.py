"""Fill-in-middle transformation by in-place rotation of blocks.

A text is cut in lines, two cuts drawn from a hash of its id make prefix, middle and suffix of it, and the three parts get sentinels in
front, in a bytearray: ``<P>prefix<M>middle<S>suffix``. One exchange of neighbouring blocks then gives either form. The exchange
reverses each block and then both together, in place; the same with the lengths swapped undoes it. So what is written can be read
back from the output and its form alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guidespan.llm.common import append, fresh, pieces

#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes that a reversal holds besides the text.
STEP = 1 << 16


def reverse(view: np.ndarray, start: int, end: int) -> None:
    """Reverse view[start:end] in place, a bounded number of bytes at a time."""
    while end - start > 1:
        step = min(STEP, (end - start) // 2)
        low = view[start : start + step].copy()
        view[start : start + step] = view[end - step : end][::-1]
        view[end - step : end] = low[::-1]
        start, end = start + step, end - step


def exchange(view: np.ndarray, start: int, middle: int, end: int) -> None:
    """Make the blocks [start, middle) and [middle, end) change places, by three reversals."""
    reverse(view, start, middle)
    reverse(view, middle, end)
    reverse(view, start, end)


def line_ends(text: bytes) -> np.ndarray:
    """The byte after each line: a line ends after its line feed, or with the text."""
    ends = np.nonzero(np.frombuffer(text, np.uint8) == 10)[0] + 1
    return ends if not text or text.endswith(b"\n") else np.append(ends, len(text))


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits, from the SHA-256 of ``seed:key``."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(text: bytes, h: tuple[int, int, int, int], rate: int = 100, spm_rate: int = 50) -> tuple[bytes, str, int, int, int]:
    """(output, form, lines, byte where the middle starts, byte where it ends) of a text; a plain text is its own output."""
    ends = line_ends(text)
    n = len(ends)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return text, PLAIN, n, 0, 0
    first, last = (int(ends[k - 1]) if k else 0 for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    out = bytearray(text)
    out[last:last], out[first:first], out[0:0] = SUFFIX, MIDDLE, PREFIX
    view = np.frombuffer(out, np.uint8)
    at_middle, at_suffix = len(PREFIX) + first, len(PREFIX) + len(MIDDLE) + last
    form = SPM if h[3] % 100 < spm_rate else PSM
    exchange(view, 0 if form == SPM else at_middle, at_suffix, len(out))
    del view  # a bytearray that is looked at can't grow
    return bytes(out), form, n, first, last


def restore(output: bytes, form: str) -> bytes:
    """The text that ``transform`` made this output of."""
    if form == PLAIN:
        return output
    out = bytearray(output)
    view = np.frombuffer(out, np.uint8)
    start = 0 if form == SPM else out.index(SUFFIX)
    # The suffix stands before the block that is to go back in front of it.
    exchange(view, start, out.index(PREFIX if form == SPM else MIDDLE), len(out))
    del view
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = out.index(sentinel)
        del out[at : at + len(sentinel)]
    return bytes(out)


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, the text replaced by its output, and after them fim_form (``plain``, ``psm``, ``spm``) (under another
    name if ``docs`` has one like this).

    rate: percent of the texts that are transformed; spm_rate: percent of these that have the suffix in front. A null text becomes the
    empty text, plain; texts that hold a sentinel stay as they are. A null id draws as the empty key. Repeated rows give repeated
    rows; an empty table gives an empty result.
    """
    text, form, key = fresh(docs, "fim_text", "fim_form", "fim_key")
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    packed = docs.withColumn(key, F.concat(F.length(name).cast("string"), F.lit(":"), name, F.coalesce(F.col(text_col).cast("string"), F.lit(""))))

    def work(texts):
        out = []
        for both in texts:
            size, _, rest = both.partition(":")
            done = transform(rest[int(size) :].encode(), draws(seed, rest[: int(size)]), rate, spm_rate)
            out.append((done[0].decode(), done[1]))
        return [[x for x, _ in out], [x for _, x in out]]

    made = append(packed, key, [(text, T.StringType()), (form, T.StringType())], work)
    return made.select(*(F.col(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns), form)


def restored(docs: DataFrame, text_col: str = "text", form_col: str = "fim_form") -> DataFrame:
    """The rows of ``fill_in_middle`` with their texts as they were, without the form's column. Null texts come back empty."""
    text, both = fresh(docs, "fim_text", "fim_both")
    packed = docs.withColumn(both, F.concat(F.substring(form_col, 1, 3), F.coalesce(F.col(text_col), F.lit(""))))
    names = {"pla": PLAIN, PSM: PSM, SPM: SPM}
    made = append(packed, both, [(text, T.StringType())], lambda rows: [[restore(x[3:].encode(), names[x[:3]]).decode() for x in rows]])
    return made.select(*(F.col(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != form_col))


def describe(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return, for every row, id, n (lines), form, prefix_chars, middle_chars (null if plain), output_sha256 and restored_sha256, the
    digest of the text that is rebuilt from output and form alone.

    Nulls, empty and repeated rows as in ``fill_in_middle``; other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(id_col).cast("string").alias("_key"))
    kind = rows.schema[0].dataType
    id_type = to_arrow_type(kind)

    def run(batches):
        for ids, texts, keys in pieces(batches):
            out = []
            for text, key in zip(texts, keys, strict=True):
                data = (text or "").encode()
                made, form, n, first, last = transform(data, draws(seed, key or ""), rate, spm_rate)
                chars = (None, None) if form == PLAIN else (len(data[:first].decode()), len(data[first:last].decode()))
                out.append((n, form, *chars, hashlib.sha256(made).hexdigest(), hashlib.sha256(restore(made, form)).hexdigest()))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names)

    names = ["_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    return rows.mapInArrow(run, f"_id {kind.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string").withColumnRenamed("_id", id_col)
