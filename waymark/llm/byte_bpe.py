"""Operator 12: byte-level BPE encoding and decoding by the tiktoken library with a local rank file.

The driver reads the rank file (about a megabyte) and broadcasts it, so executors need no file of their own; a worker builds its
encodings once. Each text is encoded on its own, without special tokens.

Long texts. A text over SPAN characters is split first, only where no match of the pattern can reach across, so the ids are those
of the whole text: where white space begins, before the last character of white space that something follows, and between a
letter or digit and plain punctuation. White space of LONG_SPACE characters and more, on which the pattern's look-ahead would run
out of stack, is cut out whole: it is one match. A stretch without such a place stays one span; the library merges it in
n log n steps.

Decoding joins the tokens' raw bytes, so ids that end inside a character give its first bytes and no replacement sign.

Cases. A null text is encoded as an empty one, null ids decode to no bytes, a null among ids is passed over; an id that the rank
file does not have is an error. Rows are independent: repeated ones, null ids of documents and ties need no rule. Other columns
stay; the new one gets underscores while a column has its name.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from waymark.llm.common import free_name

#: Characters up to which a text is encoded in one call, and up to which white space is left to the pattern.
SPAN, LONG_SPACE = 1 << 14, 1 << 12
#: Rows of a result batch, so that ids of long texts do not pile up.
ROWS = 256

WHITE = r"\p{White_Space}"
#: Letters and digits whose class no Unicode version changes.
PLAIN = r"A-Za-z0-9À-ÖØ-öЀ-яぁ-ゖァ-ヺ一-龥가-힣"
CUT = regex.compile(rf"(?<=\P{{White_Space}})(?={WHITE})|(?<={WHITE})(?={WHITE}\P{{White_Space}})|(?<=[{PLAIN}])(?=[.,;:!?()、。，！？])")
BLANK = regex.compile(rf"{WHITE}{{{LONG_SPACE},}}")


def spans(text: str, span: int = SPAN) -> Iterator[tuple[str, bool]]:
    """(part, whether it is one match) of a text; the parts' ids in order are the text's."""
    if len(text) <= span:
        yield text, False
        return
    done = 0
    for blank in [*BLANK.finditer(text), None]:
        end = blank.start() if blank else len(text)
        while done < end:
            cut = CUT.search(text, done + span, end) if end - done > span else None
            stop = cut.start() if cut else end
            yield text[done:stop], False
            done = stop
        if blank:
            # the last character of white space may belong to what follows
            done = blank.end() if blank.end() == len(text) else blank.end() - 1
            yield text[blank.start() : done], True


class Codec:
    """The encodings of a rank file: by the pattern, and of a text that is one match."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.by_pattern = tiktoken.Encoding("by_pattern", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.as_one = tiktoken.Encoding("as_one", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        parts = [(self.as_one if one else self.by_pattern).encode_to_numpy(part, disallowed_special=()) for part, one in spans(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def decode(self, ids: list[int]) -> bytes:
        return self.by_pattern.decode_bytes(ids)


_codecs: dict[tuple[bytes, str], Codec] = {}


def codec_of(ranks: bytes, pattern: str) -> Codec:
    """A worker's codec, built once for a rank file and pattern."""
    key = (sha256(ranks).digest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def mapped(df: DataFrame, column: str, name: str, kind: ArrayType | BinaryType, rank_file: str, pattern: str, convert) -> DataFrame:
    """``df`` with the column ``name`` that ``convert(codec, values)`` makes of ``column``, ROWS rows at a time."""
    ranks = df.sparkSession.sparkContext.broadcast(Path(rank_file).read_bytes())
    at, name = df.columns.index(column), free_name(df, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks.value, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, convert(codec, part.column(at))], [*part.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(name, kind))


def ids_of(codec: Codec, texts: pa.Array) -> pa.Array:
    ids = [codec.encode(t or "") for t in texts.to_pylist()]
    ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))


def bytes_of(codec: Codec, lists: pa.Array) -> pa.Array:
    flat, ends = np.asarray(lists.flatten().fill_null(-1)), np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0)))).tolist()
    return pa.array([codec.decode(own[own >= 0].tolist() if (own < 0).any() else own.tolist()) for own in (flat[a:b] for a, b in pairwise(ends))], pa.binary())


def encoded(df: DataFrame, rank_file: str, pattern: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``df`` with the token ids of the whole text."""
    return mapped(df, text, name, ArrayType(IntegerType()), rank_file, pattern, ids_of)


def decoded(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", name: str = "bytes") -> DataFrame:
    """``df`` with the raw bytes of the token ids."""
    return mapped(df, ids, name, BinaryType(), rank_file, pattern, bytes_of)
