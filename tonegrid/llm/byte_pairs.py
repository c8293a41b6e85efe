"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegrid.llm.common import slices, whole

#: Characters that the split pattern's ``\s`` takes as white space (the Unicode property, not Python's wider ``\s``).
BLANK = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Longer texts are cut at safe boundaries into parts of about so many characters.
PART = 1 << 16
#: Runs of white space of at least this length are encoded apart: the pattern's look-ahead backs up through them.
LONG_BLANK = 256

_SAFE = re.compile(f"(?<=[^{BLANK}]) (?=[^{BLANK}])")
_BLANKS = re.compile(f"[{BLANK}]{{{LONG_BLANK},}}")


@functools.lru_cache(maxsize=2)
def encoding(ranks: str, pattern: str):
    """The tokenizer of one rank file, built once per worker process."""
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def parts(text: str):
    """Cut at single blanks between two non-blanks.

    No match of the split pattern spans such a place: only a match's first character may be a blank followed by a
    non-blank. So the parts' matches are those of the whole text.
    """
    start = 0
    while len(text) - start > PART:
        cut = _SAFE.search(text, start + PART)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encode_text(enc, text: str) -> list[int]:
    """Ids as the tokenizer library gives them for ordinary text, at any length."""
    if len(text) <= LONG_BLANK:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in parts(text):
        start = 0
        for run in _BLANKS.finditer(part):
            # before a non-blank the run's last character is left to the next match
            stop = run.end() if run.end() == len(part) else run.end() - 1
            ids += enc.encode_ordinary(part[start : run.start()])
            ids += enc._encode_single_piece(part[run.start() : stop])
            start = stop
        ids += enc.encode_ordinary(part[start:] if start else part)
    return ids


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text: the id column and ``ids`` (array of int).

    Null and empty texts give an empty list. Rows are independent: repeated ids and texts stay as they are, other
    columns are not read. ``ranks`` is a path every worker can open. Texts of any length are encoded whole, in
    parts between safe boundaries; output batches hold about a million characters.
    """

    def run(batches):
        enc = encoding(ranks, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(t) for t in texts], 1 << 21):
                ids = [encode_text(enc, t) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32()))], ["_id", "ids"])

    rows = docs.select(F.col(id_col).alias("_id"), whole(F.col(text_col)).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode again in one pass: the id column, ``ids`` and ``decoded`` (the bytes those ids stand for).

    The same rows as ``decode`` over ``encode``, without handing the ids to the workers a second time.
    """

    def run(batches):
        enc = encoding(ranks, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(t) for t in texts], 1 << 21):
                ids = [encode_text(enc, t) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode_bytes(x) for x in ids], pa.binary())], ["_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("_id"), whole(F.col(text_col)).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, ids array<int>, decoded binary").withColumnRenamed("_id", id_col)


def decode(tokens: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw bytes of every id list: the id column, the columns named in ``keep``, and ``decoded`` (binary).

    Bytes are joined before anything reads them as text, so characters split between tokens come back whole. A null or
    empty list gives empty bytes; an unknown id is an error.
    """

    def run(batches):
        enc = encoding(ranks, pattern)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            data = [enc.decode_bytes(x.values.tolist()) if (x := lists[i]).is_valid and len(x) else b"" for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(data, pa.binary())], [*batch.schema.names[:-1], "decoded"])

    rows = tokens.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(ids_col).alias("_ids"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = rows.mapInArrow(run, f"{schema}, decoded binary")
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "decoded")
