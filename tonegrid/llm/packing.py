"""Packing: documents end to end on one line of tokens, cut into windows of a fixed length."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.llm.common import whole
from tonegrid.session import materialize

#: Tokens of a sequence.
LENGTH = 4096
#: Fixed value: the id after every document.
END = 2
#: Bytes of an id (little-endian, unsigned).
WIDTH = 4
#: Words a worker remembers the ids of, and the longest of them.
REMEMBERED = 1 << 20
LONGEST = 64
#: Characters cut into words at once.
PART = 1 << 20

#: Words end at ASCII blanks, and between a Latin letter and ASCII punctuation.
_WORDS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]++(?=[!-/:-@\[-`{-~ \t\n\r\f\v]|\Z)|[^ \t\n\r\f\v]++")
_BLANK = re.compile(r"[ \t\n\r\f\v]")


class Codes(dict):
    """Ids of words as bytes.

    The vocabulary's tokenizer drops white space and never merges across it, nor from a letter to punctuation, and its
    normalisation composes no character with a following blank or ASCII mark. So the words' ids, end to end, are the
    text's ids, and a word has to be encoded once, whatever the case of its ASCII letters. Strings of special tokens are
    ordinary text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True

    def __missing__(self, word: str) -> bytes:
        low = word.lower() if word.isascii() else word
        if low != word and low in self:
            ids = self[low]
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        """Ids of a whole text, cut into words in portions that end at blanks."""
        out, start = [], 0
        while len(text) - start > PART and (cut := _BLANK.search(text, start + PART)):
            out.append(b"".join(map(self.__getitem__, _WORDS.findall(text, start, cut.start()))))
            start = cut.start()
        out.append(b"".join(map(self.__getitem__, _WORDS.findall(text, start))))
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def codes(path: str) -> Codes:
    """One memory of words per worker process and vocabulary."""
    return Codes(path)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass: id column, ``ids`` (little-endian bytes, with the end id), ``n``, ``part`` and ``at``.

    ``part`` is the task that encoded the row and ``at`` the tokens of that task before it. They hold only for this
    table, so it has to be written before anything is made of them.
    """

    def run(batches):
        known, end, part, at = codes(tokenizer), np.array([END], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [known.text(t) + end for t in batch.column(1).to_pylist()]
            sizes = np.array([len(x) // WIDTH for x in ids], np.int64)
            before = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(sizes), pa.array(np.full(len(ids), part, np.int32)), pa.array(before)], ["_id", "ids", "n", "part", "at"])

    rows = docs.select(F.col(id_col).alias("_id"), whole(F.col(text_col)).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, ids binary, n long, part int, at long").withColumnRenamed("_id", id_col)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: id column, ``start``, ``length``, ``ids``, ``doc_tokens``, ``sequence_id``, ``offset``.

    The tasks of the first pass write the ids with their place in the task; the tasks' totals, one row per task, are
    summed up in order; so every token has a place on one line without a sort of the documents. Windows of ``length``
    tokens are the sequences: all are full but the last. A piece is the part of a document in one window (``start`` in
    the document, ``offset`` in the sequence). The line is written to the shared folder, so a task that runs again
    cuts the same pieces.

    Null and empty texts are the end id alone. Repeated rows and ids are packed as often as they come; an empty table
    gives no row; columns other than the id and the text are not read. A text of any length is one row and its pieces
    are made in time linear in it.
    """
    line = materialize(encode(docs, tokenizer, id_col, text_col), "line")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = line.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("total"))  # one row per task of the first pass: small against the texts a task reads, so broadcast
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = line.join(F.broadcast(bases), "part").withColumn("first", F.col("base") + F.col("at"))
    end = F.col("first") + F.col("n")

    def piece(w):
        a, b = F.greatest(w * length, F.col("first")), F.least((w + 1) * length, end)
        start = a - F.col("first")
        return F.struct(start.alias("start"), (b - a).alias("length"), w.alias("sequence_id"), (a - w * length).alias("offset"),
                        F.substring("ids", (start * WIDTH + 1).cast("int"), ((b - a) * WIDTH).cast("int")).alias("ids"))

    windows = F.sequence(F.floor(F.col("first") / length), F.floor((end - 1) / length))
    cut = placed.select(id_col, F.col("n").alias("doc_tokens"), F.explode(F.transform(windows, piece)).alias("p"))
    return cut.select(id_col, "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = END, id_col: str = "doc_id") -> DataFrame:
    """Sequences put together: ``sequence_id``, ``ids`` (bytes), ``n`` (tokens before padding) and ``boundaries``.

    A boundary record names the document, where its piece starts in it, its offset and its length. A sequence that is
    not full is padded to ``length``, unless its number of tokens is a power of two. A group holds ``length`` tokens
    at most.
    """
    rows = F.sort_array(F.collect_list(F.struct("offset", "length", "start", id_col, "ids")))
    put = pieces.groupBy("sequence_id").agg(rows.alias("rows"), F.sum("length").alias("n"))
    joined = F.reduce("rows", F.lit(b""), lambda a, r: F.concat(a, r["ids"]))
    padded = F.rpad(joined, length * WIDTH, F.lit(np.array([pad], "<u4").tobytes()))
    return put.select("sequence_id", "n", F.when(F.bit_count("n") == 1, joined).otherwise(padded).alias("ids"),
                      F.transform("rows", lambda r: F.struct(r[id_col].alias(id_col), r["start"].alias("start"), r["offset"].alias("offset"), r["length"].alias("length"))).alias("boundaries"))
