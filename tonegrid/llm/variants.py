"""Spelling variants: words one edit apart, found in bit-sliced position indexes of the vocabulary."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrid.llm.common import whole
from tonegrid.session import materialize

#: Letters of a word.
LETTERS = "A-Za-zÀ-ÿ"
#: Shortest word in code points, fewest occurrences, and how often more frequent a form has to be.
LEAST, RARE, FACTOR = 7, 2, 10
#: Words of an index on average; a bucket of more than ``HOT`` is cut into a grid of indexes and askers.
BLOCK, HOT = 1024, 4096
#: Lengths from here on share one count of buckets.
LONG = 64


def vocabulary(docs: DataFrame, least: int = LEAST, rare: int = RARE, delete_every: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of at least ``least`` letters that occur ``rare`` times or more, lower-cased in A-Z: ``word`` and ``n``.

    With ``delete_every``, a word whose crc32 with the document's id it divides loses the letter at that crc32 modulo
    its length: misspellings made on purpose, the same in every run. Null texts have no words; a null id counts as an
    empty text. Counting is one aggregate that combines before the shuffle.
    """
    # a shorter run can neither be long enough nor become so
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(whole(F.col(text_col)), F.lit(f"([{LETTERS}]{{{least},}})"), 1)).alias("run"))
    low = runs.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    if delete_every:
        hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        low = hashed.select(F.when(F.col("h") % delete_every == 0, cut).otherwise(F.col("run")).alias("run"))
    words = low.where(F.length("run") >= least).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return words.where(F.col("n") >= rare)


def _columns(words: list[str], width: int, letters: np.ndarray) -> np.ndarray:
    """Letter numbers per position and word; positions behind a word's end have the number after the last letter."""
    out = np.full((width, len(words)), len(letters), np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        points = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), "<u4").reshape(len(at), size)
        out[:size, at] = np.searchsorted(letters, points).T
    return out


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as bitsets of 64-bit words."""
    packed = np.packbits(flags, axis=-1, bitorder="little")
    spare = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, spare)])).view(np.uint64)


def _slice(column: np.ndarray, letters: int) -> np.ndarray:
    """Position slice: per letter the set of words with it at this position; none for the number behind the letters."""
    bits = _bits(column[None, :] == np.arange(letters + 1)[:, None])
    bits[letters] = 0
    return bits


def near_sets(index: list[str], asking: list[str], size: int, front: bool) -> np.ndarray:
    """Per asking word the bitset of index words exactly one edit away; all words have ``size`` or one more letters.

    Read left to right, ``zero`` is the set of index words that agree so far, and three sets hold those with one error
    behind them: a replaced letter (same positions), a letter more in the index word (next position) and one less (the
    position before). Two words that are both longer than ``size`` belong to the next size and are left out. Words one
    edit apart agree in the first or in the last ``size // 2`` letters: ``front`` keeps those that agree in the first, otherwise
    those that do not, so that no pair is found twice.
    """
    letters = np.unique(np.frombuffer("".join(index + asking).encode("utf-32-le"), "<u4"))
    have, ask = _columns(index, size + 2, letters), _columns(asking, size + 1, letters)
    longer = np.fromiter((len(w) > size for w in index), bool, len(index))
    is_long, is_short = _bits(longer), _bits(~longer)
    none = np.zeros((len(letters) + 1, len(is_long)), np.uint64)
    zero = np.broadcast_to(_bits(np.ones(len(index), bool)), (len(asking), len(is_long))).copy()
    replaced, more, less = (np.zeros_like(zero) for _ in range(3))
    before, here, after = none, _slice(have[0], len(letters)), _slice(have[1], len(letters))
    short = np.fromiter((len(w) == size for w in asking), bool, len(asking))
    agree = zero
    for i in range(size):
        if i == size // 2:
            agree = zero.copy()
        same = here[ask[i]]
        less = (less & before[ask[i]]) | zero
        more = (more | zero) & after[ask[i]]
        replaced = (replaced & same) | zero
        zero &= same
        before, here, after = here, after, _slice(have[i + 2], len(letters)) if i + 2 < len(have) else none
    # short askers are at their end; long ones have one letter left, which a shorter index word lacks
    found = np.where(short[:, None], (replaced & ~zero & is_short) | ((more | zero) & is_long), ((less & before[ask[size]]) | zero) & is_short)
    return found & (agree if front else ~agree)


def _best(sets: np.ndarray) -> np.ndarray:
    """Number of the first member of every set (none may be empty)."""
    at = (sets != 0).argmax(1)
    word = sets[np.arange(len(sets)), at]
    return at * 64 + np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1))


def _search(group: pa.Table) -> pa.Table:
    """Near words of one bucket (or cell of a hot one): number and first by (most frequent, smallest) per asking word."""
    size, front = group["size"][0].as_py(), group["front"][0].as_py()
    rows = group.select(["word", "n", "indexed", "asks"]).to_pydict()
    index = sorted(((-n, w) for w, n, x in zip(rows["word"], rows["n"], rows["indexed"], strict=True) if x))
    asking = [w for w, x in zip(rows["word"], rows["asks"], strict=True) if x]
    out: dict[str, list] = {"word": [], "near": [], "best_n": [], "best": []}
    for start in range(0, len(asking) if index else 0, BLOCK):
        part = asking[start : start + BLOCK]
        sets = near_sets([w for _, w in index], part, size, front)
        counts = np.bitwise_count(sets).sum(1)
        hit = np.flatnonzero(counts)
        if len(hit):
            best = _best(sets[hit])
            out["word"] += [part[i] for i in hit]
            out["near"] += counts[hit].tolist()
            out["best_n"] += [-index[i][0] for i in best]
            out["best"] += [index[i][1] for i in best]
    return pa.table(out, pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())]))


def buckets(words: DataFrame, least: int = LEAST) -> DataFrame:
    """Every word in the buckets where its near words are: by the shorter length of a pair, and by the first or last half of its letters.

    The driver holds one count per length up to ``LONG``. A bucket of more than ``HOT`` words is cut by hash into s parts
    and becomes s x s cells, in which one part is the index and one asks; a cell is then as small as any bucket.
    """
    size = F.length("word")
    counts = {r["size"]: r["n"] for r in words.groupBy(F.least(size, F.lit(LONG)).alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    dealt = {k: max(1, -(-(counts.get(k, 0) + counts.get(min(k + 1, LONG), 0)) // BLOCK)) for k in range(min(least, LONG), LONG + 1)}
    number = F.element_at(F.create_map(*[F.lit(x) for pair in dealt.items() for x in pair]), F.least(F.col("size"), F.lit(LONG)))
    sides = words.select("word", "n", F.explode(F.filter(F.array(size, size - 1), lambda s: s >= least)).alias("size")).withColumn("front", F.explode(F.array(F.lit(True), F.lit(False))))
    half = F.floor(F.col("size") / 2).cast("int")
    key = F.when(F.col("front"), F.substring("word", F.lit(1), half)).otherwise(F.substring("word", size - half + 1, half))
    keyed = sides.withColumn("bucket", F.pmod(F.xxhash64(key), number))
    many = keyed.groupBy("size", "front", "bucket").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT)
    cut = keyed.join(many, ["size", "front", "bucket"], "left").withColumn("s", F.coalesce(F.ceil(F.col("k") / BLOCK), F.lit(1)).cast("int"))
    mine = F.pmod(F.xxhash64("word"), F.col("s")).cast("int")
    all_parts = F.sequence(F.lit(0), F.col("s") - 1)
    row = lambda i: F.struct(mine.alias("index"), i.alias("asker"), F.lit(True).alias("indexed"), (i == mine).alias("asks"))
    column = lambda i: F.struct(i.alias("index"), mine.alias("asker"), F.lit(False).alias("indexed"), F.lit(True).alias("asks"))
    cells = F.concat(F.transform(all_parts, row), F.transform(F.filter(all_parts, lambda i: i != mine), column))
    return cut.select("word", "n", "size", "front", "bucket", F.explode(cells).alias("c")).select("word", "n", "size", "front", "bucket", "c.*")


def near_words(words: DataFrame, least: int = LEAST) -> DataFrame:
    """``word``, ``n_near`` and ``best`` (struct of ``best_n`` and ``best``) of every word that has a near one."""
    found = buckets(words, least).groupBy("size", "front", "bucket", "index", "asker").applyInArrow(_search, "word string, near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("first")).select("word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.word").alias("best"))


def _roots(forms: DataFrame, factor: int) -> DataFrame:
    """Last form of every word that has one: pointers doubled until the longest possible chain is covered."""
    top, hops = forms.agg(F.max("form_n").alias("m")).head()["m"] or 0, 0
    while factor > 1 and RARE * factor ** (hops + 1) <= top:  # every hop multiplies the count
        hops += 1
    to, reach = forms.select("word", F.col("form").alias("root")), 1
    while reach < hops:
        ahead = to.select(F.col("word").alias("root"), F.col("root").alias("then"))
        to = materialize(to.join(ahead, "root", "left").select("word", F.coalesce("then", "root").alias("root")), "roots")
        reach *= 2
    return to


def group_variants(words: DataFrame, factor: int = FACTOR, least: int = LEAST) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word of a vocabulary (``word``, ``n``; words are distinct).

    Near words differ by exactly one inserted, deleted or replaced code point. The form is the near word of largest n,
    of those the smallest by code points, if that n is at least ``factor`` times the word's own; otherwise null. The root
    follows forms to the last; a word without a form is its own root. Words shorter than ``least`` code points have no
    near words here. An empty vocabulary gives no rows.

    Work: every word is in at most four buckets, a bucket is searched by itself with bit operations on 64 index words at
    once, and only the number and the best near word come back, never pairs.
    """
    words = materialize(words.select("word", "n"), "vocabulary")
    near = near_words(words, least)
    known = words.join(near, "word", "left")
    fits = F.col("best_n") >= factor * F.col("n")
    scored = materialize(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(scored.where(F.col("form").isNotNull()).select("word", "form", "form_n"), factor)
    return scored.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def sql(least: int = LEAST, rare: int = RARE, factor: int = FACTOR, delete_every: int = 31) -> str:
    """Vocabulary and forms in SQL: crc32 byte by byte, near words by what is left when one letter is taken out."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)  # fixed value: the polynomial of crc32
        table.append(c)
    return f"""
with recursive r as (select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(coalesce(text, ''), '[{LETTERS}]{{{least},}}')) as run from documents),
 d as materialized (select id, translate(run, '{string.ascii_uppercase}', '{string.ascii_lowercase}') as w, count(*) as k from r group by all),
 b as (select *, flatten(list_transform(string_split(id || ':' || w, ''), lambda c: case when unicode(c) < 128 then [cast(unicode(c) as bigint)] else [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)] end)) as b from d),
 h as materialized (select w, k, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, ({table})[(xor(a, x) & 255) + 1])), 4294967295) as h from b),
 m as (select case when h % {delete_every} = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, sum(k) as n from h group by 1),
 v as materialized (select word, cast(n as bigint) as n from m where length(word) >= {least} and n >= {rare}),
 o as materialized (select word, n, unnest(range(1, length(word) + 1)) as i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from v),
 p as (select a.word, b.word as other, b.n as m from o a join o b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select o.word, v.word, v.n from o join v on o.rest = v.word union select v.word, o.word, o.n from o join v on o.rest = v.word),
 g as (select word, count(*) as n_near, max(m) as top, arg_min(other, {{'m': -m, 'w': other}}) as best from p group by word),
 f as materialized (select v.word, n, coalesce(n_near, 0) as n_near, case when top >= {factor} * n then best end as form, case when top >= {factor} * n then top end as form_n from v left join g using (word)),
 c as (select word, word as root, 0 as hop from f union all select c.word, f.form, hop + 1 from c join f on f.word = c.root where f.form is not null)
select f.word, form, (select arg_max(root, hop) from c where c.word = f.word) as root, n, n_near, form_n from f
"""
