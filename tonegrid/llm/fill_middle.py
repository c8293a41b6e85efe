"""Fill-in-the-middle: cut texts into units and set prefix, middle and suffix in another order between marks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrid.llm.common import unused, whole

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
FORMS = ("plain", "psm", "spm")
BREAK = "\n"


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lines of all texts, each with its break, the number of lines of every text, and the text every line is of."""
    lists = pc.split_pattern(texts, BREAK)
    flat, parents, sizes = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(), pc.list_value_length(lists).to_numpy()
    last = np.zeros(len(flat), bool)
    last[np.cumsum(sizes) - 1] = True
    # what follows the last break is a unit only if there is something
    keep = ~last | (pc.binary_length(flat).to_numpy() > 0)
    lines = pc.binary_join_element_wise(flat, pc.if_else(pa.array(last), "", BREAK), "").filter(pa.array(keep))
    parents = parents[keep]
    return lines, np.bincount(parents, minlength=len(texts)), parents


def role(lines: pa.Array, parents: np.ndarray, chosen: np.ndarray, texts: int) -> pa.Array:
    """The chosen lines of every text joined; lines stay in order, so lists are rebuilt from their counts."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(parents[chosen], minlength=texts))])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lines.filter(pa.array(chosen))), "")


def rearranged(texts: pa.Array, draws: list[np.ndarray], rate: int, suffix_first: int) -> list[pa.Array]:
    """Units, form, characters of prefix and middle, and output of every text of a batch."""
    lines, counts, parents = units(texts)
    cuts = np.sort(np.stack([draws[0] % (counts + 1), draws[1] % (counts + 1)]), axis=0)
    ordinals = np.arange(len(lines)) - (np.cumsum(counts) - counts)[parents]
    place = (ordinals >= cuts[0][parents]).astype(int) + (ordinals >= cuts[1][parents])
    prefix, middle, suffix = (role(lines, parents, place == k, len(texts)) for k in range(3))
    marked = np.zeros(len(texts), bool)
    for mark in MARKS:
        marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    plain = marked | (counts == 0) | (draws[2] % 100 >= rate)
    form = np.where(plain, 0, np.where(draws[3] % 100 < suffix_first, 2, 1))
    p, s, m = MARKS
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, "")
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, "")
    output = pc.choose(pa.array(form), texts, psm, spm)
    blank = pa.array(plain)
    sizes = [pc.if_else(blank, None, pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    return [pa.array(counts, pa.int64()), pc.choose(pa.array(form), *FORMS), *sizes, output]


def draws_of(id_col: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the seed and the id; a null id counts as an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def rearrange(docs: DataFrame, seed: int = 7, rate: int = 100, suffix_first: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``, next to its other columns.

    Units are lines with their break. Of 100 documents about ``rate`` are rearranged, of those about ``suffix_first``
    in a hundred with the suffix first; where to cut and what to do follows from the seed and the id alone, so reruns
    and repeated rows agree. Empty and null texts, texts that contain a mark and those not drawn are ``plain``: the
    output is the text (null: empty) and the sizes are null. Cuts at either end, or at one place, give empty parts.
    Rows are independent, nothing is shuffled, and memory follows the Arrow batch, of which one text is the least.
    Result columns replace columns of the same name.
    """
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    spare = [unused(docs, f"_fim{i}") for i in range(5)]
    rows = docs.select(*[c for c in docs.columns if c.lower() not in names], whole(F.col(text_col)).alias(spare[0]),
                       *[d.alias(s) for d, s in zip(draws_of(F.col(id_col), seed), spare[1:], strict=True)])

    def run(batches):
        for batch in batches:
            kept, (texts, *draws) = batch.columns[:-5], batch.columns[-5:]
            out = rearranged(texts.cast(pa.string()), [d.to_numpy() for d in draws], rate, suffix_first)
            yield pa.RecordBatch.from_arrays([*kept, *out], [*batch.schema.names[:-5], *names])

    kept = [f for f in rows.schema.fields if f.name not in spare]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "n long, form string, prefix_chars long, middle_chars long, output string"])
    return rows.mapInArrow(run, schema)


def restore(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of.

    A rearranged text holds no mark, and no mark can begin inside another, so the marks cut its output into the
    three parts.
    """
    parts = F.split(F.col(output), "|".join(MARKS), -1)
    at = lambda *order: F.concat(*[parts[i] for i in order])
    return F.when(F.col(form) == "psm", at(1, 3, 2)).when(F.col(form) == "spm", at(2, 3, 1)).otherwise(F.col(output))


def sql(seed: int = 7, rate: int = 100, suffix_first: int = 50) -> str:
    """The digests of the query in SQL: lines by list functions."""
    p, s, m = MARKS
    return f"""
with h as (select doc_id, coalesce(text, '') as text, sha256('{seed}:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
 d as (select doc_id, text, string_split(text, chr(10)) as u, {', '.join(f"cast('0x' || substr(h, {8 * i + 1}, 8) as bigint) as h{i + 1}" for i in range(4))} from h),
 n as (select *, len(u) - cast(u[len(u)] = '' as int) as n from d),
 l as (select *, list_transform(range(1, n + 1), lambda i: u[i] || case when i < len(u) then chr(10) else '' end) as l,
  least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when text = '' or contains(text, '{p}') or contains(text, '{s}') or contains(text, '{m}') or h3 % 100 >= {rate} then 'plain' when h4 % 100 < {suffix_first} then 'spm' else 'psm' end as form from n),
 t as (select *, coalesce(array_to_string(l[1:a], ''), '') as p, coalesce(array_to_string(l[a + 1:b], ''), '') as m, coalesce(array_to_string(l[b + 1:n], ''), '') as s from l)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
 sha256(case form when 'plain' then text when 'psm' then '{p}' || p || '{s}' || s || '{m}' || m else '{s}' || s || '{p}' || p || '{m}' || m end) as output_sha256,
 sha256(text) as restored_sha256 from t
"""
