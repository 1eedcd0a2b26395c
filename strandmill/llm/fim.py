"""Fill-in-the-middle rearrangement of documents, in DuckDB inside Arrow batches.

A text is cut at two places into prefix, middle and suffix, which a hash of the document's id chooses, and
laid out with sentinels as prefix, suffix, middle (psm) or suffix, prefix, middle (spm); some documents stay plain. A task
holds one DuckDB connection; each stretch of an Arrow batch is registered with it as a table, and one SQL statement
cuts, lays out, rebuilds and hashes all its rows and hands Arrow back. No row passes through Python.

Texts are matched left to right in blocks of UNITS code points (``regexp_extract_all``), so a text of n code points
is a list of n / UNITS strings; only the two blocks that hold a cut are matched code point by code point. Stretches end at
STRETCH characters, so a task's memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Fixed values of the contract: sentinels, the seed of the hash, per cent of documents that change, and of those per cent of spm.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = "1:", 90, 20
#: Code points of a block; characters of a stretch of rows that are registered at once; DuckDB's memory in a task.
UNITS, STRETCH, MEMORY = 64, 4 << 20, "700MB"

TEXTS = "output string, restored string, "
SCHEMA = "doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, {texts}output_sha256 string, restored_sha256 string"


def _cut(blocks: str, at: str) -> str:
    """SQL for the first ``at`` code points of a list of blocks."""
    rest = f"list_slice(regexp_extract_all(coalesce({blocks}[{at} // {UNITS} + 1], ''), '(?s).'), 1, {at} % {UNITS})"
    return f"array_to_string(list_slice({blocks}, 1, {at} // {UNITS}), '') || coalesce(array_to_string({rest}, ''), '')"


def statement(texts: bool) -> str:
    """The SQL over a registered table ``batch(doc_id, text)``; ``texts`` keeps the laid out and the rebuilt text."""
    number = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::bigint"
    has = " or ".join(f"contains(text, '{s}')" for s in (PREFIX, SUFFIX, MIDDLE))
    return f"""
    with rows as (select doc_id, coalesce(text, '') as text, sha256('{SEED}' || coalesce(doc_id::varchar, '')) as h from batch),
    blocks as (select *, regexp_extract_all(text, '(?s).{{1,{UNITS}}}') as b from rows),
    sized as (select *, case when text = '' then 0 else {UNITS} * (len(b) - 1) + length(b[-1]) end::bigint as n from blocks),
    cuts as (select *, {number(0)} % (n + 1) as c1, {number(1)} % (n + 1) as c2,
             case when text = '' or {has} or {number(2)} % 100 >= {RATE} then 'plain' when {number(3)} % 100 < {SPM} then 'spm' else 'psm' end as form from sized),
    ordered as (select *, least(c1, c2) as a, greatest(c1, c2) as z from cuts),
    heads as (select *, case when form <> 'plain' then {_cut("b", "a")} end as prefix, case when form <> 'plain' then {_cut("b", "z")} end as upto from ordered),
    parts as (select *, substr(upto, a + 1) as middle, substr(text, z + 1) as suffix from heads),
    laid as (select *, case form when 'psm' then '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
             when 'spm' then '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle else text end as output from parts),
    back as (select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then z - a end as middle_chars, output, {restored("output", "form")} as restored from laid)
    select doc_id, n, form, prefix_chars, middle_chars, {"output, restored, " if texts else ""}sha256(output) as output_sha256, sha256(restored) as restored_sha256 from back
    """


def restored(output: str, form: str) -> str:
    """SQL for the text that ``output`` was made from. A changed text holds each sentinel once: none lies in the text, and none can
    arise where parts meet, as sentinels begin with ``<`` and end with ``>`` and hold neither inside."""
    part = lambda text, mark, k: f"split_part({text}, '{mark}', {k})"
    psm_rest, spm_rest = part(output, SUFFIX, 2), part(part(output, SUFFIX, 2), PREFIX, 2)
    psm = f"{part(part(output, SUFFIX, 1), PREFIX, 2)} || {part(psm_rest, MIDDLE, 2)} || {part(psm_rest, MIDDLE, 1)}"
    spm = f"{part(spm_rest, MIDDLE, 1)} || {part(spm_rest, MIDDLE, 2)} || {part(part(output, SUFFIX, 2), PREFIX, 1)}"
    return f"case {form} when 'psm' then {psm} when 'spm' then {spm} else {output} end"


def stretches(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """``batch(doc_id, text)`` in stretches of about ``limit`` bytes of text, a row at least."""
    ends = pc.cumulative_sum(pc.add(pc.coalesce(pc.cast(pc.binary_length(batch.column(1)), pa.int64()), 0), 16)).to_numpy()
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(ends.searchsorted(before + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def fill_in_middle(docs: DataFrame, texts: bool = True) -> DataFrame:
    """Rearrange every row of ``docs(doc_id, text)``: doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars
    (null if plain), output and restored (the laid out text, and the text rebuilt from it and the form alone; left out without
    ``texts``), and the lower-case hex SHA-256 of both.

    Null text counts as empty and is plain; a null id counts as an empty one in the hash, and stays null. Equal ids
    are cut by the same hash, so repeated rows have equal results. A text that holds a sentinel stays plain. Texts may be of any length: a task
    needs some times the longest one. Other columns are ignored; an empty table gives an empty result.
    """
    sql = statement(texts)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        try:
            for batch in batches:
                for part in stretches(batch, STRETCH):
                    con.register("batch", pa.Table.from_batches([part]))
                    yield from con.execute(sql).to_arrow_table().to_batches()
                    con.unregister("batch")
        finally:
            con.close()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA.format(kind=kind, texts=TEXTS if texts else ""))


def oracle() -> str:
    """The same in plain substrings over code points, without blocks, lists or the way back."""
    h = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::bigint"
    return f"""
    with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, ''))::bigint as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
    c as (select *, least({h(0)} % (n + 1), {h(1)} % (n + 1)) as a, greatest({h(0)} % (n + 1), {h(1)} % (n + 1)) as z,
          case when t = '' or t like '%<P>%' or t like '%<S>%' or t like '%<M>%' or {h(2)} % 100 >= 90 then 'plain' when {h(3)} % 100 < 20 then 'spm' else 'psm' end as form from d)
    select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then z - a end as middle_chars,
      sha256(case form when 'plain' then t when 'psm' then concat('<P>', t[:a], '<S>', t[z + 1:], '<M>', t[a + 1:z]) else concat('<S>', t[z + 1:], '<P>', t[:a], '<M>', t[a + 1:z]) end) as output_sha256,
      sha256(t) as restored_sha256 from c
    """
