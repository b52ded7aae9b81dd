"""Raw delimited records: valid rows loaded, bad rows kept apart with their reason."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One to nine ASCII digits, optionally followed by '.0'; ZERO is taken out of it.
WHOLE_NUMBER = r"^[0-9]{1,9}(\.0)?$"
ZERO = r"^0+(\.0)?$"


def parse_records(df: DataFrame, key: str, sep: str, text: str, names: Sequence[str], header: str, number: str = WHOLE_NUMBER) -> DataFrame:
    """Parse one raw record a row: (key, <names...>, motivo); motivo is null for the rows loaded.

    ``motivo`` is the first that holds of 'virgolette' (a double quote is neither an outer quote of
    a whole field nor doubled inside a quoted one, or a quoted field does not end), 'colonne' (not
    exactly ``len(names)`` fields by the row's separator) and 'valore' (the first field, trimmed, does
    not match ``number`` or is zero). Bad rows have null fields. Header lines, whose first field, trimmed
    and without quotes, is ``header``, are left out, whatever follows. Line breaks belong to the record they stand in. A null or empty text is
    one empty field, so 'colonne' (with one name: 'valore'); a null or empty separator means a comma.
    Fields that are empty are loaded as '' , quoted or not. Repeated rows are parsed each.

    Per Arrow batch: one regular expression marks broken quoting; the other records go to the
    CSV reader as strings, all columns at once, with its invalid-row callback naming the records of
    another width; then the first column is tested as a vector. No row is parsed in Python.
    """
    names = list(names)
    schema = T.StructType([df.schema[key], *(T.StructField(n, T.StringType()) for n in names), T.StructField("motivo", T.StringType())])
    src = df.select(F.col(key), F.coalesce(F.nullif(F.col(sep), F.lit("")), F.lit(",")).alias("__sep"), F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in pc.unique(batch.column(1)).to_pylist():
                part = batch.filter(pc.equal(batch.column(1), one))
                yield from _parse(part.column(0), part.column(2), one, names, header, number)

    return src.mapInArrow(run, schema)


def _parse(keys: pa.Array, texts: pa.Array, sep: str, names: list[str], header: str, number: str) -> Iterator[pa.RecordBatch]:
    s = re.escape(sep)
    title = pc.match_substring_regex(texts, rf'\A\s*"?\s*{re.escape(header)}\s*"?\s*({s}|\z)')
    keys, texts = keys.filter(pc.invert(title)), texts.filter(pc.invert(title))
    field = rf'("([^"]|"")*"|[^"{s}]*)' if len(sep) == 1 else rf'("([^"]|"")*"|([^"])*?)'
    well = pc.match_substring_regex(texts, rf"(?s)\A{field}({s}{field})*\z")
    yield _bad(keys.filter(pc.invert(well)), names, "virgolette")
    keys, texts = keys.filter(well), texts.filter(well)
    if not len(keys):
        return
    # One record a line: line breaks become characters that the batch does not hold.
    used = set("".join(pc.unique(pc.replace_substring_regex(texts, r"[^\x{E000}-\x{F8FF}]", "")).to_pylist()))
    free = [c for c in map(chr, range(0xE000, 0xF8FF)) if c not in used][:3]
    nl, cr, delim = free
    plain = pc.replace_substring(pc.replace_substring(texts, "\n", nl), "\r", cr)
    if len(sep) > 1:
        plain, sep = _one_char(plain, s, delim), "\x1f"
    rows = pa.array(range(len(keys)))
    lines = pc.binary_join_element_wise(pc.cast(rows, pa.string()), plain, sep)
    body = "\n".join(lines.to_pylist()).encode()
    wide: list[int] = []

    def invalid(row: pcsv.InvalidRow) -> str:
        wide.append(int(row.text.partition(sep)[0].strip('"')))
        return "skip"

    columns = ["__row", *names]
    table = pcsv.read_csv(
        pa.BufferReader(body),
        pcsv.ReadOptions(column_names=columns, use_threads=False, block_size=min(len(body) + 2, 2**31 - 1)),
        pcsv.ParseOptions(delimiter=sep, quote_char='"', double_quote=True, newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=invalid),
        pcsv.ConvertOptions(column_types={c: pa.int64() if c == "__row" else pa.string() for c in columns}, strings_can_be_null=False, quoted_strings_can_be_null=False),
    ).combine_chunks()
    if wide:
        yield _bad(keys.take(pa.array(sorted(wide), pa.int64())), names, "colonne")
    back = [pc.replace_substring(pc.replace_substring(table.column(n), nl, "\n"), cr, "\r") for n in names]
    own = keys.take(table.column("__row").combine_chunks() if table.num_rows else pa.array([], pa.int64()))
    first = pc.utf8_trim_whitespace(back[0])
    keep = _flat(pc.and_not(pc.match_substring_regex(first, number), pc.match_substring_regex(first, ZERO)))
    yield _bad(own.filter(pc.invert(keep)), names, "valore")
    loaded = [_flat(c).filter(keep) for c in back]
    own = own.filter(keep)
    yield pa.RecordBatch.from_arrays([own, *loaded, pa.nulls(len(own), pa.string())], names=["k", *names, "motivo"])


def _flat(c: pa.ChunkedArray | pa.Array) -> pa.Array:
    return pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) and c.num_chunks else pa.array([], c.type) if isinstance(c, pa.ChunkedArray) else c


def _one_char(texts: pa.Array, s: str, _: str) -> pa.Array:
    """Separators of several characters, outside quotes, as one control character."""
    token = re.compile(rf'("(?:[^"]|"")*")|({s})')
    return pa.array([token.sub(lambda m: m[1] or "\x1f", t) for t in texts.to_pylist()], pa.string())


def _bad(keys: pa.Array, names: list[str], why: str) -> pa.RecordBatch:
    n = len(keys)
    return pa.RecordBatch.from_arrays([keys, *(pa.nulls(n, pa.string()) for _ in names), pa.array([why] * n, pa.string())], names=["k", *names, "motivo"])


def split_records(parsed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows loaded, rejects with their reason) of a ``parse_records`` result."""
    return parsed.where("motivo is null").drop("motivo"), parsed.where("motivo is not null").select(key, "motivo")
