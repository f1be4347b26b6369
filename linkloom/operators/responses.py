"""From a model's raw text to one typed read per crop, within the row of a scan: no shuffle.

Texts are parsed, and reads laid out, batch by batch in Arrow. Variants and functions over their arrays say the
same, but interpret every field of every item: they took some 120 microseconds an item.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions.text import spine_color


def extract_json_array(c: Column) -> Column:
    """The text from the first ``[`` to the last ``]``, code fences removed; null if there is none."""
    bare = F.regexp_replace(c, "(?i)```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\[.*\]", 0), F.lit(""))


#: What stands for NaN and the infinities: a number, true in the loose sense, whole in none.
NO_NUMBER = "5e-301"
STRING = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")'


def numbers_only(c: Column) -> Column:
    """NaN, Infinity and -Infinity outside strings become ``NO_NUMBER``, which strict parsers take.

    Every string gets the number behind it first, as every such word is replaced by the number and what the
    string group holds, that is, nothing or the string; then strings lose it again.
    """
    both = F.regexp_replace(c, rf"{STRING}|-?\b(?:NaN|Infinity)\b", f"$1{NO_NUMBER}")
    return F.when(c.rlike("NaN|Infinity"), F.regexp_replace(both, rf"{STRING}{NO_NUMBER}", "$1")).otherwise(c)


def parse_items(c: Column) -> Column:
    """The items as ``array<variant>``; null if the text isn't a JSON array and nothing else.

    The parser reads one value and lets the rest be. As the element of an array, the text must be a
    value to its end: of two, or of one with a remark behind it, nothing is read.
    """
    return only_array(wrapped(extract_json_array(c)))


def wrapped(text: Column) -> Column:
    """A text as the element of an array; null if that is no JSON."""
    return F.try_parse_json(F.concat(F.lit("["), numbers_only(text), F.lit("]"))).try_cast("array<variant>")


def only_array(elements: Column) -> Column:
    """The items of the only element, if it is one and an array."""
    return F.when(F.size(elements) == 1, F.get(elements, F.lit(0)).try_cast("array<variant>"))


class Real(str):
    """A number with a point or an exponent, as it stands in the text."""

    def __bool__(self) -> bool:
        return float(self) != 0


#: NaN and the infinities: true values that are no text and no number.
NOT_A_NUMBER = object()
SCAN = json.JSONDecoder(parse_float=Real, parse_constant=lambda _: NOT_A_NUMBER).scan_once
FENCE = re.compile("```(?:json)?", re.IGNORECASE | re.ASCII)


def parsed(text: str | None) -> list | None:
    """The items of a text, as ``parse_items`` finds them; of repeated keys the last counts."""
    if text is None:
        return None
    if "```" in text:
        text = FENCE.sub("", text)
    first, last = text.find("["), text.rfind("]")
    if not 0 <= first < last:
        return None
    try:
        items, end = SCAN(text, first)
    except (StopIteration, ValueError, RecursionError):
        return None
    return items if end == last + 1 else None


def chosen(raw: str | None, call_failed: bool | None, repair: str | None, repair_failed: bool | None) -> tuple[str, list]:
    """The outcome of a scan (parsed, failed or unreadable) and its items.

    A call that failed isn't repaired; a text that doesn't parse is replaced by its repair.
    """
    if call_failed:
        return "failed", []
    items = parsed(raw)
    if items is None:
        if repair_failed:
            return "failed", []
        items = parsed(repair)
    return ("unreadable", []) if items is None else ("parsed", items)


def string(value) -> str | None:
    """A value as text, numbers and nested values as Spark writes them; null and what is no number is null."""
    if type(value) is str or value is None:
        return value
    return None if value is NOT_A_NUMBER else json_text(value)


def json_text(value) -> str:
    if value is None or value is NOT_A_NUMBER:
        return "null" if value is None else "NaN"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return f"[{','.join(map(json_text, value))}]"
    if isinstance(value, dict):
        return f"{{{','.join(f'{json_text(k)}:{json_text(value[k])}' for k in sorted(value))}}}"
    return json.dumps(value, ensure_ascii=False) if type(value) is str else number(str(value))


def number(text: str) -> str:
    """Up to 38 digits in full, without zeros at the end; else the nearest double, as Java writes it."""
    whole, _, part = text.lstrip("-").partition(".")
    if (whole + part).isdigit() and len((whole + part).lstrip("0")) <= 38 and len(part) <= 38:
        plain = text.rstrip("0").rstrip(".") if part else text
        return "0" if plain == "-0" else plain
    x = float(text)
    if x in (float("inf"), -float("inf")):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        return f"{x:.17f}".rstrip("0") if "e" in repr(x) else repr(x)
    digits, _, exponent = min((f"{x:.{n}e}" for n in range(17)), key=lambda t: (float(t) != x, len(t))).partition("e")
    return f"{digits if '.' in digits else digits + '.0'}E{int(exponent)}"


def slots(n_crops: int, outcome: str, items: list) -> Iterator[tuple]:
    """slot, title, author, colour, not_a_book, readable and status of each crop, in order.

    A repeat is a read that points to another crop which isn't a repeat itself, so chains stay apart.
    """
    # A whole number or a boolean names the crop (as a key, a boolean is 1 or 0); the last item for it counts.
    at = {}
    for item in items:
        if type(item) is dict and type(index := item.get("index")) in (int, bool):
            at[index] = item
    parsed, repeats = outcome == "parsed", set()
    without = "unreadable" if parsed else outcome
    for slot in range(1, n_crops + 1):
        item = at.get(slot)
        if item is None:
            yield slot, None, None, None, False, False, without
            continue
        get = item.get
        said, color, to = get("title"), get("spine_color"), get("duplicate_of")
        title = string(said)
        readable = bool(get("readable", True)) and bool(said) and title is not None
        not_a_book = bool(get("not_a_book"))
        repeat = readable and type(to) is int and 1 <= to <= n_crops and to != slot and to not in repeats
        if repeat:
            repeats.add(slot)
        status = "duplicate" if repeat else "ok" if readable else "not_a_book" if not_a_book else "unreadable"
        yield slot, title if readable else None, string(get("author")), spine_color(color), not_a_book, readable and not repeat, status


def titled(items: list) -> Iterator[tuple]:
    """slot, title, author and colour of the items with a title, in order."""
    slot = 0
    for item in items:
        if type(item) is dict and (title := item.get("title")):
            slot += 1
            yield slot, string(title), string(item.get("author")), string(item.get("spine_color"))


#: Rows that a task holds before it hands them on, give or take one scan's; and texts that are strings of Python at a time.
ROWS, TEXTS = 10_000, 1_000


def in_python(values: pa.Array) -> list:
    """Values of an Arrow column by way of numpy, which is faster; but whole numbers with nulls turn into doubles there."""
    if values.null_count and pa.types.is_integer(values.type):
        return values.to_pylist()
    return values.to_numpy(zero_copy_only=False).tolist()


def in_arrow(column: tuple, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(column, kind)
    except UnicodeEncodeError:  # half of a pair of surrogates can't be written
        return pa.array([c if c is None else c.encode("utf-8", "replace").decode() for c in column], kind)


def batches(ids: pa.Array, rows: Iterable[Iterable[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of the rows of each scan, its id before them."""
    of, held = [], []

    def batch() -> pa.RecordBatch:
        columns = [in_arrow(column, f.type) for f, column in zip(list(schema)[1:], zip(*held))]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(of, pa.int64())), *columns], schema=schema)

    for i, some in enumerate(rows):
        n = len(held)
        held.extend(some)
        of.extend([i] * (len(held) - n))
        if len(held) >= ROWS:
            yield batch()
            of, held = [], []
    if held:
        yield batch()


def by_scan(responses: DataFrame, inputs: list[str], outputs: str, rows) -> DataFrame:
    """The ``outputs`` that ``rows`` makes of the ``inputs`` of each scan, behind its id."""
    scan_id = responses.schema["scan_id"].dataType
    fields = T.StructType([T.StructField("scan_id", scan_id), *T.StructType.fromDDL(outputs).fields])
    types = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            schema = pa.schema([("scan_id", part.schema.field("scan_id").type), *[(f.name, types[f.dataType.simpleString()]) for f in fields.fields[1:]]])
            some = (part.slice(i, TEXTS) for i in range(0, part.num_rows, TEXTS))
            texts = (r for s in some for r in zip(*[in_python(s.column(c)) for c in inputs]))
            yield from batches(part.column("scan_id"), (rows(*r) for r in texts), schema)

    return responses.select("scan_id", *inputs).mapInArrow(read, fields)


def align_reads(responses: DataFrame) -> DataFrame:
    """One row per crop of each scan: scan_id, slot, title, author, spine_color, not_a_book, readable, status.

    Responses: scan_id, n_crops, raw_text, call_failed, repair_text, repair_failed. Of items for the
    same crop the last counts; a crop without an item still gets its row.
    """

    def rows(n_crops, *texts):
        return slots(n_crops or 0, *chosen(*texts))

    outputs = "slot int, title string, author string, spine_color string, not_a_book boolean, readable boolean, status string"
    return by_scan(responses, ["n_crops", "raw_text", "call_failed", "repair_text", "repair_failed"], outputs, rows)


def fallback_reads(responses: DataFrame) -> DataFrame:
    """Reads of a whole photo: items with a title, in order, colours as they come; errors give none."""

    def rows(raw, call_failed):
        return titled(parsed(raw) or []) if call_failed is False else ()

    return by_scan(responses, ["raw_text", "call_failed"], "slot int, title string, author string, spine_color string", rows)
