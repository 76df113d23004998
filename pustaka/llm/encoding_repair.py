"""Text that was decoded with the wrong character encoding.

Round-trip repair. A run of characters that may have come from UTF-8 bytes read in a legacy encoding is encoded in that
encoding again and decoded strictly as UTF-8. The result stands in for the run if a cost of garbling drops, and the
repair is repeated on it, for layers of garbling. Only whole runs of neighbouring non-ASCII characters are tried, so
that a proper letter between proper quotation marks is left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The legacy encodings that are tried. Bytes that one leaves undefined stand for the control characters of that number.
ENCODINGS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251")


def _table(encoding: str) -> dict[str, int]:
    out = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        out[c] = b
    return out


TABLES = {e: _table(e) for e in ENCODINGS}


#: Two neighbours beyond ASCII and the Indic scripts, or U+FFFD: what no garbled text lacks. Plain ranges, as they are fast.
SUSPECT = r"\x{FFFD}|[^\x00-\x7F\u0900-\u0DFF][^\x00-\x7F\u0900-\u0DFF]"


def _cost_of(c: str) -> float:
    o = ord(c)
    if o < 0x80:
        return 0.0
    if o < 0xA0 or o == 0xFFFD:
        return 4.0
    if 0x0900 <= o <= 0x0DFF:
        return 0.3
    if o in (0xA0, 0xA3, 0xA7, 0xAB, 0xB0, 0xB1, 0xB7, 0xBB) or 0x2010 <= o <= 0x2027 or 0x20A0 <= o <= 0x20BF:
        return 1.0
    return 1.5 if o < 0x180 else 4.0


def cost(text: str) -> float:
    """How garbled a text looks: what it holds beyond ASCII, by kind. A single Greek or Cyrillic letter counts as a stray
    one, several as a word; letters of scripts that are rarer still never make a better reading."""
    foreign = sum(0x370 <= ord(c) < 0x460 for c in text)
    return sum(map(_cost_of, text)) - foreign * (2.8 if foreign > 1 else 1.0)


def _decode(run: str, encoding: str) -> str | None:
    table = TABLES[encoding]
    try:
        return bytes(table[c] for c in run).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None


_RUN = re.compile(r"[^\x00-\x7f]{2,}")
_LEAD = {c for e in ENCODINGS for c, b in TABLES[e].items() if 0xC2 <= b <= 0xF4}


def _repair_run(run: str) -> str:
    """The run restored, or itself. Of a run with proper characters at an end, the part that restores to one of three bytes or more."""
    best, least = run, cost(run)
    for e in ENCODINGS:
        new = _decode(run, e)
        if new is not None and cost(new) < least:
            best, least = new, cost(new)
    if best is run and len(run) > 3:
        for e in ENCODINGS:
            table = TABLES[e]
            raw = bytes(table.get(c, 0x20) for c in run)
            for m in re.finditer(rb"(?:[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})*", raw):
                part = run[m.start() : m.end()]
                new = _decode(part, e)
                if new is not None and cost(run) - cost(part) + cost(new) < least:
                    best = run[: m.start()] + new + run[m.end() :]
                    least = cost(best)
    return best


def repair(text: str) -> tuple[str, int, int]:
    """The restored text, how many layers were taken off, and how many runs were changed in the first of them. Each layer makes a run
    shorter, so the layers end."""
    layers = runs = 0
    known: dict[str, str] = {}

    def one(m: re.Match) -> str:
        run = m.group(0)
        if run not in known:
            known[run] = _repair_run(run) if any(c in _LEAD for c in run) else run
        return known[run]

    while True:
        changed = sum(1 for m in _RUN.finditer(text) if one(m) != m.group(0))
        if not changed:
            return text, layers, runs
        runs = runs or changed
        text, layers = _RUN.sub(one, text), layers + 1


def _worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0), b.column(1).to_pylist()
        done = [repair(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array([x[0] for x in done], pa.string()),
                pa.array([x[1] for x in done], pa.int32()),
                pa.array([x[2] for x in done], pa.int32()),
                pa.array([x[0].count("\ufffd") for x in done], pa.int32()),
            ],
            names=["doc_id", "restored", "layers", "runs", "lost"],
        )


def suspects(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows that may be garbled; the rest need no look outside the JVM."""
    return df.filter(F.col(text).rlike(SUSPECT))


def garbled(df: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, restored, layers, runs, lost): one row for each garbled text, with what could be restored.

    `lost` counts characters of which only U+FFFD is left; a text with such characters alone has layers 0. Null and
    empty texts are not garbled; very long ones are taken whole; an empty table gives an empty result; repeated rows
    give a row each. Only the two named columns are read. One pass, no shuffle.
    """
    rows = suspects(df.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    done = rows.mapInArrow(_worker, "doc_id long, restored string, layers int, runs int, lost int")
    return done.filter("layers > 0 OR lost > 0").withColumnRenamed("doc_id", row_id)


def restored_text(found: Column, text: Column) -> Column:
    """The restored text where there is one, else the text as it was."""
    return F.coalesce(found, text)
