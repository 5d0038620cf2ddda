"""Several Key=Value items packed in one string, to one row per item."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that stand between items, besides white space.
DELIMITERS = "|;,/¦｜"
_D = re.escape(DELIMITERS) + r"\s"
_KEY = re.compile(r"[^\W\d_]+(?:\[[^\[\]\"=]*\])?\s*=")
#: A quoted stretch (doubled quotes inside), a run of delimiters, other text, or a quote that never ends.
_TOKEN = re.compile(rf'"(?:[^"]|"")*+"|[{_D}]++|[^"{_D}]++|"')
_ESCAPED = re.compile(r"\\.", re.DOTALL)
#: A backslash, or a bracket that is not just a key's layer.
_RARE = re.compile(r"[\\({]|\[(?![^\[\](){}\"|;,/¦｜=\s]*\])")
#: What a backslash takes its meaning from; before anything else it is a letter.
_SPECIAL = re.compile(rf'\\([\\"=()\[\]{{}}{re.escape(DELIMITERS)}])')
_OPEN, _CLOSE = "([{", ")]}"
_ENDS = DELIMITERS + " \t\r\n\u00a0\u3000"
#: A letter that stands for hidden characters.
_X = "x"


def masked(s: str) -> str:
    """The string, as long as it was, with letters for escaped characters and for delimiters, quotes and signs in brackets.

    Brackets within quotes and brackets without a partner are letters themselves.
    """
    if not _RARE.search(s):
        return s
    s = _ESCAPED.sub(_X * 2, s)
    open_: list[tuple[str, int]] = []
    within = [0] * (len(s) + 1)  # brackets that open less those that close, at each place
    for m in _TOKEN.finditer(s):
        if m.group()[0] == '"' and len(m.group()) > 1:
            continue
        for i in range(m.start(), m.end()):
            c = s[i]
            if c in _OPEN:
                open_.append((c, i))
            elif c in _CLOSE and open_ and open_[-1][0] == _OPEN[_CLOSE.index(c)]:
                within[open_.pop()[1] + 1] += 1
                within[i] -= 1
    deep = accumulate(within)
    return "".join([_X if n and (c in DELIMITERS or c in '"=' or c.isspace()) else c for c, n in zip(s, deep)])


def items(s: str | None) -> list[str]:
    """The items of a packed field, in order, each as ``Key=Value``.

    A tokenizer with three states walks the string: between items (after a delimiter or at
    the start), in an item, and in quotes. An item starts where a key and ``=`` stand between
    items, by themselves or in quotes. Quoted stretches, brackets with all they nest, and characters behind a
    backslash are taken whole. Text without a key of
    its own belongs to the item before it, delimiters included; before the first item it is
    dropped. Null, ``_`` and a string without items give none.
    """
    if not s or "=" not in s:
        return []
    t = masked(s)
    starts: list[int] = []
    between, value_due = True, False
    for m in _TOKEN.finditer(t):
        at, c = m.start(), m.group()
        if c[0] in DELIMITERS or c[0].isspace():
            between = True
            value_due = value_due and c.isspace()  # blanks after "Key =" do not end the item
            continue
        if between and not value_due and _KEY.match(t, at + (c[0] == '"')):
            starts.append(at)
        between = c[0] == '"' and len(c) > 1 and not value_due and bool(starts) and starts[-1] == at
        if c[0] == '"':
            value_due = False
        elif starts:
            # the value is due while only the key and its sign have been seen
            value_due = "=" not in t[starts[-1] : at].rstrip() and c.endswith("=") or (value_due and c == "=")
            if not value_due and starts[-1] == at and "=" not in c:
                value_due = True  # the key stands apart from its sign
    return [_item(s[a:b], t[a:b]) for a, b in zip(starts, [*starts[1:], len(s)])]


def pieces(s: str | None) -> list[str]:
    """All pieces between delimiters, in order, with or without a key; quotes, brackets and backslashes as for ``items``. Empty pieces count for nothing."""
    out, start = [], 0
    t = masked(s or "")
    for m in _TOKEN.finditer(t):
        if m.group()[0] != '"' and any(c in DELIMITERS for c in m.group()):
            out.append((start, m.start()))
            start = m.end()
    found = [_unquote(*_strip(s[a:b], t[a:b])) for a, b in [*out, (start, len(t))]] if s else []
    return [x for x in (_plain(f[0]) for f in found) if x]


def _strip(s: str, t: str, ends: str = _ENDS) -> tuple[str, str]:
    a, b = len(t) - len(t.lstrip(ends)), len(t.rstrip(ends))
    return s[a:b], t[a:b]


def _plain(s: str) -> str:
    return _SPECIAL.sub(r"\1", s) if "\\" in s else s


def _item(s: str, t: str) -> str:
    """An item without what encloses it, from its text and that text masked."""
    s, t = _unquote(*_strip(s, t))
    at = t.find("=")
    at = s.find("=") if at < 0 else at
    value, _ = _unquote(*_strip(s[at + 1 :], t[at + 1 :], None))
    return _plain(f"{s[:at].strip()}={value}")


def _unquote(s: str, t: str) -> tuple[str, str]:
    m = _TOKEN.match(t)
    if m and len(t) > 1 and t[0] == '"' and m.end() == len(t) and t[-1] == '"':
        twice = [i for i in range(1, len(t) - 1) if not (t[i] == '"' and _pair(t, i))]
        return "".join(s[i] for i in twice), "".join(t[i] for i in twice)
    return s, t


def _pair(t: str, i: int) -> bool:
    """Whether the quote at i is the second of a doubled one; quotes inside a quoted stretch come in pairs."""
    a = i
    while a > 1 and t[a - 1] == '"':
        a -= 1
    return (i - a) % 2 == 1


def explode_items(df: DataFrame, key: str, fields: list[str], *, at_least: int = 1, keyed: bool = True) -> DataFrame:
    """(key, field, pos, val): one row per item of each named string column; pos from 1.

    Items are ``Key=Value``; with ``keyed`` false, all pieces between delimiters. ``at_least`` keeps only fields with so many items. Null, empty and item-free fields give
    no rows, repeated rows are kept apart by ``key`` only; other columns are not read. Strings
    that cannot hold enough items (each needs an ``=``) are left out before Python sees them.
    """
    long = df.select(F.col(key).alias("key"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("s")) for f in fields))).alias("x")).select("key", "x.field", "x.s")
    signs = F.length("s") - F.length(F.translate("s", "=", ""))
    long = long.where(signs >= at_least if keyed else F.length("s") > 0)
    split = items if keyed else pieces
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for b in batches:
            rows: list[int] = []
            pos: list[int] = []
            vals: list[str] = []
            for i, s in enumerate(b.column("s").to_pylist()):
                got = known.get(s)
                if got is None:
                    if len(known) > 100_000:
                        known.clear()
                    got = split(s)
                    if len(s) < 200:
                        known[s] = got
                if len(got) >= at_least:
                    rows.extend([i] * len(got))
                    pos.extend(range(1, len(got) + 1))
                    vals.extend(got)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("key").take(take), b.column("field").take(take), pa.array(pos, pa.int32()), pa.array(vals, pa.string())], [key, "field", "pos", "val"])

    return long.mapInArrow(run, f"`{key}` {kind}, field string, pos int, val string")
