"""One consistent form for text that looks alike.

A transducer reads a string as longest matches: words (letters with their marks and whatever
invisible stands between them) and single clusters of a base and its marks. Each match goes
through mappings that are built once from Unicode's own data and the table of twins, and checked for conflicts: every
source has one target, and no target holds a source of either mapping, so one pass is enough. Widths, spaces and invisible
characters are mapped anywhere; twins only in a word all of whose letters are then Latin.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts with the Latin letter of the same look, by script.
TWINS = {
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺϜͿ", "ABEZHIKMNOPTYXCMFJ", strict=True)),
    **dict(zip("ανοριυϲϳ", "avopiucj", strict=True)),
    **dict(zip("АВЕЅІЈКМНОРСТХУԌԚԜӀҮѴӔ", "ABESIJKMHOPCTXYGQWIYVÆ", strict=True)),
    **dict(zip("аеѕіјорсухһԁԛԝӏүѵӕ", "aesijopcyxhdqwlyvæ", strict=True)),
    **dict(zip("ՕՍՏԼօսհոցզ", "OUSLouhngq", strict=True)),
    **dict(zip("ᎪᏴᏟᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCEGHJKLMPRSTVWZ", strict=True)),
}
# Latin letters that are only another drawing of a plain one.
DRAWN = {"ɡ": "g", "ɑ": "a"}
# Format characters that are seen, which are kept.
SEEN = frozenset(map(chr, [*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD]))
# Characters without a look whose category does not say so.
UNSEEN = frozenset(map(chr, [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]))
# Single characters that are two letters drawn as one.
JOINED = frozenset("ĲĳŉǄǅǆǇǈǉǊǋǌǱǲǳ" + "".join(map(chr, [*range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18)])))

def is_invisible(c: str) -> bool:
    kind = unicodedata.category(c)
    return c in UNSEEN or kind == "Cf" and c not in SEEN or kind == "Cc" and not c.isspace()


@lru_cache(1)
def mapping() -> dict[str, str]:
    """Source character to target, for all characters whose target differs."""
    out: dict[str, str] = dict(DRAWN)
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000 or 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4 or 0x20000 <= cp < 0xE0000 or cp >= 0xF0000:
            continue
        c = chr(cp)
        if is_invisible(c):
            target = ""
        elif c.isspace():
            target = " "
        else:
            tag, _, rest = unicodedata.decomposition(c).partition(" ")
            if tag in ("<wide>", "<narrow>", "<font>") or c in JOINED:
                target = "".join(chr(int(x, 16)) for x in rest.split())
                target = "".join(out.get(x, x) for x in target)
                if c in JOINED:
                    target = unicodedata.normalize("NFC", unicodedata.normalize("NFKD", c))
            else:
                continue
        if target != c:
            if out.setdefault(c, target) != target:
                raise ValueError(f"two targets for {c!r}")
    _check(out, out)
    return out


def _check(new: dict[str, str], *known: dict[str, str]) -> None:
    """No target may hold a source, so one pass is enough."""
    for source, target in new.items():
        if any(x in k for k in (new, *known) for x in target):
            raise ValueError(f"the target of {source!r} holds a source")


@lru_cache(1)
def twins() -> dict[str, str]:
    """Letter of another script to the Latin cluster of the same look: ``TWINS``, and all letters that are one of these with accents."""
    out = dict(TWINS)
    for cp in range(0x370, 0x2000):
        c = chr(cp)
        base, *marks = unicodedata.normalize("NFD", c)
        if base in TWINS and marks and all(unicodedata.combining(x) for x in marks):
            out[c] = unicodedata.normalize("NFC", TWINS[base] + "".join(marks))
    if out.keys() & mapping().keys():
        raise ValueError("two targets for a letter")
    _check(out, mapping())
    return out


@lru_cache(1)
def plain_pattern() -> str:
    """What Spark itself can see to be consistent: letters, digits and signs below U+2000 that are no source, no mark and of no other script."""
    fits = regex.compile(r"[\p{Latin}\p{Common}]")
    # plain ASCII is one range of its own, which is asked first: of many ranges in one class each letter would go through all
    good = [cp for cp in range(0x7F, 0x2000) if fits.match(c := chr(cp)) and c not in mapping() and c not in twins() and not unicodedata.category(c).startswith(("M", "C")) and unicodedata.normalize("NFC", c) == c]
    ranges: list[list[int]] = []
    for cp in good:
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return "^(?:[ -~]++|[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "])*+$"


@lru_cache(1)
def _compiled() -> regex.Pattern:
    hidden = "".join(regex.escape(c) for c, t in mapping().items() if t == "")
    tail = rf"[\p{{M}}{hidden}]*+"
    return regex.compile(rf"(?:\p{{L}}{tail})++|[^\p{{L}}]{tail}")


_OTHER = regex.compile(r"[\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}]")
_FITS = regex.compile(r"[\p{Latin}\p{M}\p{Common}]*+")


def _step(match: str) -> str:
    m = mapping()
    t = "".join([m.get(c, c) for c in match])
    if _OTHER.search(t):
        twin = twins()
        read = "".join([twin.get(c, c) for c in t])
        if _FITS.fullmatch(read):
            t = read
    return unicodedata.normalize("NFC", t)


class Transducer:
    """Brings strings to the consistent form; keeps the words it has seen, at most ``keep`` of them."""

    def __init__(self, keep: int = 200_000):
        self.keep = keep
        self.known: dict[str, str] = {}

    def __call__(self, s: str) -> str:
        if s.isascii() and s.isprintable():
            return s
        known = self.known

        def step(m: regex.Match) -> str:
            t = m.group()
            got = known.get(t)
            if got is None:
                got = _step(t)
                if len(t) < 100:
                    if len(known) >= self.keep:
                        known.clear()
                    known[t] = got
            return got

        out = _compiled().sub(step, s)
        # a mark may stand first in a match, after a space or an empty target
        return out if unicodedata.is_normalized("NFC", out) else unicodedata.normalize("NFC", out)


def inconsistent(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, rec_id, clean): each string of the named columns that is not in the consistent form.

    Null and empty strings are consistent. Repeated rows each give a row. A string of invisible
    characters only becomes the empty string. Other columns are not read. Strings of plain and
    composed Latin letters are seen to be consistent inside Spark; the rest go through the
    transducer.
    """
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("s")) for f in fields))
    long = df.select(F.col(key).cast("bigint").alias("rec_id"), F.explode(pairs).alias("x")).select("x.field", "rec_id", "x.s")
    odd = long.where(~F.col("s").rlike(plain_pattern()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = Transducer()
        for b in batches:
            rows: list[int] = []
            out: list[str] = []
            for i, s in enumerate(b.column("s").to_pylist()):
                t = form(s)
                if t != s:
                    rows.append(i)
                    out.append(t)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("field").take(take), b.column("rec_id").take(take), pa.array(out, pa.string())], ["field", "rec_id", "clean"])

    return odd.mapInArrow(run, "field string, rec_id bigint, clean string")


class Fold(dict):
    """A table for ``str.translate`` that keeps letters and digits by their look and case only.

    Accents and invisible characters go, look-alikes become the Latin letter, and everything
    else becomes a space.
    """

    def __missing__(self, cp: int) -> str:
        self[cp] = out = fold_char(chr(cp))
        return out


def fold_char(c: str) -> str:
    m = mapping()
    if c in m and m[c] == "":
        return ""
    out = []
    for x in unicodedata.normalize("NFD", m.get(c, c)):
        if unicodedata.combining(x) or unicodedata.category(x)[0] == "M":
            continue
        for y in TWINS.get(x, x).casefold():
            out.append(y if y.isalnum() else " ")
    return "".join(out)


def words(s: str, fold: Fold) -> list[str]:
    """The words of a text by look and case only."""
    return s.translate(fold).split()


@lru_cache(1)
def fold_table():
    """The same as an array over all code points: 0 for nothing, 32 for a space, else the letter.

    Of a character that folds to several, the first stands for all; it does so on both sides
    of any comparison.
    """
    import numpy as np

    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for cp in range(0x30000):
        if 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4 or cp >= 0x20000:
            table[cp] = cp
        elif not 0xD800 <= cp < 0xE000:
            f = fold_char(chr(cp))
            table[cp] = ord(f[0]) if f else 0
    table[0] = 32
    return table
