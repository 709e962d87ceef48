"""Fill-in-the-middle transformation over run-length encoded character classes (operator 12).

A text is cut into units (lines, words, runs of a class, or characters). It is stored as its maximal runs of one
character class: where each run starts, and how many units have ended by its end. A cut after ``c`` units is then found
without making the units: a binary search finds the run in which unit ``c`` ends, and the place in it is arithmetic. A
text of many megabytes of blank lines is a single run.

Everything is done on the bytes of UTF-8: all class borders used are ASCII, so byte offsets never fall into a character.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import with_made_columns

#: Classes of bytes: 0 line end, 1 other white space, 2 word characters (all bytes outside of ASCII too), 3 the rest.
_CLASSES = np.full(256, 3, np.uint8)
_CLASSES[[9, 11, 12, 13, 32]] = 1
_CLASSES[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 2
_CLASSES[10] = 0

#: How runs make units. For each of the four classes: the class it is merged into, and what ends a unit there: "each"
#: byte of the run, the "run" as a whole, or "none". Behind the last end, what is left is one more unit.
UNITS = {
    "line": ([0, 1, 1, 1], {0: "each", 1: "none"}),
    "word": ([0, 0, 1, 1], {0: "none", 1: "run"}),
    "class": ([0, 1, 2, 3], {0: "each", 1: "run", 2: "run", 3: "run"}),
}


class Runs(NamedTuple):
    """Runs of one text: start offsets (and the text's end), units ended by each run's end, which runs end a unit at every byte."""

    starts: np.ndarray
    units: np.ndarray
    each: np.ndarray

    @property
    def n(self) -> int:
        """How many units the text has."""
        return int(self.units[-1]) if len(self.units) else 0

    def cut(self, c: int) -> int:
        """The byte offset behind the first ``c`` units."""
        if c <= 0:
            return 0
        r = int(np.searchsorted(self.units, c))
        before = int(self.units[r - 1]) if r else 0
        return int(self.starts[r]) + c - before if self.each[r] else int(self.starts[r + 1])


def runs(raw: bytes, unit: str = "line") -> Runs:
    """The runs of a text's bytes. ``unit`` is one of ``UNITS``, or "char" for code points."""
    data = np.frombuffer(raw, np.uint8)
    if unit == "char":  # a code point ends where the next begins; ASCII stretches are runs with a unit at each byte
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        single = data[lead] < 128
        first = np.flatnonzero(~single | np.concatenate([[True], ~single[:-1]])) if len(lead) else np.zeros(0, np.int64)
        starts = np.append(lead[first], len(data))
        return Runs(starts, np.append(first[1:], len(lead)) if len(first) else first, single[first] if len(first) else np.zeros(0, bool))
    merged, ends = UNITS[unit]
    kind = np.array(merged, np.uint8)[_CLASSES][data]
    starts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])) if len(data) else np.zeros(0, np.int64)
    kinds = kind[starts]
    lengths = np.diff(np.append(starts, len(data)))
    how = np.array([{"each": 2, "run": 1, "none": 0}[ends[k]] for k in sorted(ends)], np.uint8)[kinds]
    made = np.where(how == 2, lengths, how)
    if len(made) and how[-1] == 0:
        made[-1] = 1  # what is left at the end
    return Runs(np.append(starts, len(data)), np.cumsum(made), how == 2)


def draws(doc_id: object, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from a document's id and a seed; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * i : 8 * i + 8], 16) for i in range(4))


class Marks(NamedTuple):
    """The marks before the three parts. Texts that contain one stay plain, so a marked text can be taken apart again."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def checked(self) -> Marks:
        """Refuse marks that could be seen in part in one another or across the border to a text."""
        for a in self:
            for b in self:
                for k in range(1, min(len(a), len(b)) + (a is not b)):
                    if a[-k:] == b[:k]:
                        raise ValueError(f"the end of {a!r} is the start of {b!r}: texts could not be rebuilt")
                if a is not b and a in b:
                    raise ValueError(f"{a!r} is in {b!r}")
        if not all(self) or len(set(self)) < 3:
            raise ValueError("three different marks are needed")
        return self


def transform(raw: bytes, doc_id: object, unit: str, seed: int, fim_percent: int, spm_percent: int, marks: tuple[bytes, bytes, bytes]) -> tuple:
    """Units, form, output bytes, and the code points of prefix and middle (None for plain) of one text."""
    p, s, m = marks
    found = runs(raw, unit)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not raw or any(x in raw for x in marks) or h3 % 100 >= fim_percent:
        return found.n, "plain", raw, None, None
    a, b = sorted((h1 % (found.n + 1), h2 % (found.n + 1)))
    a, b = found.cut(a), found.cut(b)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    form = "spm" if h4 % 100 < spm_percent else "psm"
    out = s + suffix + p + prefix + m + middle if form == "spm" else p + prefix + s + suffix + m + middle
    return found.n, form, out, len(prefix.decode()), len(middle.decode())


def rebuild(out: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytes:
    """The text that was made into ``out``."""
    p, s, m = marks
    if form == "plain":
        return out
    if form == "psm":
        prefix, _, rest = out[len(p) :].partition(s)
        suffix, _, middle = rest.partition(m)
    else:
        suffix, _, rest = out[len(s) :].partition(p)
        prefix, _, middle = rest.partition(m)
    return prefix + middle + suffix


def fill_in_middle(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    unit: str = "line",
    seed: int = 7,
    fim_percent: int = 100,
    spm_percent: int = 50,
    marks: Marks = Marks(),
) -> DataFrame:
    """``docs`` with ``n`` (units), ``form`` (plain, psm, spm), ``output``, ``prefix_chars`` and ``middle_chars``.

    Whole texts are transformed; the cuts come from the id and the seed alone, so reruns and any number of tasks agree,
    and rows that share an id share their draws. A null text counts as empty and gives an empty output in plain form; a
    null id is an empty one. Texts with a mark in them stay plain. Columns of the new names are replaced, others
    pass through. No rows: no rows. Nothing is shuffled; a task holds about a megabyte of text, or one longer text.
    """
    held = tuple(x.encode() for x in marks.checked())
    kinds = {"n": "bigint", "form": "string", "output": "string", "prefix_chars": "bigint", "middle_chars": "bigint"}

    def made(_: object, texts: list, ids: list) -> dict:
        rows = [transform((t or "").encode(), i, unit, seed, fim_percent, spm_percent, held) for i, t in zip(ids, texts)]
        n, form, out, a, b = zip(*rows)
        return {"n": pa.array(n, pa.int64()), "form": pa.array(form), "output": pa.array([x.decode() for x in out]), "prefix_chars": pa.array(a, pa.int64()), "middle_chars": pa.array(b, pa.int64())}

    return with_made_columns(docs, text, kinds, lambda: None, made, also=(key,))


def restore(docs: DataFrame, output: str = "output", form: str = "form", into: str = "restored", marks: Marks = Marks()) -> DataFrame:
    """``docs`` with the exact text that each output was made from. A null output gives null; rows in forms unknown give null too."""
    held = tuple(x.encode() for x in marks.checked())

    def made(_: object, outs: list, forms: list) -> dict:
        return {into: pa.array([None if o is None or f not in ("plain", "psm", "spm") else rebuild(o.encode(), f, held).decode() for f, o in zip(forms, outs)], pa.string())}

    return with_made_columns(docs, output, {into: "string"}, lambda: None, made, also=(form,))


def op12_infill(docs: DataFrame) -> DataFrame:
    """The contract's query: cut and rebuild every text, give digests of both."""
    both = restore(fill_in_middle(docs.select("doc_id", "text")).drop("text"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
l AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(units) AS n, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM l),
p AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM c),
x AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:n], '') AS suf FROM p)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    CASE WHEN NOT plain THEN length(pre) END AS prefix_chars, CASE WHEN NOT plain THEN length(mid) END AS middle_chars,
    sha256(CASE WHEN plain THEN t WHEN h4 % 100 < 50 THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM x
"""
