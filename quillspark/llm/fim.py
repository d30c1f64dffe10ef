"""Fill-in-middle transformation of whole texts by an Aho-Corasick event scan.

One automaton holds the characters that end a unit and the sentinels, and reports where they stand. Between two such
events nothing changes class, so the units of a gap follow by arithmetic, and the place of the k-th unit is found from
the events alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts, ship

#: Sentinels of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of each unit: the ASCII characters that end it, and whether a run of them ends one unit. Of "chars" none does: every
#: code point is a unit.
UNITS = {"lines": ("\n", False), "words": (" \t\n\r\f\v", True), "chars": ("", False)}
_END, _SENTINEL = 0, 1


def checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """The sentinels, if what stands between them can always be told apart again: a sentinel must not end with what
    another (or itself) begins with, nor lie within another."""
    for a, b in permutations(sentinels, 2):
        if not a or a in b:
            raise ValueError("sentinels must be strings none of which holds another")
    for a in sentinels:
        for b in sentinels:
            if any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError("no sentinel may end with the beginning of one")
    return tuple(sentinels)


def scanner(unit: str, sentinels: tuple[str, str, str]) -> ahocorasick.Automaton:
    """The automaton of the characters that end units and of the sentinels."""
    found = ahocorasick.Automaton()
    for c in UNITS[unit][0]:
        found.add_word(c, _END)
    for s in sentinels:
        found.add_word(s, _SENTINEL)
    found.make_automaton()
    return found


class Events:
    """Where the units of a text end, and whether it holds a sentinel."""

    def __init__(self, automaton: ahocorasick.Automaton, unit: str, text: str):
        seen = list(automaton.iter(text))
        at = np.array([end for end, kind in seen if kind == _END], np.int64) + 1
        self.marked = len(at) < len(seen)
        if UNITS[unit][1] and len(at):
            at = at[np.append(np.diff(at) > 1, True)]
        self.ends, self.size, self.single = at, len(text), unit == "chars"

    def units(self) -> int:
        """All units: those that an event ends, and the gap behind the last one."""
        if self.single:
            return self.size
        return len(self.ends) + bool(self.size > (self.ends[-1] if len(self.ends) else 0))

    def after(self, k: int) -> int:
        """Code points in the first k units."""
        if self.single:
            return k
        return 0 if k == 0 else int(self.ends[k - 1]) if k <= len(self.ends) else self.size


def transform(docs: DataFrame, unit: str = "lines", seed: str = "7", rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Cut every whole text into prefix, middle and suffix at two places between units: doc_id, n (units), form,
    prefix_chars, middle_chars (code points; null if plain), output.

    h1 .. h4 are the first four groups of 8 hex digits of sha256("<seed>:<doc_id>"). The prefix ends after the smaller of
    h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger. A text is left plain if it is empty, holds a
    sentinel, or h3 % 100 >= rate; else it is spm (suffix first) if h4 % 100 < spm, else psm.

    A null text is empty. A null doc_id counts as an empty string in the hash. Repeated rows give equal rows each; an empty
    table gives none; further columns are not read. Narrow: a task holds 256 rows at a time, and the events of one text."""
    p, s, m = checked(sentinels)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillspark.llm.fim import Events, scanner

        automaton = scanner(unit, (p, s, m))
        for batch in parts(batches, 256):
            n, form, prefix, middle, output = [], [], [], [], []
            for text, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = Events(automaton, unit, text)
                h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
                n.append(found.units())
                if not text or found.marked or h3 % 100 >= rate:
                    form.append("plain")
                    prefix.append(None)
                    middle.append(None)
                    output.append(text)
                    continue
                a, b = sorted((found.after(h1 % (n[-1] + 1)), found.after(h2 % (n[-1] + 1))))
                form.append("spm" if h4 % 100 < spm else "psm")
                prefix.append(a)
                middle.append(b - a)
                head, body, tail = text[:a], text[a:b], text[b:]
                output.append(f"{s}{tail}{p}{head}{m}{body}" if form[-1] == "spm" else f"{p}{head}{s}{tail}{m}{body}")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    doc_id = docs["doc_id"].cast("long")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), key.alias("key"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that transform() made output of. Null where output or form is null."""
    p, s, m = checked(sentinels)

    def pieces(first: str, second: str) -> tuple[Column, Column, Column]:
        x, y = F.locate(second, output), F.locate(m, output)
        one = F.substring(output, F.lit(len(first) + 1), x - F.lit(len(first) + 1))
        two = F.substring(output, x + F.lit(len(second)), y - x - F.lit(len(second)))
        return one, two, F.substring(output, y + F.lit(len(m)), F.length(output))

    head, tail, body = pieces(p, s)
    tail2, head2, body2 = pieces(s, p)
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, body, tail)).when(form == "spm", F.concat(head2, body2, tail2))


def op11_fim(spark, sf_dir: str) -> DataFrame:
    x = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    back = restored(F.col("output"), F.col("form"))
    return x.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES = {"op11_fim": op11_fim}
ORACLES = {
    "op11_fim": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS units,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS head, coalesce(array_to_string(units[a + 1:b], ''), '') AS body,
    coalesce(array_to_string(units[b + 1:n], ''), '') AS tail FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(head) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(body) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || body ELSE '<S>' || tail || '<P>' || head || '<M>' || body END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE head || body || tail END) AS restored_sha256
FROM p"""
}
