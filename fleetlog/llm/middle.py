"""Fill-in-middle: texts cut into prefix, middle and suffix at places drawn from the document's id.

One ``fullmatch`` of ``(unit)*`` keeps every repetition of the unit: ``match.ends(1)`` are the ends
of all units, so their number and both cut offsets are read off it. A unit is a code point unless the
caller gives another pattern (``\\X`` for graphemes, ``\\w+\\W*`` for words).

Cuts and form come from a sha256 of ``<seed>:<id>``: its first four 8-digit groups are h1 to h4. The
prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger.

Defined cases: a missing text is empty. An empty text, one that contains a sentinel, one whose h3 says
so, and one that the unit does not cover whole (``n`` is null) stay plain: the output is the text, the
lengths are null. A missing id draws as an empty one. Repeated rows give repeated results. Other
columns pass unchanged; new ones get underscores behind a name that is taken.

A task holds one Arrow batch and the ends of one text's units (about 60 bytes a unit).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlog.llm.base import fresh

CODE_POINT = r"(?s:.)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
#: Texts out of a hundred that are cut, and of the cut ones those that start with the suffix.
CUT_SHARE = 90
SUFFIX_FIRST_SHARE = 20


def draws(doc_id: Column, seed: str = SEED) -> Column:
    """The four unsigned 32-bit numbers of an id, as array<bigint>."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.transform(F.array(*[F.substring(digest, 8 * k + 1, 8) for k in range(4)]), lambda g: F.conv(g, 16, 10).cast("long"))


def cut(text: str, numbers: list[int], units: regex.Pattern, cut_share: int = CUT_SHARE, suffix_first: int = SUFFIX_FIRST_SHARE):
    """(n, form, prefix length, middle length, output) of one text; ``units`` is the compiled ``(unit)*``."""
    found = units.fullmatch(text)
    ends = found.ends(1) if found else None
    n = None if ends is None else len(ends)
    h1, h2, h3, h4 = numbers
    if not n or h3 % 100 >= cut_share or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[a - 1] if a else 0), (ends[b - 1] if b else 0)
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def transform(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    seed: str = SEED,
    unit: str = CODE_POINT,
    cut_share: int = CUT_SHARE,
    suffix_first: int = SUFFIX_FIRST_SHARE,
) -> tuple[DataFrame, dict[str, str]]:
    """Add ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``; also their names as given."""
    fields = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}
    names: dict[str, str] = {}
    for f in fields:
        names[f] = fresh(f, [*docs.columns, *names.values()])
    drawn = fresh("draws", [*docs.columns, *names.values()])
    rows = docs.withColumn(drawn, draws(F.col(f"`{doc_id}`"), seed))
    schema = T.StructType([*docs.schema.fields, *[T.StructField(names[f], T._parse_datatype_string(t)) for f, t in fields.items()]])
    at, kinds = docs.columns.index(text), [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # possessive: a repetition is never given back, so matching takes one pass and no stack
        units = regex.compile(f"({unit})*+")
        for batch in batches:
            numbers = batch.column(batch.num_columns - 1).to_pylist()
            made = [cut(t or "", d, units, cut_share, suffix_first) for t, d in zip(batch.column(at).to_pylist(), numbers, strict=True)]
            columns = [pa.array([m[k] for m in made], type=kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=schema.names)

    return rows.mapInArrow(run, schema), names


def restored(output: Column, form: Column) -> Column:
    """The text from output and form. A cut text holds no sentinel, so those found are the three marks."""
    part = lambda k: F.get(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1), F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
