"""Text of event-log messages and fault tickets, as built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}_]+"


def _segment_tokens(segment: Column) -> Column:
    """Lower-case word tokens of one message segment; ``_`` separates words, too."""
    plain = F.replace(F.lower(F.trim(segment)), F.lit("_"), F.lit(" "))
    return F.array_remove(F.split(plain, NOT_WORD), "")


def _segments(msg: Column) -> Column:
    return F.split(F.trim(msg), r"\|")


def is_hex(token: Column) -> Column:
    return token.startswith("0") & (F.length(token) > 1)


def _canonical(token: Column) -> Column:
    return (
        F.when(is_hex(token), F.lit("hex"))
        .when(token.contains("port"), F.lit("port"))
        .when(token.contains("dimm"), F.lit("dimm"))
        .otherwise(token)
    )


def normalize_message(msg: Column) -> Column:
    """Array of segments, each a space-joined list of canonical tokens; empty for no text."""
    texts = F.transform(
        _segments(msg), lambda s: F.array_join(F.transform(_segment_tokens(s), _canonical), " ")
    )
    none = F.array().cast("array<string>")
    return F.when(F.length(msg) > 0, texts).otherwise(none)


def message_tokens(segments: Column) -> Column:
    """Tokens of a normalised message, in reading order."""
    return F.filter(F.split(F.array_join(segments, " "), " +"), lambda w: w != "")


def message_segments(segments: Column) -> dict[str, Column]:
    """First, second (else empty) and third (else last) segment."""
    third = F.when(F.size(segments) == 3, F.try_element_at(segments, F.lit(3))).otherwise(
        F.try_element_at(segments, F.lit(-1))
    )
    return {
        "seg_a": F.coalesce(F.try_element_at(segments, F.lit(1)), F.lit("")),
        "seg_b": F.coalesce(F.try_element_at(segments, F.lit(2)), F.lit("")),
        "seg_c": third,
    }


def extract_meta(msg: Column) -> Column:
    """Array of (ctx, token): every hex or cpu token with up to two tokens before it."""

    def of_tokens(tokens: Column) -> Column:
        pairs = F.transform(
            tokens,
            lambda w, i: F.struct(
                F.array_join(
                    F.slice(tokens, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))), " "
                ).alias("ctx"),
                w.alias("token"),
            ),
        )
        return F.filter(
            pairs,
            lambda p: is_hex(p["token"])
            | (p["token"].contains("cpu") & (F.length(p["token"]) > 3)),
        )

    # Segments are split in a step of their own, not once more for every token.
    found = F.flatten(F.transform(F.transform(_segments(msg), _segment_tokens), of_tokens))
    none = F.array().cast("array<struct<ctx:string,token:string>>")
    return F.when(F.length(msg) > 0, found).otherwise(none)


def first_meta(meta: Column) -> Column:
    """The first pair as a one-entry map, null without a pair."""
    return F.when(
        F.size(meta) > 0,
        F.create_map(F.element_at(meta, 1)["ctx"], F.element_at(meta, 1)["token"]),
    )


# The masking rules, in the order they are applied.
_EDGE_L, _EDGE_R = r"((?<=[^A-Za-z0-9])|^)", r"((?=[^A-Za-z0-9])|$)"
MASKS = [
    (_EDGE_L + r"(([0-9a-f]{2,}:){3,}([0-9a-f]{2,}))" + _EDGE_R, "ID"),
    (_EDGE_L + r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})" + _EDGE_R, "IP"),
    (_EDGE_L + r"([0-9a-f]{6,} ?){3,}" + _EDGE_R, "SEQ"),
    (_EDGE_L + r"([0-9A-F]{4} ?){4,}" + _EDGE_R, "SEQ"),
    (_EDGE_L + r"(0x[a-f0-9A-F]+)" + _EDGE_R, "HEX"),
    (_EDGE_L + r"([\-\+]?\d+)" + _EDGE_R, "NUM"),
    (r"(?<=executed cmd )(\".+?\")", "CMD"),
]


def mask_variables(msg: Column, rules: Sequence[tuple[str, str]] = MASKS) -> Column:
    """Replace the variable parts of a message by ``<:NAME:>``."""
    for pattern, name in rules:
        msg = F.regexp_replace(msg, pattern, f"<:{name}:>")
    return msg


def hex_value(text: Column) -> Column:
    """Value of a hex text with or without ``0x``, 64 bits unsigned; null for anything longer."""
    bare = F.regexp_replace(F.trim(text), "^0[xX]", "")
    return F.when(bare.rlike("^0*[0-9a-fA-F]{1,16}$"), F.conv(F.right(bare, F.lit(16)), 16, 10).cast("decimal(20,0)"))


def explode_modules(df: DataFrame, module: str = "module", cause: str = "module_cause") -> DataFrame:
    """One row per module of a ticket, with the causes listed between its name and the next one.

    Three causes are cod0, cod1 and addr (hex after the colon, -1 otherwise); a single one is
    ``others``.
    """
    listed = df.withColumns(
        {"_modules": F.split(module, ","), "_items": F.split(cause, ",")}
    )
    items, modules = F.col("_items"), F.col("_modules")
    rows = listed.select(
        *[c for c in df.columns if c not in (module, cause)],
        "_items",
        "_modules",
        F.explode("_modules").alias(module),
    )
    start = F.array_position(items, F.col(module))
    rest = F.when(start > 0, F.slice(items, start + 1, F.size(items))).otherwise(
        F.array().cast("array<string>")
    )
    stop = F.array_min(
        F.filter(
            F.transform(rest, lambda x, i: F.when(F.array_contains(modules, x), i)),
            lambda i: i.isNotNull(),
        )
    )
    rows = rows.withColumn("_rest", rest).withColumn("_stop", stop)
    own = F.slice(F.col("_rest"), F.lit(1), F.coalesce(F.col("_stop"), F.size("_rest")))
    rows = rows.withColumn("_own", own)

    def code(i: int) -> Column:
        value = hex_value(F.split_part(F.element_at("_own", i), F.lit(":"), F.lit(2)))
        return F.when(F.size("_own") == 3, value).otherwise(F.lit(-1).cast("decimal(20,0)"))

    return rows.select(
        *[c for c in df.columns if c not in (module, cause)],
        module,
        code(1).alias("cod0"),
        code(2).alias("cod1"),
        code(3).alias("addr"),
        F.when(F.size("_own") == 1, F.element_at("_own", 1)).alias("others"),
    )


def split_fault_code(code: Column) -> dict[str, Column]:
    """``a.b.c.1F`` -> three texts and the value of the hex part."""
    parts = F.split(code, r"\.")
    return {
        "fault_code_0": F.try_element_at(parts, F.lit(1)),
        "fault_code_1": F.try_element_at(parts, F.lit(2)),
        "fault_code_2": F.try_element_at(parts, F.lit(3)),
        "fault_code_3": hex_value(F.try_element_at(parts, F.lit(-1))),
    }
