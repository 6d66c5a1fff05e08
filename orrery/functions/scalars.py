"""Scalar functions over paths, texts and numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


def _stripped(path: Column) -> Column:
    return F.regexp_replace(path, "^/+|/+$", "")


def folder_level(path: Column) -> Column:
    """0 for the root, else the number of segments."""
    p = _stripped(path)
    return F.when(p == "", 0).otherwise(F.size(F.split(p, "/")))


def parent_folder(path: Column) -> Column:
    """The path without its last segment; null at root level."""
    return F.nullif(F.regexp_extract(_stripped(path), "^(.*)/[^/]*$", 1), F.lit(""))


def direct_folder(path: Column) -> Column:
    """Like the parent, "" at root level."""
    return F.coalesce(parent_folder(path), F.lit(""))


def basename(path: Column) -> Column:
    return F.element_at(F.split(_stripped(path), "/"), -1)


def top_two_segments(path: Column) -> Column:
    """The first two segments that are not empty."""
    return F.concat_ws("/", F.slice(F.filter(F.split(path, "/"), lambda s: s != ""), 1, 2))


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, of a name with a dot after its first character, else ""."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def normalize_ext(ext: Column) -> Column:
    return F.when(F.lower(ext).startswith("."), F.lower(ext)).otherwise(F.concat(F.lit("."), F.lower(ext)))


def language_from_path(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in V.LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.element_at(F.split(path, r"\."), -1))), F.lit("unknown"))


def meta_id(key: Column) -> Column:
    return F.sha2(F.replace(key, F.lit("\\"), F.lit("/")), 256)


def encode_meta_path(path: Column) -> Column:
    return F.replace(F.replace(path, F.lit("/"), F.lit("__SL__")), F.lit("\\"), F.lit("__BS__"))


def decode_meta_path(path: Column) -> Column:
    return F.replace(F.replace(path, F.lit("__SL__"), F.lit("/")), F.lit("__BS__"), F.lit("\\"))


def repo_name_from_url(url: Column) -> Column:
    """Last two path segments without .git; the url itself where there are not two."""
    found = F.regexp_extract(F.regexp_replace(url, r"(\.git)?/*$", ""), r"^[a-z]+://[^/]+/(?:.*/)?([^/]+/[^/]+)$", 1)
    return F.when(found == "", url).otherwise(found)


def count_lines(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n", -1))).cast("long")


def token_len(text: Column) -> Column:
    return F.ceil(F.char_length(text) / 4).cast("long")


def slugify(title: Column) -> Column:
    s = F.regexp_replace(F.lower(title), "[^a-z0-9\\s-]", "")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "\\s+", "-"), "-+", "-"), "^-|-$", "")
    return F.regexp_replace(F.substring(s, 1, 80), "-$", "")


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, of an ASCII text."""
    codes = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619), F.lit(1 << 32)))


def file_slug(path: Column, limit: int = 200) -> Column:
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"^[/\\]+", ""), r"[/\\]", "__"), "[^a-zA-Z0-9._-]", "_")
    short = F.concat(F.substring(flat, 1, limit - 9), F.lit("-"), F.lpad(F.lower(F.hex(fnv1a(flat))), 8, "0"))
    return F.when(F.length(flat) <= limit, flat).otherwise(short)


def parse_number(text: Column) -> Column:
    """The numeric prefix of a text as a double; 0 where there is none."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def strip_json_fence(raw: Column) -> Column:
    return F.trim(F.regexp_replace(raw, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))


def lenient_json(raw: Column) -> Column:
    """The JSON text itself, or from its first { to its last }; null where neither parses."""
    plain = strip_json_fence(raw)
    inner = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    parses = lambda x: F.try_parse_json(x).isNotNull() & (x != "")
    return F.when(parses(plain), plain).when(parses(inner), inner)


def yes_no(answer: Column) -> Column:
    a = F.upper(F.trim(answer))
    return F.when(a.startswith("YES"), True).when(a.startswith("NO"), False)


def phase_percent(phase: Column, done: Column, total: Column) -> Column:
    floor = F.element_at(F.create_map(*[F.lit(x) for pair in V.PHASE_FLOOR.items() for x in pair]), phase).cast("double")
    return F.when((phase == "file_analysis") & (total > 0), 5 + F.least(F.lit(1.0), done / total) * 65).otherwise(floor)


def glob_regex(glob: str) -> str:
    """** spans folders, * stays within one; all else is literal; anchored."""
    import re

    parts = re.split(r"(\*\*|\*)", glob)
    return "^" + "".join({"**": ".*", "*": "[^/]*"}.get(p, re.escape(p)) for p in parts) + "$"
