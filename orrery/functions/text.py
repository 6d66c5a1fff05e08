"""Scalar functions over names, urls, JSON and messages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars as S
from . import values as V


def escape_fulltext(term: Column) -> Column:
    """A backslash before each character that full-text queries give a meaning."""
    return F.regexp_replace(term, V.FULLTEXT_SPECIALS, r"\\$0")


def fulltext_query(terms: Column) -> Column:
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit("*"), escape_fulltext(t), F.lit("*"))), " ")


def stats_repo_name(kind: Column, path: Column, url: Column) -> Column:
    """Of a local source its folder's name, of a remote one owner/repo, the url where it has not both."""
    last = F.element_at(F.filter(F.split(path, "/"), lambda s: s != ""), -1)
    return F.when(kind == "local", F.coalesce(last, path)).otherwise(S.repo_name_from_url(url))


def parse_repo_url(url: Column) -> Column:
    """struct(owner, repo, branch) of an address on the one host that is known; null elsewhere."""
    part = lambda i: F.nullif(F.regexp_extract(url, V.REPO_URL, i), F.lit(""))
    return F.when(url.rlike(V.REPO_URL), F.struct(part(1).alias("owner"), part(2).alias("repo"), part(3).alias("branch")))


def is_slug(text: Column) -> Column:
    return text.rlike(V.SLUG)


def is_commit_hash(text: Column) -> Column:
    return text.rlike(V.COMMIT_HASH)


def is_branch_name(text: Column) -> Column:
    return text.rlike(V.BRANCH_NAME)


def join_nonblank(items: Column, by: str = " | ") -> Column:
    return F.array_join(nonempty(F.transform(items, lambda x: F.trim(x))), by)


def nonempty(items: Column) -> Column:
    """The items that are neither null nor ""."""
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts as a JSON array of texts, in order."""
    return F.sha2(F.to_json(F.array(*parts)), 256)


def failure_category(error: Column, status: Column) -> Column:
    """What kind of failure an error of a kind, or a response status, is."""
    transport = F.when(status.isin(401, 403), "llm_auth").when(status == 402, "llm_quota").when(status == 429, "llm_rate_limit").otherwise("llm_unreachable")
    known = F.when(error == "usage_limit", "usage_limit_exceeded").when(error == "config", "llm_config").when(error == "repo", "repo_unavailable")
    return known.when(error == "llm", transport).otherwise("internal")


def is_retryable(category: Column) -> Column:
    return category.isin(*V.RETRYABLE)


def short_id(text: Column) -> Column:
    return F.concat(F.substring(text, 1, 8), F.lit("…"))


def source_label(kind: Column, url: Column, branch: Column, path: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "^[a-z]+://[^/]+", ""), "^/+", ""), r"\.git$", "")
    at = F.when(F.coalesce(branch, F.lit("")) != "", F.concat(F.lit("@"), branch)).otherwise("")
    return F.when(kind == "github", F.concat(F.lit("github:"), slug, at)).otherwise(F.concat(F.lit("local:"), path))


def cost_label(cost: Column) -> Column:
    """Dollars to six places; -1 is a cost that nobody knows."""
    return F.when(cost == -1, "unknown").otherwise(F.concat(F.lit("$"), cost.cast("decimal(20,6)").cast("string")))


def cap_tokens(text: Column, most: int) -> Column:
    """The text, shortened by the ratio of what is allowed to its length in tokens."""
    tokens = S.token_len(text)
    return F.when(tokens > most, F.substring(text, F.lit(1), F.floor(F.char_length(text) * (F.lit(float(most)) / tokens)).cast("int"))).otherwise(text)


def numbered(items: Column) -> Column:
    """`1. item` lines."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def _number(value: Column) -> Column:
    """A double as text, whole ones without a fraction."""
    return F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("string"))


def counted_lines(entries: Column) -> Column:
    """`  keyword (count)` lines of an array of (keyword, count)."""
    return F.array_join(F.transform(entries, lambda e: F.concat(F.lit("  "), e["keyword"], F.lit(" ("), _number(e["count"]), F.lit(")"))), "\n")


def enrichment_text(focus: str = "shared", most: int = V.SECTION_TOKENS) -> Column:
    """The sections of an enrichment row (see artifacts.enrichment) for product, technical or shared focus, those with nothing left out, capped in tokens."""
    parts = []
    for title, column, kind in V.SECTIONS:
        if focus not in (kind, "shared"):
            continue
        c = F.col(column)
        if column == "major_subsystems":
            body, has = F.array_join(F.transform(c, lambda s: F.concat(F.lit("  "), s["name"], F.lit(": "), s["responsibility"])), "\n"), F.size(c) > 0
        elif column == "repo_key_patterns":
            body, has = F.concat(F.lit("  "), F.array_join(c, ", ")), F.size(c) > 0
        elif column.startswith("repo_"):
            body, has = c, c != ""
        else:
            body, has = counted_lines(c), F.size(c) > 0
        parts.append(F.when(has, F.concat(F.lit(f"{title}:\n"), body)))
    return cap_tokens(F.array_join(F.array_compact(F.array(*parts)), "\n\n"), most)


def folder_lines(folders: Column) -> Column:
    """Folders (folder_path, purpose, summary, keywords) as a prompt lists them, the root as <root>."""
    one = lambda f: F.concat(F.lit("- "), F.when(f["folder_path"] == "", "<root>").otherwise(f["folder_path"]), F.lit("\n  purpose: "), f["purpose"], F.lit("\n  summary: "), f["summary"], F.lit("\n  keywords: "), F.to_json(f["keywords"]))
    return F.concat(F.lit("Folder count: "), F.size(folders).cast("string"), F.lit("\n\nFolder summaries (sorted shallowest-first):\n\n"), F.array_join(F.transform(folders, one), "\n\n"))


def partial_lines(partials: Column) -> Column:
    """Partial summaries as a prompt to merge them lists them."""
    return F.array_join(F.transform(partials, lambda p, i: F.concat(F.lit("--- Partial "), (i + 1).cast("string"), F.lit(" ---\n"), p)), "\n\n")


def json_set(doc: Column, **fields: Column) -> Column:
    """The JSON object with fields set, in their place or else at the end; all others stay as they are.  Text that is no object counts as empty."""
    kind = "map<string,variant>"
    whole = F.coalesce(F.from_json(doc, kind), F.create_map().cast(kind))
    for name, value in fields.items():
        whole = _put(whole, name, value.cast("variant"))
    return F.to_json(whole)


def _put(whole: Column, name: str, value: Column) -> Column:
    inside = F.transform_values(whole, lambda k, x: F.when(k == name, value).otherwise(x))
    return F.when(F.map_contains_key(whole, name), inside).otherwise(F.map_concat(whole, F.create_map(F.lit(name), value)))


def model_chain(primary: Column, fallbacks: Column) -> Column:
    """The first model and its non-empty fallbacks, each once, in order."""
    return F.array_distinct(nonempty(F.concat(F.array(primary), fallbacks)))
