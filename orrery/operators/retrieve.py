"""Lines of files: ranges, searches with context, budgets, pages and chunks.

What concerns one file is worked out within its row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import values as V
from . import chains

ID = ["knowledge_id", "relative_path"]


def lines(files: DataFrame, pattern: str = "\r?\n") -> DataFrame:
    """knowledge_id, relative_path, line_no (from 1), line."""
    return files.select(*ID, F.posexplode(F.split("content", pattern, -1)).alias("pos", "line")).select(*ID, (F.col("pos") + 1).alias("line_no"), "line")


def read_range(files: DataFrame, first: int = 1, last: int | None = None, tokens: int = 5000) -> DataFrame:
    """Lines first to last while their characters fit the tokens (4 each), one line at least, numbered and right-aligned."""
    first = max(1, first)
    # A line costs a character at least, so no more of them are taken out of the row than could fit.
    most = tokens * 4 + 1 if last is None else max(0, min(last - first + 1, tokens * 4 + 1))
    some = F.slice(_split(F.col("content")), first, most)
    rows = files.select(*ID, F.posexplode(some).alias("pos", "line")).select(*ID, (F.col("pos") + first).alias("line_no"), "line")
    w = Window.partitionBy(*ID).orderBy("line_no")
    cost = F.sum(F.char_length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("used", cost).withColumn("nth", F.row_number().over(w)).where((F.col("used") <= tokens * 4) | (F.col("nth") == 1))
    width = F.length(F.max("line_no").over(Window.partitionBy(*ID)).cast("string"))
    return rows.select(*ID, "line_no", F.concat(F.lpad(F.col("line_no").cast("string"), width, F.lit(" ")), F.lit(": "), "line").alias("numbered"))


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's body would compute an expression anew wherever it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _split(content: Column) -> Column:
    return F.split(content, "\r?\n", -1)


def _around(rows: Column, i: Column, context: int) -> Column:
    """The lines from `context` before the i-th (from 0) to `context` after it."""
    first = F.greatest(i - context, F.lit(0))
    return F.slice(rows, first + 1, i + context + 1 - first)


def _numbered(rows: Column, first: Column) -> Column:
    """Lines with their numbers from `first`, right-aligned, as one text."""
    width = F.length((first + F.size(rows) - 1).cast("string"))
    return F.array_join(F.transform(rows, lambda x, i: F.concat(F.lpad((first + i).cast("string"), width, F.lit(" ")), F.lit(" | "), x)), "\n")


def _hits(rows: Column, term: str) -> Column:
    """Places (from 0) of the lines that contain the term, whatever the case."""
    return F.filter(F.transform(rows, lambda x, i: F.when(F.lower(x).contains(term.lower()), i)), lambda i: i.isNotNull())


def search_lines(files: DataFrame, term: str, context: int = 3) -> DataFrame:
    """Lines that contain the term, whatever the case, each with `context` lines (0 to 10) before and after."""
    c = min(max(int(context), 0), 10)
    found = _bound(_split(F.col("content")), lambda rows: F.transform(_hits(rows, term), lambda i: F.struct((i + 1).alias("line_no"), F.get(rows, i).alias("line"), F.array_join(_around(rows, i, c), "\n").alias("around"))))
    return files.select(*ID, F.inline(found))


def content_range(files: DataFrame, first: int = 1, last: int | None = None, tokens: int = 10_000) -> DataFrame:
    """Per file total_lines, from_line, to_line, truncated, has_more, next_from_line and content: numbered lines while they fit.

    A line costs its number's digits, 3 and its characters, against 4 characters a token;
    one line at least is given.  A first line past the end gives none and goes up to the
    line before it; a null content is one empty line.
    """
    first = max(1, first)
    budget = tokens * 4
    wanted = F.greatest(F.lit(first), F.least(F.size("rows"), F.lit(last if last is not None else 2**31 - 1)))
    # A line costs 4 at least, so no more lines than tokens are looked at.
    some = F.slice("rows", first, F.least(F.col("wanted") - first + 1, F.lit(tokens + 1)))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def take(acc, x):
        cost = F.length((acc["n"] + first).cast("string")) + 3 + F.char_length(x)
        fits = acc["open"] & ((acc["used"] + cost <= budget) | (acc["n"] == 0))
        return F.struct(F.when(fits, acc["used"] + cost).otherwise(acc["used"]).cast("long").alias("used"), (acc["n"] + fits.cast("int")).alias("n"), fits.alias("open"))

    rows = files.select(*ID, _split(F.coalesce("content", F.lit(""))).alias("rows")).withColumn("wanted", wanted).withColumn("some", some)
    rows = rows.withColumn("n", F.aggregate("some", zero, take, lambda acc: acc["n"]))
    to = F.lit(first) + F.col("n") - 1
    more = to < F.size("rows")
    return rows.select(
        *ID, F.size("rows").alias("total_lines"), F.lit(first).alias("from_line"), to.alias("to_line"), (to < F.col("wanted")).alias("truncated"), more.alias("has_more"), F.when(more, to + 1).alias("next_from_line"),
        F.coalesce(F.when(F.col("n") > 0, _numbered(F.slice("some", 1, F.col("n")), F.lit(first))), F.lit("")).alias("content"),
    )


def content_search(files: DataFrame, term: str, context: int = 3) -> DataFrame:
    """Per file total_lines, search_matches and matches array<(line, text, context)>, the context with line numbers; files without a match too."""
    c = min(max(int(context), 0), 10)
    first = lambda i: F.greatest(i - c, F.lit(0)) + 1
    found = lambda rows: F.transform(_hits(rows, term), lambda i: F.struct((i + 1).alias("line"), F.get(rows, i).alias("text"), _bound(_around(rows, i, c), lambda x: _numbered(x, first(i))).alias("context")))
    out = files.select(*ID, _bound(_split(F.coalesce("content", F.lit(""))), lambda rows: F.struct(F.size(rows).alias("total_lines"), found(rows).alias("matches"))).alias("x"))
    return out.select(*ID, "x.total_lines", F.size("x.matches").alias("search_matches"), "x.matches")


def bulk_answer(files: DataFrame, paths: DataFrame, term: str, context: int = 3, match_only: bool = False) -> DataFrame:
    """Per row of paths(knowledge_id, relative_path, ord): section, pos, match_count, matches.

    section: `matched`, most matches first; `no_match` and `errored` (no such file), as
    asked.  pos counts from 1 in each section of a knowledge base.  matches are left out
    where only counts are wanted.  paths is what a user asked for, joined with the files.
    """
    found = content_search(files.join(paths.select(*ID).distinct(), ID, "left_semi"), term, context)
    rows = paths.join(found, ID, "left")
    section = F.when(F.col("search_matches").isNull(), "errored").when(F.col("search_matches") == 0, "no_match").otherwise("matched")
    rows = rows.withColumn("section", section)
    pos = F.row_number().over(Window.partitionBy("knowledge_id", "section").orderBy(F.when(F.col("section") == "matched", -F.col("search_matches")).otherwise(0), "ord"))
    none = F.lit(None).cast(found.schema["matches"].dataType)
    return rows.select(*ID, "section", pos.alias("pos"), F.coalesce("search_matches", F.lit(0)).alias("match_count"), F.when(F.col("section") == "matched", none if match_only else F.col("matches")).alias("matches"))


def bulk_search(files: DataFrame, term: str) -> DataFrame:
    """Every file with its number of matching lines, 0 where none."""
    hits = F.size(F.filter(F.split("content", "\r?\n", -1), lambda x: F.lower(x).contains(term.lower())))
    return files.select(*ID, hits.cast("long").alias("matches"))


def greedy_runs(costs: Column, budget: int) -> Column:
    """array<struct<first, last, cost>> (places from 1) of greedy groups: a new one where the sum would pass the budget and isn't 0.

    The fold appends a group, not an item, so it is linear where groups are long.
    """
    shape = "array<struct<first:int,last:int,cost:bigint>>"
    zero = F.struct(F.lit(0).alias("n"), F.lit(1).alias("first"), F.lit(0).cast("long").alias("used"), F.array().cast(shape).alias("out"))
    closed = lambda acc: F.concat(acc["out"], F.array(F.struct(acc["first"].alias("first"), acc["n"].alias("last"), acc["used"].alias("cost"))))

    def add(acc, cost):
        fresh = (acc["used"] > 0) & (acc["used"] + cost > budget)
        n = acc["n"] + 1
        return F.struct(n.alias("n"), F.when(fresh, n).otherwise(acc["first"]).alias("first"), F.when(fresh, cost).otherwise(acc["used"] + cost).alias("used"), F.when(fresh, closed(acc)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.transform(costs, lambda c: c.cast("long")), zero, add, lambda acc: F.when(acc["n"] > 0, closed(acc)).otherwise(acc["out"]))


def pack(rows: DataFrame, by: list[str], order: str, cost: str, budget: int, name: str = "page") -> DataFrame:
    """rows(by, order, cost) with the greedy group of each, in order within `by`, however many rows there are."""
    out = chains.greedy(rows.select(*by, order, cost), by, [order], F.col(cost), budget)
    return out.select(*by, order, cost, F.col("group").cast("int").alias(name))


def chunks(files: DataFrame, tokens: int = V.CHUNK_TOKENS) -> DataFrame:
    """knowledge_id, relative_path, chunk, start_line, end_line, tokens: lines packed while they fit."""
    costs = F.transform(F.split("content", "\n", -1), lambda x: S.token_len(F.concat(x, F.lit("\n"))))
    runs = files.select(*ID, F.posexplode(greedy_runs(costs, tokens)).alias("pos", "x"))
    return runs.select(*ID, (F.col("pos") + 1).alias("chunk"), F.col("x.first").alias("start_line"), F.col("x.last").alias("end_line"), F.col("x.cost").alias("tokens"))


def batches(rows: DataFrame, group: str, by: str, size: int) -> DataFrame:
    """rows in batches of `size` within each group, in order of `by`."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(by))
    return rows.withColumn("batch", F.floor((nth - 1) / size))


def call_problems(calls: DataFrame, most: tuple = (("metadata", 10), ("bulk", 50)), tokens: tuple[int, int] = (1_000, 50_000)) -> DataFrame:
    """calls(op, n_paths, tokens) with what is wrong with each, null where nothing is."""
    op = F.col("op")
    many = F.lit(False)
    for name, n in most:
        many = many | ((op == name) & (F.col("n_paths") > n))
    problem = F.when(~op.isin("metadata", "content", "bulk"), "unknown op").when(many, "too many paths").when((op == "content") & ~F.col("tokens").between(*tokens), "tokens out of range")
    return calls.withColumn("problem", problem)
