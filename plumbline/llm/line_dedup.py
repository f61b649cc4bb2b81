"""Line de-duplication by a log-template tree, in DataFrame functions only.

Every line is parsed to a fixed depth: its token count (tokens end at a space), then its three leading tokens. Tokens that
hold a digit are variable fields at once. Below such a leaf, a line of eight tokens or more belongs to
two templates: the one that keeps the first half of its remaining tokens and generalises the
second half, and the one that keeps the second half and generalises the first. Shorter lines
have one template, all their tokens. So two lines of a leaf share a template if at least half of
what follows the leading tokens agrees, wherever the variable fields lie in the other half.

A template is recurring if ``min_docs`` different texts or more have it: exact copies of one text are one, so a document is not taken
for boilerplate because it was copied as a whole. Lines of recurring templates are always dropped, however much of a document they make up;
with ``keep_first`` the document of least id that has a template keeps its lines, so that of near copies one stays.

Templates and texts are told apart by 64-bit hashes. The lines of a very common template are dealt over many tasks.

Defined results for odd input: a null text stays null with no lines; an empty text has one blank line;
blank lines are never templates and stay. A text all of whose lines go is empty. Every row is returned; rows with the
same id and text lose the same lines, and null or repeated ids do no harm, as the text tells rows apart too. Other columns pass through untouched,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import free, materialize, spread
from plumbline.llm.spans import once

LEADING = 3
SHORT = 8
MIN_DOCS = 3
#: A token that holds a digit, matched from its first character so that long tokens stay linear.
VARIABLE = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"


def _tokens(line: Column) -> Column:
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, VARIABLE, "<*>")).otherwise(line)
    return F.split(F.trim(masked), " ")


def _templates(tokens: Column) -> Column:
    """Hashes of the templates of one line; none if it is blank."""
    count = F.size(tokens)
    lead = F.slice(tokens, 1, LEADING)
    rest = F.slice(tokens, LEADING + 1, F.greatest(count - LEADING, F.lit(0)))
    half = F.floor((count - LEADING) / 2).cast("int")
    first = F.xxhash64(F.lit("first"), count, lead, F.slice(rest, F.lit(1), half))
    second = F.xxhash64(F.lit("second"), count, lead, F.slice(rest, half + 1, count - LEADING - half))
    blank = (count == 1) & (tokens[0] == "")
    return F.when(blank, F.array().cast("array<bigint>")).when(count < SHORT, F.array(F.xxhash64(F.lit("all"), count, tokens))).otherwise(F.array(first, second))


def line_templates(docs: DataFrame) -> DataFrame:
    """Of each row: doc and digest (which tell documents apart) and lines, the templates of each line."""
    lines = F.transform(F.split("text", "\n"), _tokens)
    return docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("digest"), F.transform(lines, _templates).alias("lines"))


def recurring(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Templates that ``min_docs`` different texts or more have, the least id among their documents and the lines that have them."""
    # equal texts meet as one row for each task at most
    texts = lines.groupBy("digest").agg(F.first("lines").alias("lines"), F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"))
    # the outer form keeps Spark from evaluating the array once more to filter out empty ones
    each = texts.select("digest", "doc", "copies", F.explode_outer(F.flatten("lines")).alias("template")).where(F.col("template").isNotNull())
    own = each.groupBy("template", "digest").agg(F.first("doc").alias("doc"), F.sum("copies").alias("rows"))
    found = own.groupBy("template").agg(F.count(F.lit(1)).alias("texts"), F.min("doc").alias("first"), F.sum("rows").alias("rows"))
    return found.where(F.col("texts") >= min_docs).drop("texts")


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """``docs`` with recurring lines cut out of ``text``, and __n_lines, __n_dropped (with more underscores behind if ``docs`` has such columns)."""
    found = materialize(line_templates(docs))
    often = materialize(recurring(found, min_docs))
    lines = found.select("doc", "digest", F.posexplode_outer("lines").alias("line", "templates"))
    lines = lines.select("doc", "digest", "line", F.explode_outer("templates").alias("template")).where(F.col("template").isNotNull())
    hit = spread(lines, often.drop("rows"), "template", often)
    if keep_first:
        hit = hit.where(~F.col("doc").eqNullSafe(F.col("first")))
    hit = hit.groupBy(F.col("doc").alias("hit_doc"), F.col("digest").alias("hit_digest")).agg(F.collect_set("line").alias("gone"))
    # the caller's row is one column, so no name in it can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row.text")
    rows = rows.join(hit, F.col("row.doc_id").eqNullSafe(F.col("hit_doc")) & (F.xxhash64(text) == F.col("hit_digest")), "left")
    parts = F.split(text, "\n")
    # a hash set of what goes, and the lines looked up by number: time in proportion to the lines, however many go
    kept = once(parts, lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("gone")), lambda i: F.get(p, i)), "\n"))
    own = [F.when(F.col("gone").isNotNull(), kept).otherwise(text).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long")
    return rows.select(*own, n_lines.alias(free(docs, "__n_lines")), F.when(F.col("gone").isNotNull(), F.size("gone")).otherwise(0).cast("long").alias(free(docs, "__n_dropped")))
