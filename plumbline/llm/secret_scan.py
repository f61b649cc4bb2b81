"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every historical version of every path is content-addressed by the SHA-256 of its text, so equal
versions are one blob. The ledger holds, for each blob and rule version scanned so far, the spans found. A scan looks up by address
which rule versions each blob lacks, before any text moves, runs only those, appends them to the ledger, and joins the spans of the current rules back to all paths.
Blobs meet their texts through map-side aggregation, so a text with very many copies moves once for each task at most; paths of a very common blob are dealt over many tasks.

Base rules are ``assign``, ``access`` and ``hex``; the rest of ``RULES`` adds spans of further kinds.

Defined results for odd input: a null text is the blob of the empty text and has no spans. Repeated rows are paths of one blob and each is
returned. Null ids are returned. A blob without spans is in the ledger with empty spans, so it is not scanned again. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import spans as S
from plumbline.llm.common import materialize, spread
from plumbline.llm.spans import Rule

# The patterns of the rules.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{32,}+"
PRIVATE_KEY = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
WEB_TOKEN = r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
HOST_TOKEN = r"gh[pousr]_[A-Za-z0-9]{36,}+"
CHAT_TOKEN = r"xox[abprs]-[A-Za-z0-9-]{10,}+"


def _always(_: Column) -> Column:
    return F.lit(True)


BASE = [
    Rule("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 8, lambda t: t.contains(":") | t.contains("=")),
    Rule("access", ACCESS, lambda m: F.length(m) >= 16, lambda t: t.contains("AKIA")),
    Rule("hex", HEX, _always, lambda t: t.rlike("[0-9a-f]{32}")),
]
RULES = [
    *BASE,
    Rule("private_key", PRIVATE_KEY, _always, lambda t: t.contains("-----BEGIN ")),
    Rule("web_token", WEB_TOKEN, _always, lambda t: t.contains("eyJ")),
    Rule("host_token", HOST_TOKEN, _always, lambda t: t.rlike("gh[pousr]_")),
    Rule("chat_token", CHAT_TOKEN, _always, lambda t: t.contains("xox")),
]
LEDGER = f"blob string, rule string, spans {S.SPAN}"
#: Unseen blobs up to which their addresses are broadcast, so that no other text moves; a hundred bytes each at most.
FEW = 100_000


class Ledger:
    """A folder of Parquet parts to which every scan appends; an absent folder is an empty ledger."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def append(self, new: DataFrame) -> None:
        new.select("blob", "rule", "spans").write.mode("append").parquet(self.path)


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def unseen(blobs: DataFrame, ledger: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """blob, todo: the rule versions that ``ledger`` lacks of each of ``blobs`` that lacks some. No text is read for it."""
    wanted = F.array(*[F.lit(r.name) for r in rules])
    seen = ledger.where(F.col("rule").isin([r.name for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.select("blob").join(seen, "blob", "left").select("blob", todo.alias("todo")).where(F.size("todo") > 0)


def scan(versions: DataFrame, todo: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Ledger rows (blob, rule, spans) of the pairs in ``todo`` (written; blob, todo) over texts in ``versions`` (column text)."""
    rows = versions.select(address(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    if todo.count() <= FEW:
        rows = rows.join(F.broadcast(todo.select("blob")), "blob", "left_semi")
    # copies meet as one row for each task at most
    blobs = rows.groupBy("blob").agg(F.first("text").alias("text")).join(todo.hint("merge"), "blob")
    found = [F.struct(F.lit(r.name).alias("rule"), F.when(F.array_contains("todo", r.name), S.find(F.col("text"), r, k)).alias("spans")) for k, r in enumerate(rules)]
    return blobs.select("blob", F.explode(F.array(*found)).alias("f")).select("blob", "f.rule", "f.spans").where(F.col("spans").isNotNull())


def findings(paths: DataFrame, counts: DataFrame, ledger: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``paths`` (with a column blob) with __spans, the spans of the current rules in the ledger; ``counts`` are the rows of each blob, written."""
    own = ledger.where(F.col("rule").isin([r.name for r in rules]))
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)])
    # one row for each rule of a blob meets here; a pair that two scans at once have added counts once
    own = own.where(F.size("spans") > 0).groupBy("blob", "rule").agg(F.first("spans").alias("spans"))
    whole = own.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("__spans"))
    whole = whole.withColumn("__spans", F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("kind_order"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return spread(paths, whole, "blob", counts, "left").withColumn("__spans", F.coalesce("__spans", F.array().cast(S.SPAN)))


def report(docs: DataFrame, ledger: Ledger, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, blob, __spans of every row, after a scan of what ``ledger`` lacks, which is appended to it."""
    paths = docs.select("doc_id", address(F.col("text")).alias("blob"))
    counts = materialize(paths.groupBy("blob").agg(F.count(F.lit(1)).alias("rows")))
    todo = materialize(unseen(counts, ledger.rows(), rules))
    if todo.head(1):
        ledger.append(scan(docs, todo, rules))
    return findings(paths, counts, ledger.rows(), rules)
