"""Secret scans with an incremental ledger of blobs, with DataFrame expressions only.

Every version of every path is addressed by the SHA-256 of its content. The ledger is a table in the shared folder with
the (blob, rule version) pairs that have been scanned and what was found. A scan reads the contents of those blobs only
for which a pair is missing, each once however many versions hold it, and tries the missing rules only; findings are
joined back to all versions by their address. A rule that changes gets a new version number and is tried on everything
again, the others are not.

Edge cases: a null text is the empty one and holds nothing; repeated rows get the same findings each; an empty table
gives no rows; columns of the versions keep their names and values whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import group_for_join
from .common import discard, fresh_name, stored
from .pii import _let, running_sums

LEDGER = "blob binary, done array<string>, found array<struct<rule:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A pattern for one kind of secret. A pattern or test that changes must get another version number."""

    kind: str
    version: int
    pattern: str
    clues: tuple[str, ...]  # a text without any of them cannot match; compared in lower case if ``any_case``
    base: bool = True
    any_case: bool = False
    valid: Callable[[Column], Column] = lambda found: F.lit(True)

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def possible(self, text: Column) -> Column:
        searched = F.lower(text) if self.any_case else text
        out = F.lit(not self.clues)
        for clue in self.clues:
            out = out | searched.contains(clue)
        return out


ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

# The runs of one class are taken as a whole and begin where the run does, so long runs cost linear time.
RULES = (
    Rule("assign", 1, ASSIGN, ("passw", "secret", "token", "apikey", "api_key"), any_case=True,
         valid=lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", ("AKIA",), valid=lambda m: F.length(m) >= 20),
    # Shorter runs would be matched and dropped.
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}+", ()),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]++-----END [A-Z ]*PRIVATE KEY-----",
         ("PRIVATE KEY-----",), base=False),
    Rule("web_token", 1, r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", ("eyJ",), base=False),
    Rule("forge_token", 1, r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), base=False),
)


def content_address(text: Column) -> Column:
    """The blob's name: the SHA-256 of its UTF-8 bytes, 32 bytes long. A null text has the empty content."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap: array of (start, end, text), in code points, the end exclusive."""

    def place(found: Column) -> Column:
        n = F.size(found)
        before = F.concat(F.array(F.lit("")), F.slice(found, F.lit(1), n - 1))
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), n)
        starts = running_sums(F.zip_with(gaps, before, lambda gap, last: F.length(gap) + F.length(last)))
        return F.zip_with(
            starts, found, lambda at, m: F.struct(at.alias("start"), (at + F.length(m)).alias("end"), m.alias("text"))
        )

    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    found = F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
    return _let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(place(m)))


def _found(rule: Rule, text: Column) -> Column:
    """The rule's valid matches as the ledger keeps them."""

    def row(m: Column) -> Column:
        return F.struct(F.lit(rule.name).alias("rule"), m.start.alias("start"), m.end.alias("end"))

    return F.transform(F.filter(matches(text, rule.pattern), lambda m: rule.valid(m.text)), row)


class BlobLedger:
    """The scanned (blob, rule version) pairs and their findings, a Parquet table at ``path`` in a shared folder.

    A row holds a blob, the rules one scan tried on it, and what they found; a pair is tried once, so a blob has at most
    as many rows as rules have had versions. A scan that fails leaves whole rows or none, and the next one does the rest.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def unseen(self, versions: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
        """(blob, todo): the rules that no scan has tried on a blob, for blobs that have such rules."""
        names = F.array(*[F.lit(rule.name) for rule in rules])
        blobs = versions.select(content_address(F.col(text_col)).alias("blob")).distinct()
        seen = self.rows().groupBy("blob").agg(F.flatten(F.collect_list("done")).alias("done"))
        todo = F.array_except(names, F.coalesce("done", F.array().cast("array<string>")))
        return blobs.join(seen, "blob", "left").select("blob", todo.alias("todo")).filter(F.size("todo") > 0)

    def scan(self, versions: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> None:
        """Try the missing pairs of all versions' contents and add them to the ledger.

        The missing pairs, without contents, are worked out first. If they are few enough to be broadcast, Spark applies
        them before contents are shuffled; else contents are shuffled once, after the copies of a task have become one.
        """
        todo = stored(self.unseen(versions, rules, text_col), "unseen-blobs")
        contents = versions.select(
            content_address(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
        )
        once = contents.dropDuplicates(["blob"]).join(todo.select("blob"), "blob", "left_semi").join(todo, "blob")
        text, none = F.col("text"), F.array().cast("array<struct<rule:string,start:int,end:int>>")
        found = [
            F.when(F.array_contains("todo", rule.name) & rule.possible(text), _found(rule, text)).otherwise(none)
            for rule in rules
        ]
        rows = once.select("blob", F.col("todo").alias("done"), F.concat(none, *found).alias("found"))
        rows.write.mode("append").option("compression", "zstd").parquet(self.path)
        discard(todo)

    def findings(
        self, versions: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", out: str = "secrets"
    ) -> DataFrame:
        """``versions`` with an array of (start, end, kind), by start and then by the order of the rules.

        A column named ``out`` is replaced. Contents that were never scanned have no findings. Blobs without findings
        do not take part in the join, and adaptive execution splits the copies of a blob that many versions share.
        """
        known = {rule.name: (i, rule.kind) for i, rule in enumerate(rules)}
        names = F.array(*[F.lit(name) for name in known])
        kinds = F.array(*[F.lit(kind) for _, kind in known.values()])

        def row(x: Column) -> Column:
            place = F.array_position(names, x.rule)
            kind = F.element_at(kinds, place.cast("int"))
            return F.struct(x.start.alias("start"), place.alias("place"), x.end.alias("end"), kind.alias("kind"))

        def plain(x: Column) -> Column:
            return F.struct(x.start.alias("start"), x.end.alias("end"), x.kind.alias("kind"))

        current = F.filter("found", lambda x: F.array_contains(names, x.rule))
        hits = self.rows().select("blob", current.alias("found")).filter(F.size("found") > 0)
        grouped = group_for_join(hits, ["blob"]).agg(F.flatten(F.collect_list("found")).alias("found"))
        ordered = F.transform(F.array_sort(F.array_distinct(F.transform("found", row))), plain)

        kept = versions.drop(out)
        blob, spans = fresh_name(kept, "blob"), fresh_name(kept, "spans")
        grouped = grouped.select(F.col("blob").alias(blob), ordered.alias(spans))
        joined = kept.withColumn(blob, content_address(F.col(text_col))).join(grouped, blob, "left")
        none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
        return joined.select(*[F.col(f"`{name}`") for name in kept.columns], F.coalesce(spans, none).alias(out))


def _written(spans: Column) -> Column:
    def write(x: Column) -> Column:
        return F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))

    return F.concat_ws(",", F.transform(spans, write))


def secret_report(
    found: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", spans: str = "secrets"
) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of the rows of ``findings``."""
    base = [rule.kind for rule in rules if rule.base]

    def of(*kinds: str) -> Column:
        return F.filter(spans, lambda x: x.kind.isin(*kinds))

    return found.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        *[F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in base],
        F.sha2(_written(of(*base)), 256).alias("base_sha256"),
        _written(F.col(spans)).alias("spans"),
    )


# --- the same in SQL --------------------------------------------------------------------------------------------


def sql(rules: Sequence[Rule] = RULES) -> str:
    """DuckDB SQL for the report: every text by itself, the first group being what a pattern looks back at."""
    look = {
        "assign": "()" + ASSIGN.replace("'", "''"), "access": "()AKIA[A-Z0-9]+", "hex": "()[0-9a-f]+",
        "private_key": r"()-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----",
        "web_token": r"(^|[^A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
        "forge_token": r"(^|[^A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}",
    }
    valid = {"assign": "len(regexp_extract(m, '" + look["assign"] + "', 2)) >= 6", "access": "len(m) >= 20", "hex": "len(m) >= 24"}
    parts = [
        f"""SELECT doc_id, {i} AS place, '{rule.kind}' AS kind, unnest(range(len(found))) + 1 AS k, found[k] AS m,
            list_sum(list_transform(gaps[:k], lambda g: len(g)))::BIGINT
              + coalesce(list_sum(list_transform(found[:k - 1], lambda f: len(f))), 0)::BIGINT
              + len(regexp_extract(m, '{look[rule.kind]}', 1)) AS a,
            list_sum(list_transform(gaps[:k], lambda g: len(g)))::BIGINT
              + list_sum(list_transform(found[:k], lambda f: len(f)))::BIGINT AS b
          FROM (SELECT doc_id, regexp_extract_all(text, '{look[rule.kind]}') AS found,
                  string_split_regex(text, '{look[rule.kind]}') AS gaps FROM texts)"""
        for i, rule in enumerate(rules)
    ]
    kept = " ".join(f"WHEN '{kind}' THEN {test}" for kind, test in valid.items())
    base = ", ".join(f"'{rule.kind}'" for rule in rules if rule.base)
    counts = ", ".join(f"count(*) FILTER (kind = '{rule.kind}') AS n_{rule.kind}" for rule in rules if rule.base)
    written = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place)"
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    found AS ({" UNION ALL ".join(parts)}),
    spans AS (SELECT * FROM found WHERE CASE kind {kept} ELSE true END),
    per_doc AS (
      SELECT doc_id, {counts}, {written} FILTER (kind IN ({base})) AS base, {written} AS spans FROM spans GROUP BY doc_id)
    SELECT d.doc_id, {", ".join(f"coalesce(n_{rule.kind}, 0) AS n_{rule.kind}" for rule in rules if rule.base)},
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM texts d LEFT JOIN per_doc p ON p.doc_id = d.doc_id
    """
