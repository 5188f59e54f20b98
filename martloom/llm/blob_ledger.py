"""Secret scans over all versions of files, with a ledger of what has been scanned already.

Every version is addressed by the SHA-256 of its content. The ledger is a folder of generations; a
row of one is a blob, the versions of the rules it was scanned with, and the spans they found. An
update scans only pairs of blob and rule version that no generation has: a copy costs a hash, a
changed rule scans old blobs with that rule alone. Findings are joined back to every path.

All of it is DataFrame expressions. The blobs of a batch meet by content with map-side combining, so
any number of copies sends one text per task at most. Paths of blobs that hold much of the table are
dealt out before the join. A generation counts once its marker is written, so an update that was cut
short leaves nothing behind; one update of a ledger runs at a time.

Defined results: null content is the empty text; null, repeated and further columns of the versions
stay as they are, one row each; equal spans of two rules are both kept, in the order of the rules;
texts of any length are scanned whole, and offsets are in code points; a table without rows gives
none, and its generation is empty.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from martloom.llm.rows import by_place, place
from martloom.operators.joins import deal, hot_keys, join_parent
from martloom.session import drop_scratch, list_folder, path_exists, scratch_path, stage, write_text

# Totals of matches are carried on from block to block, so that a text with very many stays cheap.
BLOCK_MATCHES = 512

SPAN = "struct<start: bigint, end: bigint, kind: string, rule: string>"
GENERATION = f"blob binary, rules array<string>, spans array<{SPAN}>"
DONE = ".done"


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` that do not overlap, if its ``group`` has ``least`` characters; ASCII classes only.

    Texts with a match have, in either case, at least one of the words that the rule ``needs`` (none: not known);
    looking for these is cheaper and changes no result.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    needs: tuple[str, ...] = ()

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The kinds that every scan has.
_NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
BASE = (
    Rule("assign", rf"({_NAMES})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)", 2, 6, ("passw", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]{16,}", needs=("akia",)),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Formats of well-known keys.
FORMATS = (
    Rule("private", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", needs=("-----begin",)),
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]{36,}", needs=("gho_", "ghp_", "ghr_", "ghs_", "ghu_")),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", needs=("xox",)),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs=("eyj",)),
    Rule("login", r"(https?|ftp|ssh|amqp|redis|mysql|mongodb|postgres)://[A-Za-z0-9_.-]{1,64}:([A-Za-z0-9_.!$%&*+=-]{1,128})@", 2, 4, ("://",)),
)
RULES = BASE + FORMATS


def blob_id(content: Column) -> Column:
    """The address of a version: SHA-256 of its bytes."""
    return F.unhex(F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256))


def generations(spark: SparkSession, ledger: str) -> DataFrame:
    """All rows of the ledger."""
    names = [name.removesuffix(DONE) for name, folder in list_folder(spark, ledger) if name.endswith(DONE) and not folder]
    reader = spark.read.schema(GENERATION)
    return reader.parquet(*(f"{ledger}/{n}" for n in names)) if names else spark.createDataFrame([], GENERATION)


def update(versions: DataFrame, ledger: str, content: str = "text", rules: Sequence[Rule] = RULES) -> str:
    """Scan what the ledger lacks for these versions; gives the folder of the new generation."""
    spark, at = versions.sparkSession, place(versions, content)
    texts = by_place(versions).select(F.coalesce(f"c{at}", F.lit("")).alias("text")).select(blob_id(F.col("text")).alias("blob"), "text")
    blobs = texts.groupBy("blob").agg(F.any_value("text").alias("text"))
    wanted = F.array(*(F.lit(r.version) for r in rules))
    known = generations(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))
    missing = F.array_except(wanted, F.coalesce("known", F.array().cast("array<string>")))
    unseen = blobs.join(known, "blob", "left").select("blob", "text", missing.alias("rules")).where(F.size("rules") > 0)
    unseen = unseen.withColumn("folded", F.lower("text"))
    found = [F.when(F.array_contains("rules", r.version) & _may_match(r), spans(F.col("text"), r)) for r in rules]
    none = F.array().cast(f"array<{SPAN}>")
    row = F.concat(*(F.coalesce(f, none) for f in found)) if rules else none
    name = f"gen-{uuid.uuid4().hex}"
    unseen.select("blob", "rules", row.alias("spans")).write.parquet(f"{ledger}/{name}")
    write_text(spark, f"{ledger}/{name}{DONE}", "")
    return f"{ledger}/{name}"


def _may_match(rule: Rule) -> Column:
    words = [F.contains("folded", F.lit(w)) for w in rule.needs]
    pattern = F.col("text").rlike(rule.pattern)
    return reduce(or_, words) & pattern if words else pattern


def spans(text: Column, rule: Rule) -> Column:
    """The spans of a rule in a text: lengths of its matches and of what lies between them, summed up."""
    pattern = F.lit(rule.pattern)
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m).cast("bigint"))
    measured = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g).cast("bigint"))
    steps = F.zip_with(gaps, sizes, lambda g, s: g + F.coalesce(s, F.lit(0)))  # the text behind the last match has no size
    rows = F.arrays_zip(running_totals(steps).alias("end"), sizes.alias("size"), measured.alias("measured"))
    kept = F.filter(rows, lambda r: r["measured"] >= rule.least)
    made = F.transform(kept, lambda r: F.struct(r["end"] - r["size"], r["end"], F.lit(rule.kind), F.lit(rule.version)))
    return made.cast(f"array<{SPAN}>")


def running_totals(numbers: Column) -> Column:
    """Running totals of an array, first within blocks and then over the totals of the blocks."""

    def of_blocks(n: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(n), F.lit(1)), F.lit(BLOCK_MATCHES))
        return _bound(F.transform(starts, lambda at: _totals(F.slice(n, at, BLOCK_MATCHES))), joined)

    def joined(blocks: Column) -> Column:
        after = _totals(F.transform(blocks, _last))
        return F.flatten(F.zip_with(blocks, after, lambda b, total: F.transform(b, lambda x: x + total - _last(b))))

    return _bound(numbers, of_blocks)


def _totals(numbers: Column) -> Column:
    none = F.array().cast("array<bigint>")
    return F.aggregate(numbers, none, lambda done, x: F.concat(done, F.array(x + _last(done))))


def _last(numbers: Column) -> Column:
    return F.coalesce(F.get(numbers, F.size(numbers) - 1), F.lit(0).cast("bigint"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def findings(versions: DataFrame, ledger: str, content: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The columns of every version but its content, with ``blob`` and ``spans`` (by start, then in the order of the rules)."""
    spark, at = versions.sparkSession, place(versions, content)
    plain = by_place(versions)
    addressed = plain.select(*(c for i, c in enumerate(plain.columns) if i != at), blob_id(F.col(f"c{at}")).alias("blob"))
    paths = deal(stage(addressed, "paths"))
    wanted = F.array(*(F.lit(r.version) for r in rules)).cast("array<string>")
    here = F.filter("spans", lambda s: F.array_contains(wanted, s["rule"]))
    own = generations(spark, ledger).select("blob", here.alias("spans")).where(F.size("spans") > 0)
    own = own.groupBy("blob").agg(_ordered(F.flatten(F.collect_list("spans")), wanted).alias("spans"))
    # the sketch only decides which paths are dealt out; the rows with one content are never gathered
    joined = join_parent(paths, own, ["blob"], ["blob"], "left", hot_keys(paths, [["blob"]]).get(("blob",), {}), "own")
    kept = [F.col(f"child.{c}") for c in addressed.columns]
    names = [c for i, c in enumerate(versions.columns) if i != at]
    none = F.array().cast(f"array<{SPAN}>")
    return joined.select(*kept, F.coalesce("own.spans", none).alias("spans")).toDF(*names, "blob", "spans")


def _ordered(found: Column, wanted: Column) -> Column:
    keyed = F.transform(found, lambda s: F.struct(s["start"], F.array_position(wanted, s["rule"]), s["end"].alias("end"), s["kind"].alias("kind"), s["rule"].alias("rule")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"], s["end"], s["kind"], s["rule"])).cast(f"array<{SPAN}>")


def scan(versions: DataFrame, ledger: str, content: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Bring the ledger up to date with the versions and give the findings of each."""
    update(versions, ledger, content, rules)
    return findings(versions, ledger, content, rules)


def new_ledger(spark: SparkSession) -> str:
    """A ledger of its own in the shared folder."""
    return scratch_path(spark, "ledger")


def drop_ledger(spark: SparkSession, ledger: str) -> None:
    if path_exists(spark, ledger):
        drop_scratch(spark, ledger)


def text_of(spans_: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
