"""Secret scans over an incremental blob ledger.

Every version of a file is addressed by the SHA-256 of its content. The ledger says which blobs were scanned under which
rule versions (a rule's version is a digest of all that defines it), and what was found. A scan looks at those pairs of
blob and rule version alone that the ledger lacks, each once however many paths hold the blob, and the findings are
joined back to all paths. So a new rule is scanned without the old ones, and a new blob without the old blobs.

A rule may name literals without which it cannot match. They are looked for where a text is read; only texts that may
hold a match of a rule still to be scanned cross the network, one per task and blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from operator import or_
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, id_text, join_counted, texts


class Rule(NamedTuple):
    """kind; pattern; group whose length counts, and its least; literals in lower case, of which a match needs one, and a
    pattern that it needs (for Python's and Java's engine alike), either empty if any text may match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    literals: tuple[str, ...] = ()
    needs: str = ""

    @property
    def version(self) -> str:
        return hashlib.sha256(repr(tuple(self)).encode()).hexdigest()[:16]


#: The first three are the base rules and come first in ties.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, ("akia",)),
    Rule("hex", r"[0-9a-f]+", 0, 32, needs="[0-9a-f]{32}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", literals=("private key",)),
    Rule("bearer", r"(?i:bearer)\x20+([A-Za-z0-9._~+/=-]+)", 1, 20, ("bearer",)),
    Rule("url", r"(?<![a-z0-9+.-])[a-z0-9+.-]+://[^\s/:@]+:([^\s/:@]+)@", 1, 3, ("://",)),
)
BASE = ("assign", "access", "hex")
FINDINGS = "array<struct<kind:string,start:int,end:int>>"
KEPT = "array<struct<rule_version:string,start:int,end:int>>"
LEDGER = f"blob binary, rule_versions array<string>, findings {KEPT}"
#: Up to so many unseen blobs (32 bytes each) are broadcast to the texts; beyond it the texts are shuffled by blob.
BROADCAST_BLOBS = 200_000


def find(text: str, rules=RULES) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, by start and then by the order of the rules."""
    out, lower = [], text.lower()
    for order, rule in enumerate(rules):
        if rule.literals and not any(x in lower for x in rule.literals) or rule.needs and not re.search(rule.needs, text, re.ASCII):
            continue
        for m in re.compile(rule.pattern, re.ASCII).finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                out.append((m.start(), order, rule.kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def _may_match(rules) -> Column:
    """(version, ...) array of the rules that the column text may match."""
    found = []
    for rule in rules:
        may = F.lit(True)
        if rule.literals:
            may = reduce(or_, (F.contains("lower", F.lit(x)) for x in rule.literals))
        if rule.needs:
            may = may & F.col("text").rlike(rule.needs)
        found.append(F.when(may, F.lit(rule.version)))
    return F.array_compact(F.array(*found))


def _scan(rules):
    kind = pa.list_(pa.struct([("rule_version", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    version = {rule.kind: rule.version for rule in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, todo in zip(texts(batch), batch.column("todo").to_pylist(), strict=True):
                found.append([{"rule_version": version[k], "start": s, "end": e} for k, s, e in find(text, [r for r in rules if version[r.kind] in todo])])
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(found, kind)], ["blob", "findings"])

    return run


def scan_blobs(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings by path, new ledger rows).

    The first has (doc_id, blob, findings), one row per input row, findings of these rules alone, by start and then by
    the order of the rules. The second has the LEDGER rows to be appended to ``ledger``: blobs that lacked some of the
    rules' versions, those versions, and what they found (most find nothing). Null text is the empty blob; repeated and
    null ids give a row each; equal texts are one blob; other columns are not read. An empty table gives empty results.
    """
    versions = [rule.version for rule in rules]
    docs = id_text(docs, id_col, text_col)
    paths = checkpoint(docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("blob")))
    wanted = F.array(*map(F.lit, versions)) if versions else F.array().cast("array<string>")
    blobs = paths.groupBy("blob").agg(F.count(F.lit(1)).alias("c"))
    if ledger is None:
        todo = blobs.select("blob", wanted.alias("todo"))
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rule_versions")).alias("seen"))
        todo = blobs.join(seen, "blob", "left").select("blob", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
    todo = checkpoint(todo.where(F.size("todo") > 0))
    # Texts that may match a rule; of those with one blob each task sends one.
    reads = docs.select("text", F.lower("text").alias("lower")).select("text", _may_match(rules).alias("may")).where(F.size("may") > 0)
    reads = reads.select(F.unhex(F.sha2("text", 256)).alias("blob"), "text", "may")
    if todo.count() <= BROADCAST_BLOBS:
        reads = reads.join(F.broadcast(todo), "blob").where(F.arrays_overlap("may", "todo")).select("blob", "text", "may")
    reads = reads.groupBy("blob").agg(F.first("text").alias("text"), F.first("may").alias("may"))
    reads = reads.join(todo, "blob").select("blob", "text", F.array_intersect("todo", "may").alias("todo")).where(F.size("todo") > 0)
    hits = reads.mapInArrow(_scan(rules), f"blob binary, findings {KEPT}").where(F.size("findings") > 0)
    new = todo.join(hits, "blob", "left").select("blob", F.col("todo").alias("rule_versions"), F.coalesce("findings", F.array().cast(KEPT)).alias("findings"))
    new = checkpoint(new)
    known = new if ledger is None else new.unionByName(ledger.select("blob", "rule_versions", "findings"))
    known = known.where(F.size("findings") > 0).groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("all"))
    # By start, then by the order of the rules; findings of other rules or versions are left out.
    place = lambda x: F.array_position(wanted, x["rule_version"])
    own = F.transform(F.filter("all", lambda x: place(x) > 0), lambda x: F.struct(x["start"].alias("start"), place(x).alias("order"), x["end"].alias("end")))
    kinds = F.array(*(F.lit(rule.kind) for rule in rules)) if rules else F.array().cast("array<string>")
    ordered = F.transform(F.array_sort(F.array_distinct(own)), lambda x: F.struct(F.get(kinds, x["order"].cast("int") - 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    # Every blob has a row, so that a blob of many paths is joined apart whether it has findings or not.
    known = blobs.join(known.select("blob", ordered.alias("findings")), "blob", "left")
    found = join_counted(paths, known, ["blob"], "c", paths.count())
    return found.select("doc_id", "blob", F.coalesce(F.col("findings").cast(FINDINGS), F.array().cast(FINDINGS)).alias("findings")), new


def digest(found: DataFrame) -> DataFrame:
    """The columns of the op6 contract, from scan_blobs' findings."""
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("findings", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(F.concat_ws(",", F.transform(base, line)), 256).alias("base_sha256"), F.concat_ws(",", F.transform("findings", line)).alias("spans"), F.lower(F.hex("blob")).alias("blob_sha256"))
