"""Line deduplication with a log-template tree, in DataFrame operations only.

A line is parsed down a tree of fixed depth: by its number of tokens, then by its leading tokens, with tokens that hold
a digit replaced by a wildcard. What reaches one leaf is generalised: of a line's further tokens those that recur most
at their position among the distinct lines of the leaf are kept, so many that with the leading ones a share SIMILAR of
the line stays (in a tie those further left); the others become wildcards. The kept tokens with their positions are the
line's template, so a leaf has as many templates as its lines need, and the lines of one agree in at least that share
of their tokens. A template that recurs across documents is kept where it first occurs (least document, then least
line) and dropped everywhere else. Lines of few tokens, scripts without blanks among them, are templates as they stand:
they count as repeats word for word only.

Work is linear in the lines and their tokens: no lines are compared with each other. Every count is a partial aggregate
before its shuffle, joins take their hot keys apart (``join_counted``), and text crosses the network by document, never
by leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_counted

#: Tokens of the tree's path, least tokens of a line that is generalised, share of tokens that must agree.
DEPTH, LEAST, SIMILAR = 5, 4, 0.7
WILD = "<*>"
#: Up to so many lines (some 40 bytes each) that need a closer look are broadcast to the scan of the texts.
BROADCAST_LINES = 1_000_000
NO_ID, SHORT = 2**63 - 1, 0
BLANK = " "


def _masked(tokens: Column) -> Column:
    return F.regexp_replace(tokens, r"\S*[0-9]\S*", WILD)


def _text(text: str | Column) -> Column:
    return F.coalesce(text.cast("string") if isinstance(text, Column) else F.col(f"`{text}`").cast("string"), F.lit(""))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, t, row): a document is its id and the hash of its text; row holds all columns of docs, whatever their names."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(_text(text_col)).alias("t"), whole.alias("row"))


def dropped_lines(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, similar: float = SIMILAR) -> DataFrame:
    """(d, t, drops: sorted array of line numbers from 0) of documents that lose lines; docs has d, t and text."""
    lines = docs.select("d", "t", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    count = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(BLANK), F.lit(""))) + 1
    lines = lines.withColumn("n", count).where((F.col("n") >= least) | F.col("line").rlike(r"\S"))
    # Lines that are too short to be generalised share one leaf, which is looked at line by line.
    leaf = F.when(F.col("n") >= least, F.xxhash64("n", _masked(F.substring_index("line", BLANK, depth)))).otherwise(SHORT)
    # Tokens that must be kept beyond the path; all lines of a leaf agree on the path.
    more = F.greatest(F.ceil(F.col("n") * F.lit(similar) - 1e-9) - depth, F.lit(0)).cast("int")
    places = checkpoint(lines.select("d", "t", "i", leaf.alias("leaf"), F.xxhash64("line").alias("lh"), more.alias("more")))
    doc, place = F.struct("d", "t"), F.struct("d", "t", "i")
    same = places.groupBy("leaf", "lh", "more").agg(F.min(place).alias("first"), F.max(doc).alias("last"), F.count(F.lit(1)).alias("c"))
    same = checkpoint(same.select("leaf", "lh", "more", "first", "last", "c"))
    total = int(same.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    # Only leaves that several documents reach can hold a template that recurs.
    leaves = same.where(F.col("leaf") != SHORT).groupBy("leaf")
    shared = leaves.agg(F.min(F.struct("first.d", "first.t")).alias("lo"), F.max("last").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi and c > 1").select("leaf", "c")
    several = checkpoint(join_counted(same.where(F.col("leaf") != SHORT).withColumnRenamed("c", "places"), shared, ["leaf"], "c", total).drop("c"))
    kept = _kept_tokens(docs, several.where("more > 0"), depth)
    # (leaf, lh, template): the path alone where it is long enough, else the path and what is kept beyond it.
    pathed = several.where("more = 0").select("leaf", "lh", F.lit(0).cast("long").alias("template"), "first", "last", "places")
    templated = checkpoint(pathed.unionByName(several.join(kept, ["leaf", "lh"]).select("leaf", "lh", "template", "first", "last", "places")))
    groups = templated.groupBy("leaf", "template").agg(F.min("first").alias("from"), F.max("last").alias("to"), F.count(F.lit(1)).alias("c")).where("from.d <> to.d or from.t <> to.t").select("leaf", "template", "from", "c")
    found = join_counted(templated, groups, ["leaf", "template"], "c", total).select("leaf", "lh", "from", F.col("places").alias("c"))
    # Lines without a template that recurs may still recur word for word.
    exact = same.where("first.d <> last.d or first.t <> last.t").join(found.select("leaf", "lh"), ["leaf", "lh"], "left_anti").select("leaf", "lh", F.col("first").alias("from"), "c")
    gone = checkpoint(found.unionByName(exact))
    lost = join_counted(places.select("d", "t", "i", "leaf", "lh"), gone, ["leaf", "lh"], "c", total).where(place != F.col("from"))
    return lost.groupBy("d", "t").agg(F.array_sort(F.collect_set("i")).alias("drops"))


def _kept_tokens(docs: DataFrame, lines: DataFrame, depth: int) -> DataFrame:
    """(leaf, lh, template) of those lines whose kept tokens all recur; template is a hash of positions and tokens."""
    todo = checkpoint(lines.groupBy(F.col("first.d").alias("d"), F.col("first.t").alias("t")).agg(F.collect_list(F.struct(F.col("first.i").alias("i"), "leaf", "lh", "more")).alias("todo")))
    if todo.agg(F.coalesce(F.sum(F.size("todo")), F.lit(0))).first()[0] <= BROADCAST_LINES:
        todo = F.broadcast(todo)  # else both sides are shuffled by document
    # Path tokens are equal in all lines of a leaf, so only what follows the path is counted.
    texts = docs.select("d", "t", "text").join(todo, ["d", "t"]).select("todo", F.split("text", "\n", -1).alias("lines"))
    rest = lambda x: F.transform(F.slice(F.split(F.element_at("lines", x["i"] + 1), BLANK, -1), depth + 1, 2**30), lambda y: F.xxhash64(_masked(y)))
    found = texts.select(F.explode(F.transform("todo", lambda x: F.struct(x["leaf"].alias("leaf"), x["lh"].alias("lh"), x["more"].alias("more"), rest(x).alias("tokens")))).alias("x")).select("x.*")
    # Rows that repeat id and text bring a line twice.
    found = checkpoint(found.groupBy("leaf", "lh", "more").agg(F.min("tokens").alias("tokens")))
    tokens = found.select("leaf", "lh", "more", F.posexplode("tokens").alias("p", "tok"))
    counted = tokens.groupBy("leaf", "p", "tok").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    total = int(found.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0])
    best = join_counted(tokens, counted, ["leaf", "p", "tok"], "c", total).groupBy("leaf", "lh", "more").agg(F.collect_list(F.struct((-F.col("c")).alias("c"), "p", "tok")).alias("found"))
    kept = F.array_sort(F.transform(F.slice(F.array_sort("found"), 1, F.col("more")), lambda x: F.struct(x["p"].alias("p"), x["tok"].alias("tok"))))
    return best.where("size(found) >= more").select("leaf", "lh", F.xxhash64(kept).alias("template"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, least: int = LEAST, similar: float = SIMILAR) -> DataFrame:
    """docs with the text of its kept lines, and n_lines and n_dropped; every row stays, though its text may be empty.

    Lines of fewer than ``least`` tokens go only where they repeat another document's word for word; blank ones of so
    few tokens always stay. Null text counts as empty (one empty line). A null id counts as the largest; rows that
    repeat id and text are one document. Ties between tokens go to those further left, between places to the least
    document and line. Further columns pass through, whatever their names; columns named n_lines or n_dropped are
    replaced. An empty table gives an empty result.
    """
    keyed = _keyed(docs, id_col, text_col)
    drops = dropped_lines(docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(_text(text_col)).alias("t"), _text(text_col).alias("text")), depth, least, similar)
    # The numbers with what stands before the first line and after any last one: between two of them all lines stay.
    drops = drops.select("d", "t", F.size("drops").cast("long").alias("n"), F.concat(F.array(F.lit(-1)), "drops", F.array(F.lit(2**30))).alias("cuts"))
    found = keyed.join(drops, ["d", "t"], "left").select("row", "n", "cuts", F.split(_text(F.col("row")[text_col]), "\n", -1).alias("lines"))
    runs = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda k: F.slice("lines", F.get("cuts", k - 1) + 2, F.get("cuts", k) - F.get("cuts", k - 1) - 1))
    kept = F.when(F.col("cuts").isNull(), _text(F.col("row")[text_col])).otherwise(F.array_join(F.flatten(runs), "\n"))
    made = {text_col: kept, "n_lines": F.size("lines").cast("long"), "n_dropped": F.coalesce("n", F.lit(0).cast("long"))}
    return found.select(*(made.get(c, F.col("row")[c]).alias(c) for c in [*docs.columns, *(c for c in ("n_lines", "n_dropped") if c not in docs.columns)]))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: Lines as lists of tokens, ranked and compared as such: no hashes, no shared leaves, no pass per kind of line.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l0 AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS line FROM d),
l AS (SELECT *, length(line) - length(replace(line, ' ', '')) + 1 AS n FROM l0 WHERE length(line) - length(replace(line, ' ', '')) >= 3 OR regexp_matches(line, '\S')),
distinct_lines AS (SELECT DISTINCT line, n FROM l WHERE n >= 4),
tokens AS (SELECT line, n, unnest(range(n)) AS p, unnest(list_transform(string_split(line, ' '), lambda x: regexp_replace(x, '\S*[0-9]\S*', '<*>', 'g'))) AS tok FROM distinct_lines),
paths AS (SELECT line, n, array_to_string(list(tok ORDER BY p) FILTER (p < 5), ' ') AS path FROM tokens GROUP BY line, n),
counted AS (SELECT *, count(*) OVER (PARTITION BY n, path, p, tok) AS c FROM tokens JOIN paths USING (line, n)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY (p < 5) DESC, c DESC, p) AS r FROM counted),
templates AS (SELECT line, n, path, list((p, tok) ORDER BY p) AS template FROM ranked WHERE r <= greatest(ceil(0.7 * n - 1e-9), 5) GROUP BY line, n, path),
placed AS (SELECT doc_id, i, CASE WHEN n >= 4 THEN CAST(n AS VARCHAR) || '|' || path || '|' || CAST(template AS VARCHAR) ELSE '=' || line END AS key
           FROM l LEFT JOIN templates USING (line, n)),
firsts AS (SELECT key, min((doc_id, i)) AS f FROM placed GROUP BY key HAVING min(doc_id) <> max(doc_id)),
gone AS (SELECT doc_id, i FROM placed JOIN firsts USING (key) WHERE (doc_id, i) <> f)
SELECT d.doc_id, CAST(len(a) AS BIGINT) AS n_lines, CAST(coalesce(len(g.x), 0) AS BIGINT) AS n_dropped,
       sha256(array_to_string(CASE WHEN g.x IS NULL THEN a ELSE list_filter(a, lambda v, k: NOT list_contains(g.x, k - 1)) END, chr(10))) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, list(i) AS x FROM gone GROUP BY doc_id) g USING (doc_id)
"""
