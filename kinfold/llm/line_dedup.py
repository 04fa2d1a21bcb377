"""Line dedup with a log-template tree, in DataFrame operations only.

Tree: a line's path is its token count, then its first ``LEAD`` tokens, then its template. Tokens with a digit are
variable fields (``<*>``) everywhere. A line stands under one template for each third of the tokens behind the lead that
is not empty, with that third generalised, so lines that differ in one such field share a node; a line of no more tokens
than the lead, or of ``LONG_WORDS`` or more, also stands under its own words. Nodes are known by 64-bit hashes.

Which templates recur is decided in two passes. First, a line is *shared* if a node of it, its first ``EDGE`` tokens or its
last ``EDGE`` tokens are also in another text, and what is left of a text is its own. Then the witnesses of a template are
counted: distinct texts that have it and, of their lines besides it, one in ``OWN`` or more of their own. Copies, exact or
near, have little of their own and bear no witness, but neither do they speak against a template; texts that have
several recurring lines bear witness to each. A template recurs from ``min_docs`` witnesses on; word for word and of
``LONG_WORDS`` or more from ``LONG_DOCS`` on, of whose other lines half or more are their own. Its lines are dropped from
every text.

The text is parsed once, into the hashes of its lines' nodes. Counting these leaves the nodes that texts share, and only
their lines go on. Counts are partial aggregates; no template's lines meet in one task. What a document loses depends on
its text alone, so decisions are joined by two hashes of the text (96 bits), as a join of two plain exchanges, whatever
the size: a group of copies that holds a third of all rows is split by Spark's adaptive skew join.

Defined results: a null text stays null and an empty one empty (0 lines counted and dropped); blank lines have no
template and stay. A document that loses every line stays as a row with an empty text. Rows with null or repeated
doc_ids are each cleaned by their own text. Further columns are kept as they are, whatever their names (only names
that begin with ``__ld_`` are reserved). An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.plans.storage import materialize, release

LEAD, PARTS = 2, 3
EDGE = 8
MIN_DOCS = 10
#: One line in so many has to be a text's own: for a witness, and for one to a long template.
OWN, LONG_OWN = 5, 2
#: A template of so many words recurs, word for word, from so few texts on.
LONG_WORDS, LONG_DOCS = 50, 2
_TEXT = ["t1", "t2"]


def template(line: Column) -> Column:
    """The line with tokens that hold a digit as ``<*>``. The look-behind and possessive repeats keep it linear."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(line)


def _text_id(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.hash(text).alias("t2")]


def _border(part: int) -> str:
    """Number of the tokens before a third."""
    return f"{LEAD} + (greatest(n - {LEAD}, 0) * {part}) div {PARTS}"


def _lines(docs: DataFrame) -> DataFrame:
    """``t1, t2, line, total, n, nodes``: one row a line that is not blank, with its nodes (``PARTS`` wider ones, its own
    words) and then its edges; the parts of a line are hashed once and their hashes combined."""
    once = F.struct(*_text_id(F.col("text")), F.split("text", "\n").alias("lines"))
    # Without this generator the hashes of the text would be computed again for each of its lines.
    texts = docs.where("text <> ''").select(F.explode(F.array(once)).alias("x")).select("x.*")
    full = texts.select(F.explode(F.array(F.struct(*_TEXT, "lines", F.size(F.filter("lines", lambda x: F.trim(x) != "")).alias("total")))).alias("x")).select("x.*")
    split = full.select(*_TEXT, "total", F.posexplode("lines").alias("line", "raw"))
    masked = split.where("trim(raw) <> ''").select(*_TEXT, "line", "total", template(F.col("raw")).alias("masked"))
    words = masked.select(*_TEXT, "line", "total", F.split("masked", " ").alias("w"))
    sized = words.select(*_TEXT, "line", "total", "w", F.size("w").alias("n"))
    parts = [F.expr(f"xxhash64(slice(w, cast({_border(i)} as int) + 1, cast({_border(i + 1)} - ({_border(i)}) as int))) as p{i}") for i in range(PARTS)]
    hashed = sized.select(*_TEXT, "line", "total", "n", F.expr(f"xxhash64(slice(w, 1, {LEAD})) as lead"), F.expr(f"xxhash64(-2, slice(w, 1, {EDGE})) as head"), F.expr(f"xxhash64(-3, slice(w, greatest(n - {EDGE - 1}, 1), {EDGE})) as tail"), *parts)
    wider = [F.when(F.expr(f"{_border(i + 1)} > {_border(i)}"), F.xxhash64(F.lit(i), "n", "lead", *(f"p{j}" for j in range(PARTS) if j != i))) for i in range(PARTS)]
    own = F.when((F.col("n") <= LEAD) | (F.col("n") >= LONG_WORDS), F.xxhash64(F.lit(-1), "n", "lead", *(f"p{j}" for j in range(PARTS))))
    return hashed.select(*_TEXT, "line", "total", "n", F.array(*wider, own, "head", F.when(F.col("n") > EDGE, F.col("tail"))).alias("nodes"))


def _decided(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Lines with a shared node (``t1, t2, line, total, n, at, node``), and the nodes that recur (with ``texts, witnesses``)."""
    long = (F.col("at") == PARTS) & (F.col("n") >= LONG_WORDS)
    lines = materialize(_lines(docs), "lines")
    every = lines.select(*_TEXT, "line", "total", "n", F.posexplode("nodes").alias("at", "node")).where("node is not null")
    shared = materialize(every.groupBy("node").agg(F.min("t1").alias("lo"), F.max("t1").alias("hi")).where("lo <> hi").select("node"), "nodes")
    found = materialize(every.join(shared, "node"), "shared")
    release(lines, shared)
    own = found.groupBy(*_TEXT).agg((F.max("total") - F.count_distinct("line")).alias("own"))
    texts = found.where(F.col("at") <= PARTS).groupBy("node", *_TEXT).agg(F.count_distinct("line").alias("lines"), F.max("total").alias("total"), F.max(long).alias("long"))
    rest = F.col("total") - F.col("lines")
    judged = texts.join(own, _TEXT).select("node", "long", ((F.col("own") > 0) & (OWN * F.col("own") >= rest)).alias("some"), ((F.col("own") > 0) & (LONG_OWN * F.col("own") >= rest)).alias("most"))
    counted = judged.groupBy("node").agg(F.max("long").alias("long"), F.count("*").alias("texts"), F.count_if("some").alias("witnesses"), F.count_if("most").alias("strict"))
    recurring = counted.where((F.col("witnesses") >= min_docs) | (F.col("long") & (F.col("strict") >= LONG_DOCS))).select("node", "texts", "witnesses")
    return found, materialize(recurring, "recurring")


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``t1, t2, lines``: of each distinct text (by its two hashes) the numbers of the lines to drop, from 0."""
    found, recurring = _decided(docs, min_docs)
    dropped = materialize(found.join(recurring.select("node"), "node", "left_semi").groupBy(*_TEXT).agg(F.collect_set("line").alias("lines")), "dropped")
    release(found, recurring)
    return dropped


def recurring_templates(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The part of the tree that recurs: ``n_tokens, lead, template, texts, witnesses``, one row a node."""
    found, recurring = _decided(docs, min_docs)
    first = found.join(recurring, "node").groupBy("node", "texts", "witnesses").agg(F.min(F.struct(*_TEXT, "line", "at")).alias("f")).select("texts", "witnesses", "f.*")
    lines = docs.where("text <> ''").select("text", *_text_id(F.col("text"))).join(first, _TEXT).dropDuplicates([*_TEXT, "line", "at"])
    words = lines.select("texts", "witnesses", "at", F.split(template(F.expr("split(text, '\n')[line]")), " ").alias("w")).withColumn("n", F.size("w"))
    for i in range(PARTS):
        cut = F.expr(f"concat(slice(w, 1, cast({_border(i)} as int)), array('<*>'), slice(w, cast({_border(i + 1)} as int) + 1, n))")
        words = words.withColumn(f"t{i}", cut)
    shown = F.coalesce(*(F.when(F.col("at") == i, F.col(f"t{i}")) for i in range(PARTS)), F.col("w"))
    return words.select(F.col("n").alias("n_tokens"), F.array_join(F.slice("w", 1, LEAD), " ").alias("lead"), F.array_join(shown, " ").alias("template"), "texts", "witnesses")


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, counts: bool = False) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``; with ``counts``, also ``n_lines`` and ``n_dropped``."""
    # Never a broadcast: lists of lines take many times the stored bytes by which Spark would choose one.
    dropped = recurring_lines(docs, min_docs).select(*(F.col(c).alias(f"__ld_{c}") for c in [*_TEXT, "lines"])).hint("merge")
    joined = docs.withColumns({f"__ld_{c}": x for c, x in zip(_TEXT, _text_id(F.col("text")), strict=True)}).join(dropped, [f"__ld_{c}" for c in _TEXT], "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__ld_lines", i)), "\n")
    text = F.when(F.col("__ld_lines").isNull(), F.col("text")).otherwise(kept)
    extra = [F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.coalesce(F.size("__ld_lines"), F.lit(0)).cast("long").alias("n_dropped")]
    return joined.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns), *(extra if counts else []))


def report(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text_sha256`` (of what is left; null text: as empty)."""
    cleaned = drop_recurring_lines(docs.select("doc_id", "text"), min_docs, counts=True)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def cleaned_sql(source: str = "documents", min_docs: int = MIN_DOCS) -> str:
    """DuckDB SQL for the rows of ``source`` with ``clean`` text, ``n_lines`` and ``n_dropped``."""
    wider = " UNION ALL ".join(
        f"""SELECT th, line, n, false AS own, concat({p}, ' ', n, ' ', array_to_string(k[1:b], ' '), chr(10), array_to_string(k[e+1:n], ' ')) AS node FROM
        (SELECT *, {LEAD} + ((n - {LEAD}) * {p}) // {PARTS} AS b, {LEAD} + ((n - {LEAD}) * {p + 1}) // {PARTS} AS e FROM t WHERE n > {LEAD}) WHERE b < e"""
        for p in range(PARTS)
    )
    return f"""WITH s AS (SELECT row_number() OVER () AS r, * FROM {source}),
    x AS (SELECT DISTINCT md5(text) AS th, text FROM s WHERE text IS NOT NULL),
    m AS (SELECT th, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM x),
    t AS (SELECT th, line, string_split(masked, ' ') AS k, len(string_split(masked, ' ')) AS n, masked
      FROM (SELECT th, line, regexp_replace(raw, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS masked FROM m WHERE trim(raw, ' ') <> '')),
    node AS (SELECT th, line, n, true AS own, concat('own ', masked) AS node FROM t WHERE n <= {LEAD} OR n >= {LONG_WORDS} UNION ALL {wider}
      UNION ALL SELECT th, line, n, NULL, concat('head ', array_to_string(k[1:{EDGE}], ' ')) FROM t UNION ALL SELECT th, line, n, NULL, concat('tail ', array_to_string(k[n - {EDGE - 1}:n], ' ')) FROM t WHERE n > {EDGE}),
    total AS (SELECT th, count(*) AS total FROM t GROUP BY th),
    found AS (SELECT * FROM node WHERE node IN (SELECT node FROM node GROUP BY node HAVING count(DISTINCT th) > 1)),
    mine AS (SELECT th, any_value(total) - count(DISTINCT line) AS mine FROM found JOIN total USING (th) GROUP BY th),
    judged AS (SELECT node, own AND n >= {LONG_WORDS} AS long, mine, total - lines AS rest
      FROM (SELECT node, th, any_value(own) AS own, any_value(n) AS n, count(DISTINCT line) AS lines FROM found WHERE own IS NOT NULL GROUP BY node, th) JOIN mine USING (th) JOIN total USING (th)),
    c AS (SELECT node FROM judged GROUP BY node, long
      HAVING count(*) FILTER (mine > 0 AND {OWN} * mine >= rest) >= {min_docs} OR (long AND count(*) FILTER (mine > 0 AND {LONG_OWN} * mine >= rest) >= {LONG_DOCS})),
    d AS (SELECT th, list(DISTINCT line) AS gone FROM found WHERE node IN (SELECT node FROM c) GROUP BY th)
    SELECT s.*, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines, coalesce(len(gone), 0) AS n_dropped,
      CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda v, i: NOT list_contains(gone, i - 1)), chr(10)) END AS clean
    FROM s LEFT JOIN d ON md5(text) = th"""


def oracle_sql(min_docs: int = MIN_DOCS) -> str:
    return f"SELECT doc_id, n_lines, n_dropped, sha256(coalesce(clean, '')) AS text_sha256 FROM ({cleaned_sql(min_docs=min_docs)})"
