"""Line dedup by a log-template tree, with DataFrame functions only.

A line falls into a leaf by its number of tokens and its first three tokens, tokens with a digit
standing for any. Within a leaf a token is constant at its place if three documents' lines have
it there; all others are variable fields. The line's template keeps the constant tokens, and is
one if at least 70 % of its tokens are constant or have a digit, two constant ones among them. A
template that recurs in three documents or more stays in the first of them (the least doc_id) and
is dropped from the others. So does a line that recurs exactly in two documents or more, and the
template of a line of sixteen tokens or more, with constants that two documents have; of several
firsts the least counts.

Lines of fewer than four tokens are left alone. Tokens are what space, tab, vertical tab, form
feed and carriage return separate. A document counts once for each of its different lines; rows
that repeat a document count as documents, and each keeps the lines if its doc_id is the least.
Null doc_ids count and keep nothing unless all are null. A null text stays null, an empty text
empty. Long texts are split whole; the work on a text grows with its lines (times their
logarithm). Extra columns pass through ``without_repeats``, whatever their names; columns named
as its outputs are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bucketscope.llm.tables import stored, table

LEAD, LEAST_TOKENS, LEAST_DOCS, CONSTANT = 3, 4, 3, 70
#: Documents from which on equal lines recur, and templates of at least LONG_TOKENS.
PAIR_DOCS, LONG_TOKENS = 2, 16
#: Constant tokens of a template, however many have digits.
LEAST_FIXED = 2
#: Leaves or lines that are broadcast; beyond, a shuffled join.
BROADCAST_ROWS = 500_000
#: Different lines of a leaf that one task may hold.
LEAF_LINES = 1_000
ANY = "<*>"


def _tokens(line: str) -> Column:
    return F.expr(f"filter(split({line}, '[ \\\\t\\\\x0B\\\\f\\\\r]+'), t -> t <> '')")


def _leaf(tokens: str) -> Column:
    """64 bits for the number of tokens and the first ones."""
    return F.expr(f"xxhash64(size({tokens}), transform(slice({tokens}, 1, {LEAD}), t -> if(t rlike '[0-9]', '{ANY}', t)))")


def _hashes() -> list[Column]:
    """Two hashes that stand for a line where its text isn't needed."""
    return [F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("g")]


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))


def _let(name: str, value: str, body: str) -> str:
    """body with a name for a value that is worked out once a row."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: SQL for the different lines of a text, each with its hashes and places: lines sorted by hash, where those that are equal form runs.
_DIFFERENT = _let(
    "l",
    "split(text, '\\n')",
    _let(
        "s",
        "sort_array(transform(l, (x, i) -> struct(xxhash64(x) as h, xxhash64(x, 1) as g, i as at)))",
        _let(
            "f",
            "filter(transform(s, (x, i) -> if(i = 0 or s[i - 1].h != x.h or s[i - 1].g != x.g, i, null)), i -> i is not null)",
            "transform(f, (a, j) -> struct(s[a].h as h, s[a].g as g, l[s[a].at] as line, transform(slice(s, a + 1, coalesce(get(f, j + 1), size(s)) - a), x -> x.at) as places))",
        ),
    ),
)


def _parsed(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text), leaf, width, h, g, places of every different line of a document that is long enough."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), F.explode(F.expr(_DIFFERENT)).alias("x")).select("doc_id", "row", "x.*")
    rows = rows.withColumn("tokens", _tokens("line")).filter(F.size("tokens") >= LEAST_TOKENS)
    return rows.select("doc_id", "row", _leaf("tokens").alias("leaf"), F.size("tokens").alias("width"), "h", "g", "places")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _templates(lines: DataFrame, large: DataFrame) -> DataFrame:
    """leaf, h, g, docs, first_doc, least, template of the lines that are a template; least: documents that have its constants, at least.

    A leaf's lines are dealt out by leaf once, and all that follows needs no further shuffle.
    The leaves in large, of too many different lines for that, count their tokens by token.
    """
    few = lines.join(_small(large), "leaf", "left_anti").repartition("leaf")
    tokens = few.select("leaf", "h", "g", "docs", "first_doc", F.posexplode("tokens").alias("at", "token"))
    by_leaf = tokens.withColumn("support", F.sum("docs").over(Window.partitionBy("leaf", "at", "token")))

    many = lines.join(_small(large), "leaf", "left_semi").select("leaf", "h", "g", "docs", "first_doc", F.posexplode("tokens").alias("at", "token"))
    constant = many.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("support")).filter(F.col("support") >= PAIR_DOCS)
    by_token = many.join(constant, ["leaf", "at", "token"], "left").select("leaf", "h", "g", "docs", "first_doc", "at", "token", F.coalesce("support", F.lit(0)).alias("support"))

    def joined(rows: DataFrame) -> DataFrame:
        part = F.struct("at", "token", F.when(F.col("token").rlike("[0-9]"), -1).otherwise(F.col("support")).alias("support"))
        out = rows.groupBy("leaf", "h", "g").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.first("docs").alias("docs"), F.first("first_doc").alias("first_doc"))
        made = lambda n: f"transform(parts, x -> if(x.support >= {n}, x.token, '{ANY}'))"
        whole = lambda n: f"size(filter(parts, x -> x.support >= {n})) >= {LEAST_FIXED} and size(filter(parts, x -> x.support >= {n} or x.support < 0)) * 100 >= size(parts) * {CONSTANT}"
        kinds = [f"if({whole(LEAST_DOCS)}, struct({LEAST_DOCS} as least, concat_ws(' ', {made(LEAST_DOCS)}) as template), null)"]
        kinds.append(f"if(size(parts) >= {LONG_TOKENS} and {whole(PAIR_DOCS)}, struct({PAIR_DOCS} as least, concat_ws(' ', {made(PAIR_DOCS)}) as template), null)")
        return out.select("leaf", "h", "g", "docs", "first_doc", F.inline(F.expr(f"filter(array({', '.join(kinds)}), x -> x is not null)")))

    return joined(by_leaf).union(joined(by_token))


def recurring(docs: DataFrame, parsed: DataFrame) -> DataFrame:
    """h, g, first_doc of every line that recurs or whose template does; parsed: _parsed(docs), stored."""
    leaves = stored(parsed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= PAIR_DOCS).select("leaf", "n"))
    some = stored(parsed.join(_small(leaves), "leaf").groupBy("leaf", "width", "h", "g").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc"), F.first("n").alias("n")))
    exact = some.filter(F.col("docs") >= PAIR_DOCS).select("h", "g", "first_doc")
    # Short lines in leaves of two lines recur exactly or not at all.
    some = some.filter((F.col("n") >= LEAST_DOCS) | (F.col("width") >= LONG_TOKENS)).drop("n")
    large = stored(some.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LEAF_LINES).select("leaf"))
    texts = _lines(docs).select("line", *_hashes()).join(_small(some.select("h", "g")), ["h", "g"], "left_semi").groupBy("h", "g").agg(F.max("line").alias("line"))
    lines = stored(some.join(texts, ["h", "g"]).select("leaf", "h", "g", "docs", "first_doc", _tokens("line").alias("tokens")))
    templates = stored(_templates(lines, large).withColumn("m", F.md5("template")).drop("template"))
    many = templates.groupBy("leaf", "least", "m").agg(F.sum("docs").alias("n"), F.min("first_doc").alias("first")).filter(F.col("n") >= F.col("least"))
    found = templates.join(many, ["leaf", "least", "m"]).select("h", "g", F.col("first").alias("first_doc"))
    return found.union(exact).groupBy("h", "g").agg(F.min("first_doc").alias("first_doc"))


def _dropped(parsed: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, row and the places of the lines that go, in order, for every document that has some."""
    known = found.filter("first_doc is not null").select("h", "g", "first_doc")
    gone = parsed.join(_small(known), ["h", "g"]).filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    return gone.groupBy("doc_id", "row").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("places")))).alias("gone"))


#: SQL for the lines l between the places in gone, joined again.
_KEPT = _let("b", "concat(array(-1), gone, array(size(l)))", "array_join(flatten(transform(sequence(1, size(b) - 1), j -> slice(l, b[j - 1] + 2, b[j] - b[j - 1] - 1))), '\n')")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the kept lines as text, ``n_lines`` and ``n_dropped``."""
    parsed = stored(_parsed(docs))
    found = stored(recurring(docs, parsed))
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("row")).alias("x")
    gone = _dropped(parsed, found).alias("y")
    rows = rows.join(gone, F.col("x.id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.row") == F.col("y.row")), "left").select("doc", "gone")
    lines = "split(doc.text, '\\n')"
    text = F.expr(f"if(gone is null, doc.text, {_let('l', lines, _KEPT)})")
    outputs = {"text": text, "n_lines": F.expr(f"if(doc.text is null, 0, size({lines}))").cast("long"), "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long")}
    kept = [outputs.pop("text").alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(*kept, *[v.alias(k) for k, v in outputs.items()])


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


ORACLE = f"""
WITH l AS (SELECT doc_id, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents),
t AS (SELECT doc_id, line, list_filter(regexp_split_to_array(line, '[ \\t\\x0B\\f\\r]+'), lambda x: x <> '') AS tokens FROM l),
p AS (SELECT doc_id, line, tokens, CAST(len(tokens) AS VARCHAR) || ' ' || array_to_string(list_transform(tokens[1:{LEAD}], lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{ANY}' ELSE x END), ' ') AS leaf
      FROM t WHERE len(tokens) >= {LEAST_TOKENS}),
g AS (SELECT leaf, line, tokens, count(*) AS docs, min(doc_id) AS first_doc FROM p GROUP BY ALL),
e AS (SELECT leaf, line, docs, first_doc, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM g),
c AS (SELECT leaf, pos, token, CASE WHEN regexp_matches(token, '[0-9]') THEN -1 ELSE sum(docs) END AS support FROM e GROUP BY leaf, pos, token),
n AS (SELECT unnest([{PAIR_DOCS}, {LEAST_DOCS}]) AS least),
m AS (SELECT leaf, line, docs, first_doc, least, string_agg(CASE WHEN support >= least THEN token ELSE '{ANY}' END, ' ' ORDER BY pos) AS template
      FROM e JOIN c USING (leaf, pos, token), n GROUP BY leaf, line, docs, first_doc, least
      HAVING count(*) FILTER (support >= least) >= {LEAST_FIXED} AND count(*) FILTER (support >= least OR support < 0) * 100 >= count(*) * {CONSTANT}
         AND (least = {LEAST_DOCS} OR count(*) >= {LONG_TOKENS})),
r AS (SELECT leaf, least, template, min(first_doc) AS first_doc FROM m GROUP BY leaf, least, template HAVING sum(docs) >= least),
x AS (SELECT line, min(first_doc) AS first_doc
      FROM (SELECT m.line, r.first_doc FROM m JOIN r USING (leaf, least, template) UNION ALL SELECT line, first_doc FROM g WHERE docs >= {PAIR_DOCS}) GROUP BY line),
o AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT o.doc_id, o.line, o.pos, x.line IS NOT NULL AND x.first_doc IS DISTINCT FROM o.doc_id AS gone FROM o LEFT JOIN x ON x.line = o.line),
s AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM k GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, CAST(length(kept) AS BIGINT) AS kept_chars, md5(kept) AS kept_md5 FROM s
"""
