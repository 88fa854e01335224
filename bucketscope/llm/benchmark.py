"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Words lose their outer punctuation and become templates: numbers, names (capitalised words
inside a sentence) and units (after a number) give way to typed placeholders, all else is
lower-cased. Windows of eight template words are hashed and joined with those of the benchmark
items (an item of fewer words is one window). A document leaks an item if at least half of the
item's windows are in it and the slots agree: every value of the item's slots always stands for
the same value in the document and the other way round, so re-parameterised questions are
caught and chance likenesses of form are not.

A document may hold an item more than once, with different values. Where the slots of all hits
together don't agree, each occurrence is judged by itself, its windows and its slots: the hits of
one alignment (place in the document less place in the item), alone or with those of alignments
at most eight words (and less than half the item) away, where words came in or went. Of hits that
share a window of the item or of the document, the one of the longest run counts. One occurrence
that agrees is enough. n_windows counts the whole document.

Null and empty texts leak nothing and empty items are leaked by nothing. Repeated rows of one
doc_id count together, but words are compared row by row. Whole texts are read. Extra columns are ignored. An empty table
gives an empty table; a null doc_id is a document like any other, null item ids are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bucketscope.llm.tables import stored, table

WINDOW = 8
#: Share of an item's windows, in hundredths.
COVER = 50
#: Windows of the benchmark, or ids of documents with a hit, that are broadcast; beyond, a shuffled join.
BROADCAST_WINDOWS, BROADCAST_IDS = 500_000, 1_000_000
#: Words by which alignments of one occurrence may differ from its first.
SHIFT = 8
UNITS = "mm cm m km mg g kg lb lbs oz ml l s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent % dollar dollars euro euros cent cents mile miles inch inches foot feet meter meters metre metres kilometer kilometers gram grams kilogram kilograms liter liters litre litres degree degrees".split()


def _let(name: str, value: str, body: str) -> str:
    """body with a name for a value that is worked out once a row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _words(text: str) -> str:
    """SQL for the words of a text: an array of structs of template t and word v."""
    units, number = ", ".join(f"'{u}'" for u in UNITS), "rlike '^[0-9]+([.,:][0-9]+)*$'"
    raw = f"filter(split({text}, '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+'), x -> x <> '')"
    core = "transform(raw, x -> regexp_replace(x, '^[^\\\\p{L}\\\\p{N}%]+|[^\\\\p{L}\\\\p{N}%]+$', ''))"
    kind = f"""case when x {number} then '<number>'
        when i > 0 and core[i - 1] {number} and lower(x) in ({units}) then '<unit>'
        when i > 0 and x rlike '^\\\\p{{Lu}}\\\\p{{Ll}}' and not (raw[i - 1] rlike '[.!?:]$') then '<name>'
        else lower(x) end"""
    kinds = f"filter(transform(core, (x, i) -> if(x = '', null, struct({kind} as t, lower(x) as v))), x -> x is not null)"
    return _let("raw", raw, _let("core", core, kinds))


def canonical(df: DataFrame, text: str = "text") -> DataFrame:
    """df with ``w``, the words of its text: template t and word v."""
    return df.withColumn("w", F.expr(_words(text)))


def windows(rows: DataFrame, words: str, sizes: list[int], *ids: str) -> DataFrame:
    """ids, at (from 1), h, k of every window of k template words, for each k in sizes; words: SQL for the words."""
    one = lambda k: f"if(size(t) < {k}, array(), transform(sequence(1, size(t) - {k} + 1), i -> struct(i as at, xxhash64({', '.join(f't[i + {j}]' for j in range(-1, k - 1))}) as h, {k} as k)))"
    found = _let("t", f"transform({words}, x -> x.t)", "concat(" + ", ".join(one(k) for k in sizes) + ")")
    return rows.select(*ids, F.explode(F.expr(found)).alias("x")).select(*[i.split(".")[-1] for i in ids], "x.at", "x.h", "x.k")


def _compared(places: DataFrame, words: DataFrame, *by: str) -> DataFrame:
    """by, pairs, n_slots, values: pairs of values that fill one slot in the item and the document, and how many differ on each side."""
    pairs = places.join(words, ["doc_id", "row"]).select(*by, "item_value", F.expr("w[place].v").alias("value")).filter("value is not null").distinct()
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("item_value").alias("n_slots"), F.countDistinct("value").alias("values"))


def _placed(hits: DataFrame, slots: DataFrame, *by: str) -> DataFrame:
    """The slots of the matched windows, each place once, with the words that fill them in the item."""
    inside = hits.join(slots, "item_id").filter("slot >= item_at - 1 and slot < item_at - 1 + k")
    return inside.select(*by, "item_value", (F.col("at") - F.col("item_at") + F.col("slot")).alias("place")).distinct()


AGREES = "pairs is null or (pairs = n_slots and pairs = values)"


def _occurrences(hits: DataFrame, known: DataFrame, many: DataFrame, sizes: DataFrame, slots: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, item_id, n_slots of the pairs in hits of which some occurrence covers the item and agrees."""
    pair = ["doc_id", "row", "item_id"]
    hits = hits.withColumn("off", F.col("at") - F.col("item_at"))
    run = F.col("item_at") - F.row_number().over(Window.partitionBy(*pair, "off").orderBy("item_at"))
    hits = hits.withColumn("run", run).withColumn("length", F.count(F.lit(1)).over(Window.partitionBy(*pair, "off", "run"))).withColumn("cell", F.floor(F.col("off") / (SHIFT + 1)))
    hits = stored(hits)
    seeds = hits.select(*pair, F.col("off").alias("seed"), "cell").distinct().join(sizes, "item_id")
    seeds = seeds.withColumn("reach", F.explode(F.array_distinct(F.array(F.lit(0), F.least(F.lit(SHIFT), F.expr("(n_words - 1) div 2").cast("int"))))))
    seeds = seeds.withColumn("cell", F.explode(F.when(F.col("reach") == 0, F.array("cell")).otherwise(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))).drop("n_words")
    one = [*pair, "seed", "reach"]
    near = hits.join(seeds, [*pair, "cell"]).filter(F.abs(F.col("off") - F.col("seed")) <= F.col("reach"))
    first = lambda side: F.row_number().over(Window.partitionBy(*one, side).orderBy(F.desc("length"), F.abs(F.col("off") - F.col("seed")), "off"))
    near = near.withColumn("a", first("item_at")).withColumn("b", first("at")).filter("a = 1 and b = 1").select(*one, "at", "item_at", "k")
    near = stored(near)
    cover = near.join(known.select("item_id", "item_at", "h"), ["item_id", "item_at"]).groupBy(*one).agg(F.countDistinct("h").alias("n")).join(many, "item_id").filter(F.col("n") * 100 >= F.col("item_windows") * COVER)
    agree = _compared(_placed(near.join(cover.select(*one), one, "left_semi"), slots, *one), words, *one)
    return cover.select(*one).join(agree, one, "left").filter(AGREES).groupBy("doc_id", "item_id").agg(F.max(F.coalesce("n_slots", F.lit(0))).alias("n_slots"))


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows (of the item, found in the document), item_windows, n_slots (distinct slot values)."""
    bench = stored(canonical(items.filter("item_id is not null").select("item_id", "text")).filter("size(w) > 0").withColumn("own", F.least(F.size("w"), F.lit(WINDOW))).select("item_id", "w", "own"))
    sizes = sorted(r["own"] for r in bench.select("own").distinct().collect()) or [WINDOW]  # WINDOW sizes at most
    parts = windows(bench, "w", sizes, "item_id", "own").filter("k = own")
    known = stored(parts.select("item_id", F.col("at").alias("item_at"), "h", "k"))
    lookup = F.broadcast(known) if known.count() <= BROADCAST_WINDOWS else known
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("row"))
    hits = stored(windows(docs, _words("text"), sizes, "doc_id", "row").join(lookup, ["h", "k"]).select("doc_id", "row", "item_id", "at", "item_at", "k").distinct())
    many = known.groupBy("item_id").agg(F.countDistinct("h").alias("item_windows"))
    found = hits.join(known.select("item_id", "item_at", "h"), ["item_id", "item_at"]).groupBy("doc_id", "item_id").agg(F.countDistinct("h").alias("n_windows"))
    found = found.join(many, "item_id").filter(F.col("n_windows") * 100 >= F.col("item_windows") * COVER)

    slots = bench.select("item_id", F.posexplode("w").alias("slot", "x")).filter(F.col("x.t").isin("<number>", "<unit>", "<name>")).select("item_id", "slot", F.col("x.v").alias("item_value"))
    places = _placed(hits, slots, "doc_id", "row", "item_id")
    ids = stored(places.select("doc_id").distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    chosen = stored(canonical(docs.join(ids, "doc_id", "left_semi")).select("doc_id", "row", "w").distinct())
    rows = stored(found.join(_compared(places, chosen, "doc_id", "item_id"), ["doc_id", "item_id"], "left").withColumn("agrees", F.expr(AGREES)))
    torn = hits.join(rows.filter("not agrees").select("doc_id", "item_id"), ["doc_id", "item_id"], "left_semi")
    lengths = bench.select("item_id", F.size("w").alias("n_words"))
    again = rows.filter("not agrees").drop("n_slots").join(_occurrences(torn, known, many, lengths, slots, chosen), ["doc_id", "item_id"])
    columns = ["doc_id", "item_id", "n_windows", "item_windows", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots")]
    return rows.filter("agrees").select(*columns).union(again.select(*columns))


def op8_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UNITS = ", ".join(f"'{u}'" for u in UNITS)
_NUMBER = "'^[0-9]+([.,:][0-9]+)*$'"
_SPACE = "'[ \\t\\n\\x0B\\f\\r]+'"


def _canonical_sql(source: str, key: str) -> str:
    return f"""(SELECT {key}, list_filter(list_transform(range(1, len(core) + 1), lambda i: CASE WHEN core[i] = '' THEN NULL
          WHEN regexp_matches(core[i], {_NUMBER}) THEN {{'t': '<number>', 'v': lower(core[i])}}
          WHEN i > 1 AND regexp_matches(core[i - 1], {_NUMBER}) AND lower(core[i]) IN ({_UNITS}) THEN {{'t': '<unit>', 'v': lower(core[i])}}
          WHEN i > 1 AND regexp_matches(core[i], '^\\p{{Lu}}\\p{{Ll}}') AND NOT regexp_matches(raw[i - 1], '[.!?:]$') THEN {{'t': '<name>', 'v': lower(core[i])}}
          ELSE {{'t': lower(core[i]), 'v': lower(core[i])}} END), lambda x: x IS NOT NULL) AS w
   FROM (SELECT {key}, raw, list_transform(raw, lambda x: regexp_replace(x, '^[^\\p{{L}}\\p{{N}}%]+|[^\\p{{L}}\\p{{N}}%]+$', '', 'g')) AS core
         FROM (SELECT {key}, list_filter(regexp_split_to_array(text, {_SPACE}), lambda x: x <> '') AS raw FROM {source})))"""


ORACLE = f"""
WITH i AS (SELECT item_id, w, least(len(w), {WINDOW}) AS k FROM {_canonical_sql('benchmark', 'item_id')} WHERE len(w) > 0),
d AS (SELECT doc_id, w FROM {_canonical_sql('documents', 'doc_id')}),
iw AS (SELECT item_id, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM i),
ih AS (SELECT item_id, k, p, array_to_string(list_transform(w[p:p + k - 1], lambda x: x.t), chr(1)) AS h FROM iw),
z AS (SELECT DISTINCT k FROM i),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM d, z WHERE len(w) >= k),
dh AS (SELECT doc_id, k, p, array_to_string(list_transform(w[p:p + k - 1], lambda x: x.t), chr(1)) AS h FROM dw),
hit AS (SELECT DISTINCT dh.doc_id, ih.item_id, dh.p AS dp, ih.p AS ip, ih.k, ih.h FROM dh JOIN ih USING (h, k)),
n AS (SELECT item_id, count(DISTINCT h) AS item_windows FROM ih GROUP BY 1),
f AS (SELECT doc_id, item_id, count(DISTINCT h) AS n_windows, any_value(item_windows) AS item_windows FROM hit JOIN n USING (item_id) GROUP BY 1, 2
      HAVING count(DISTINCT h) * 100 >= any_value(item_windows) * {COVER}),
s AS (SELECT DISTINCT hit.doc_id, hit.item_id, i.w[ip + j].v AS iv, d.w[dp + j].v AS dv
      FROM hit JOIN i USING (item_id) JOIN d USING (doc_id), (SELECT unnest(range(0, {WINDOW})) AS j)
      WHERE j < hit.k AND i.w[ip + j].t IN ('<number>', '<unit>', '<name>')),
a AS (SELECT doc_id, item_id, count(*) AS pairs, count(DISTINCT iv) AS n_slots, count(DISTINCT dv) AS vals FROM s GROUP BY 1, 2),
fa AS (SELECT f.*, coalesce(n_slots, 0) AS n_slots, pairs IS NULL OR (pairs = n_slots AND pairs = vals) AS agrees FROM f LEFT JOIN a USING (doc_id, item_id)),
th AS (SELECT hit.*, dp - ip AS off, ip - row_number() OVER (PARTITION BY hit.doc_id, hit.item_id, dp - ip ORDER BY ip) AS run FROM hit JOIN fa USING (doc_id, item_id) WHERE NOT agrees),
tl AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, off, run) AS length FROM th),
sd AS (SELECT DISTINCT doc_id, item_id, off AS seed, reach FROM tl JOIN i USING (item_id), (SELECT unnest([0, 1]) AS wide), LATERAL (SELECT wide * least({SHIFT}, (len(i.w) - 1) // 2) AS reach)),
nr AS (SELECT tl.*, seed, reach, row_number() OVER (PARTITION BY doc_id, item_id, seed, reach, ip ORDER BY length DESC, abs(off - seed), off) AS x,
       row_number() OVER (PARTITION BY doc_id, item_id, seed, reach, dp ORDER BY length DESC, abs(off - seed), off) AS y
       FROM tl JOIN sd USING (doc_id, item_id) WHERE abs(off - seed) <= reach),
nb AS (SELECT * FROM nr WHERE x = 1 AND y = 1),
cv AS (SELECT doc_id, item_id, seed, reach FROM nb JOIN n USING (item_id) GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT h) * 100 >= any_value(item_windows) * {COVER}),
os AS (SELECT DISTINCT nb.doc_id, nb.item_id, seed, reach, i.w[ip + j].v AS iv, d.w[dp + j].v AS dv
       FROM nb JOIN cv USING (doc_id, item_id, seed, reach) JOIN i USING (item_id) JOIN d USING (doc_id), (SELECT unnest(range(0, {WINDOW})) AS j)
       WHERE j < nb.k AND i.w[ip + j].t IN ('<number>', '<unit>', '<name>')),
oa AS (SELECT doc_id, item_id, seed, reach, count(*) AS pairs, count(DISTINCT iv) AS slots, count(DISTINCT dv) AS vals FROM os GROUP BY 1, 2, 3, 4),
oc AS (SELECT doc_id, item_id, max(coalesce(slots, 0)) AS n_slots FROM cv LEFT JOIN oa USING (doc_id, item_id, seed, reach) WHERE pairs IS NULL OR (pairs = slots AND pairs = vals) GROUP BY 1, 2)
SELECT doc_id, item_id, n_windows, item_windows, n_slots FROM fa WHERE agrees
UNION ALL SELECT doc_id, item_id, n_windows, item_windows, oc.n_slots FROM fa JOIN oc USING (doc_id, item_id) WHERE NOT agrees
"""
