from collections import Counter

import pytest
from test_text_operators import shingles

from bucketscope.llm import benchmark, components, jaccard, lines, sharding


def brute(rows):
    """Smallest id reachable by links, by text sets."""
    sets, least = {i: shingles(t) for i, t in rows}, {}
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    for i in sets:
        least[i] = find(i)
    return {i: (len(sets[i]), least[i]) for i in sets}


def test_jaccard_against_brute_force(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_jaccard_on_edits_of_one_text(spark):
    """A group of near copies whose links are a chain, a star and none."""
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(60):
        words = list(base)
        for j in range(i % 7):
            words[(i * 31 + j * 37) % 150] = f"new{i % 5}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, f"u{i} v{i} this work is licensed under the general terms of the great open library version three") for i in range(30)]
    rows += [(200, ""), (201, None), (202, "x y"), (203, "X  y")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_jaccard_edges(edge, none):
    got = jaccard.components_of(edge).collect()
    assert len(got) == edge.count()
    by = {r.doc_id: r for r in got}
    assert by[5].component_id == by[6].component_id == by[7].component_id == 5 and by[0].n_shingles == 0 and by[0].component_id == 0
    assert by[None].component_id == 5 and by[9].component_id == 8
    assert jaccard.components_of(none).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(50, 60), (60, 50), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == dict.fromkeys(range(41), 0) | {50: 50, 60: 50}
    assert components.components(links.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op4_lines", "op7_sharding", "op8_benchmark"])
def test_native_operators_equal_sql(spark, sf_dir, name):
    from oracle import connect, same

    from bucketscope.llm import queries

    same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name])


def test_lines_templates_and_edges(spark, edge, none):
    rows = [(i, f"{'abcdefgh'[i]} has an own line {i}\nuser {i} logged in from host {'abcdefgh'[i]}9 at noon\nshort line") for i in range(5)]
    kept = {r.doc_id: r for r in lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [kept[i].n_dropped for i in range(5)] == [0, 1, 1, 1, 1] and "logged" in kept[0].text and "logged" not in kept[3].text
    assert all("short line" in kept[i].text and kept[i].n_lines == 3 for i in kept)
    found = lines.without_repeats(edge).collect()
    assert len(found) == edge.count() and [r.text for r in found if r.doc_id == 0] == [None]
    assert set(edge.columns) < set(found[0].__fields__) and lines.without_repeats(none).count() == 0


def test_lines_of_two_documents(spark):
    long = " ".join(f"{a}{b}" for a in "abcde" for b in "vwxyz")
    texts = ["first own text\nthank you very much", f"some\n{long} one", "second own text\nthank you very much", f"any\n{long} two", "all alone\nwe met at noon", "quite apart\nwe met at dawn"]
    kept = {r.doc_id: (r.n_dropped, r.text) for r in lines.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == {i: (0, t) for i, t in enumerate(texts)} | {2: (1, "second own text"), 3: (1, "any")}


def test_lines_of_digits(spark):
    log = lambda i: f"2024-01-0{i} 10:1{i}:12 user {i} logged in from 10.0.0.{i}"
    texts = [f"{'abcd'[i]} own text of it\n{log(i)}\n1 2 3 4 {i}\n1 2 3 4 5" for i in range(4)]
    kept = {r.doc_id: (r.n_dropped, r.text) for r in lines.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == {0: (0, texts[0])} | {i: (2, f"{'abcd'[i]} own text of it\n1 2 3 4 {i}") for i in range(1, 4)}


def test_shards_fit(spark, docs, edge, none):
    for limit in (20_000, 1 << 20):
        rows = sharding.shards(docs, limit).collect()
        assert len(rows) == docs.count() and all(r.shard_bytes <= limit or r.shard_docs == 1 for r in rows)
        assert all(n == docs_in for (_, docs_in), n in Counter((r.shard, r.shard_docs) for r in rows).items())
        assert len({r.shard for r in rows}) == len({(r.shard, r.shard_bytes) for r in rows})
    assert {r.depth for r in sharding.shards(docs, 1 << 30).collect()} == {0}
    same = spark.createDataFrame([(1, "x" * 100)] * 25 + [(2, "y")], "doc_id long, text string")
    rows = sharding.shards(same, 300).collect()
    assert len(rows) == 26 and max(r.shard_bytes for r in rows) <= 300
    assert all(n == k for (_, k), n in Counter((r.shard, r.shard_docs) for r in rows).items())
    assert len(sharding.shards(edge).collect()) == edge.count() and sharding.shards(none).count() == 0


def test_reparameterised_questions(spark, edge, none):
    item = "in total how many apples does Anna buy if she pays 12 dollars for each of the 5 boxes and keeps 12 coins"
    same = item.replace("Anna", "Peter").replace("12", "31").replace("dollars", "euros")
    odd = item.replace("12 dollars", "30 dollars").replace("12 coins", "40 coins")
    rows = [(1, f"noise before it {item} and noise"), (2, f"noise, {same}."), (3, odd), (4, "in total how many apples does Anna buy now"), (5, None), (6, "")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, ""), (9, None), (10, "few words only")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in benchmark.leaks(docs, items).collect()}
    assert got == {(1, 7), (2, 7)}
    assert benchmark.leaks(edge, items).count() == 0 and benchmark.leaks(none, items).count() == 0 and benchmark.leaks(docs, items.limit(0)).count() == 0


def test_repeated_questions(spark):
    item = "in total how many apples does Anna buy if she pays 12 dollars for each of the 5 boxes and keeps 12 coins"
    other = item.replace("12", "31").replace("Anna", "Peter")
    odd, torn = item.replace("12 dollars", "30 dollars").replace("12 coins", "40 coins"), other.replace("for each", "right now for each")
    twice = "she then walks home and counts 3 coins in her purse before " * 2
    twice = twice.replace("3", "4", 1) + "the day ends"
    rows = [(1, f"{item} some words between them {other}"), (2, f"{item} {other}"), (3, f"{other} {other.replace('31', '8')}"), (4, f"{odd} or {odd.replace('30', '7')}"), (5, f"noise {twice} noise"), (6, f"{torn} and {odd}"), (7, f"{odd} {torn}"), (8, odd), (9, item), (9, other + " at the end of it")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, twice)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in benchmark.leaks(docs, items).collect()}
    assert set(got) == {(1, 7), (2, 7), (3, 7), (5, 8), (6, 7), (7, 7), (9, 7)} and benchmark.leaks(docs, items).count() == 7
    assert got[5, 8].n_slots == 2 and got[1, 7].n_windows == got[1, 7].item_windows


def test_lines_of_many_kinds_in_one_text(spark):
    """Work grows with the lines of a text: tens of thousands that all recur."""
    import time

    text = "\n".join(f"line {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)} is one of many" for i in range(17_000))
    docs = spark.createDataFrame([(i, f"own{i}\n{text}\nx\nx") for i in range(3)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in lines.without_repeats(docs).collect()}
    assert time.time() - began < 90
    assert got[1].text == "own1\nx\nx" and got[1].n_dropped == 17_000 and got[0].n_dropped == 0


def test_stages_decide_by_row(spark, none):
    """Null ids, repeated rows, rows of one id with different texts, empty texts, empty tables, columns of clashing names."""
    import corpus_pipeline

    base = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old tree near the quiet river today"
    other = "a plain text of its own that has no likeness with any of the others and stands alone in this small table of documents"
    rows = [(None, base), (None, base), (None, other), (3, base + " again"), (3, base + " again"), (3, other + " x"), (4, ""), (4, ""), (5, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "keep", 7) for i, t in rows], "doc_id long, text string, lang string, row string, n_chars long")
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, None).collect()), key=repr)
    assert kept == sorted([(3, base + " again"), (3, other + " x"), (4, ""), (4, ""), (5, None), (None, "")], key=repr)
    only = spark.createDataFrame([(None, base), (None, base + " end"), (None, other)], "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, only, None).count() == 2
    for stage in (corpus_pipeline.language_id, corpus_pipeline.line_dedup, corpus_pipeline.near_duplicates, corpus_pipeline.encode):
        assert stage(spark, none, "/root/testdata/sf0.001").count() == 0
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").filter("length(text) > 60").first().text
    leaky = spark.createDataFrame([(None, item, "k"), (None, other, "k"), (1, item, "k"), (1, other, "k"), (2, None, "k"), (2, "", "k")], "doc_id long, text string, key string")
    left = [(r.doc_id, r.text, r.key) for r in corpus_pipeline.decontaminate(spark, leaky, "/root/testdata/sf0.001").collect()]
    assert sorted(left, key=repr) == sorted([(None, other, "k"), (1, other, "k"), (2, None, "k"), (2, "", "k")], key=repr)
    found = corpus_pipeline.line_dedup(spark, docs, None)
    assert found.columns == docs.columns and all(r.row == "keep" for r in found.collect())


def test_pipeline_against_stages(spark, sf_dir, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding"]
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    kept = {r.doc_id: r.text for r in rows}
    stage = docs
    for _, f in corpus_pipeline.STAGES[:2]:
        stage = f(spark, stage, sf_dir)
    assert stage.columns == docs.columns
    texts = {r.doc_id: r.text for r in stage.collect()}
    leaked = {r.doc_id for r in benchmark.leaks(stage, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    wanted = {i for i, (_, root) in brute(list(texts.items())).items() if root == i} - leaked
    assert set(kept) == wanted and all(kept[i] == texts[i] for i in kept)
    assert all(r.n_tokens == len(r.token_ids) for r in rows)
