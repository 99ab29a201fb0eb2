import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuscount.llm import jaccard, neighbours, urls
from corpuscount.llm.components import components
from corpuscount.llm.queries import ORACLES, QUERIES
from corpuscount.runtime import written

SMALL = "/root/testdata/sf0.001"


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        parent[find(parent, a)] = find(parent, b)
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for a in roots:
        for b in list(roots)[:40]:
            assert (roots[a] == roots[b]) == (find(parent, a) == find(parent, b))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_of_small_graphs_have_few_tasks(spark, monkeypatch):
    from corpuscount.llm import exchange, pii
    from corpuscount.runtime import few, setting

    files = []
    for module in (exchange, pii):
        monkeypatch.setattr(module, "written", lambda df: files.append(out := written(df)) or out)
    edges = spark.createDataFrame([(k, k + 1) for k in range(300) if k % 100], "a long, b long")
    seeds = [(f"p{k}", f"s{k}{x}", "card") for k in range(60) for x in range(10)]
    tokens = spark.createDataFrame([*seeds, *((f"p{k}", f"c{k}", None) for k in range(60)), *((f"p{k + 1}", f"c{k}", None) for k in range(59))], "pattern string, instance string, kind string")
    with setting(spark, "spark.sql.shuffle.partitions", "40"), setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        roots = {r["node"]: r["root"] for r in components(edges).collect()}
        assert len(roots) == 300 and {len({roots[k] for k in range(a + 1, a + 101) if k in roots}) for a in (0, 100, 200)} == {1} and len(set(roots.values())) == 3
        assert len(pii.learned_patterns(tokens).collect()) == 60
        # what is written once may have as many files as there are shuffle partitions; the tables of rounds have one for each core at most
        assert len(files) > 8 and sorted(len(x.inputFiles()) for x in files)[-3] <= spark.sparkContext.defaultParallelism
        assert few(spark.range(0, 100, 1, 40), 10_000_000).rdd.getNumPartitions() == 40



def sets(rows, words):
    out = {}
    for i, t in rows:
        w = [x for x in re.split(rb"[ \t-\r]+", (t or "").encode().lower()) if x]
        out[i] = frozenset([tuple(w)] if 0 < len(w) < words else [tuple(w[k : k + words]) for k in range(len(w) - words + 1)])
    return out


def brute(rows, words, percent):
    s = sets(rows, words)
    parent = {i: i for i in s}
    inverse = defaultdict(list)
    for i in sorted(s):
        for g in s[i]:
            inverse[g].append(i)
    both = Counter()
    for ids in inverse.values():
        both.update((a, b) for n, b in enumerate(ids) for a in ids[:n])
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(s[a]) + len(s[b]) - n):
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(parent, i)) for i in s}


def near_copies(n, seed):
    """A group of copies of one text with edits: some link with each other, some with none."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 500, 120)]
    out = []
    for k in range(n):
        t = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 6)):
            t[at] = f"e{k}x{at}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join(spark, words, percent):
    odd = ["", None, " \n", "One two", "ONE  two", "one two three", "a b c d", "A b c d", "x", "x x x x x", "x x x x x x"]
    own = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = own + [(10**6 + k, t) for k, t in enumerate(odd + near_copies(80, 1) + near_copies(40, 2) * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "k", "g", "block")})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(df, words=words, percent=percent).collect()}
    assert got == brute(rows, words, percent)


def test_jaccard_with_a_tree_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(jaccard.candidates, "__defaults__", (2,))
    rows = list(enumerate(near_copies(60, 1) + near_copies(40, 2) * 2))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(df).collect()} == brute(rows, 4, 85)


def test_skewed_join(spark):
    from corpuscount.llm.skew import joined

    rows = [(k, "hot" if k % 3 else f"k{k % 50}" if k % 5 else None) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, key string")
    one = spark.createDataFrame([("hot", 1)] + [(f"k{k}", 2) for k in range(40)], "key string, v long")
    got = {r["id"]: (r["key"], r["v"]) for r in joined(df, one, ["key"]).collect()}
    assert got == {k: (key, {"hot": 1, **{f"k{n}": 2 for n in range(40)}}.get(key)) for k, key in rows}
    assert joined(df.where("false"), one, ["key"]).count() == 0 and joined(df, one.where("false"), ["key"]).count() == 3000


def test_jaccard_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join_components(df).count() == 0
    two = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    assert [r["component_id"] for r in jaccard.join_components(two).collect()] == [1, 1, 1]


def test_jaccard_keys(spark):
    a = [f"w{k}" for k in range(60)]
    b = [*a[:57], "x1", "x2", "x3"]
    c = ["y1", "y2", "y3", "y4", "y5", "y6", *b[6:]]  # like b, not like a
    other = " ".join(f"v{k}" for k in range(60))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    chain = spark.createDataFrame([(1, " ".join(a), "en", "s", 0), (None, " ".join(b), "en", "s", 0), (2, " ".join(c), "en", "s", 0), (1, other, "en", "s", 0)], schema)
    rows = jaccard.join_components(chain.where("text not like 'v%'"), words=5, percent=80).collect()
    assert {r["component_id"] for r in rows} == {1}
    got = corpus_pipeline.drop_near_duplicates(spark, chain, SMALL)
    assert got.columns == chain.columns and sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, other), (1, " ".join(a))]
    null = spark.createDataFrame([(None, t, "en", "s", 0) for t in (other, other, " ".join(a), "...", "", "")], schema)
    kept = sorted(r["text"] for r in corpus_pipeline.drop_near_duplicates(spark, null, SMALL).collect())
    assert kept == sorted([other, " ".join(a), "...", "", ""])


def test_op4(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op4_jaccard"](spark, SMALL).collect()} == brute(rows, 4, 85)


def exact(rows, k):
    """query -> [(vec_id, score)] over rows id -> vector."""
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    out = {}
    for q in ids[ids % 20 == 0]:
        s = x @ rows[q]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def held_against(found, want):
    hit = total = 0
    by = defaultdict(dict)
    for r in found:
        by[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    assert set(by) == set(want)
    for q, best in want.items():
        mine = [by[q][k] for k in range(1, len(best) + 1)]
        assert len(by[q]) == len(best)
        assert all(a[1] > b[1] or (a[1] == b[1] and a[0] < b[0]) for a, b in zip(mine, mine[1:]))
        hit += len({i for i, _ in mine} & {i for i, _ in best})
        total += len(best)
    return hit / max(1, total)


def test_neighbours_of_the_table(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()}
    found = QUERIES["op3_neighbours"](spark, "/root/testdata/sf0.1").collect()
    assert held_against(found, exact(rows, 20)) >= 0.97
    assert all(abs(r["score"] - float(rows[r["query_id"]] @ rows[r["vec_id"]])) < 1e-12 for r in found)


def test_neighbours_cases(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)) * rng.lognormal(0, 0.6, (600, 1))
    rows = [(k, [float(v) for v in np.float32(r)]) for k, r in enumerate(x)]
    rows += [(2000 + k, [0.5] * 16) for k in range(60)] + [(2000, [0.5] * 16)]
    bad = [(9000, None), (9020, []), (9040, [0.0] * 16), (9060, [1.0] * 15 + [None]), (9080, [1.0] * 15 + [float("nan")]), (9100, [float("inf")] * 16), (None, [1.0] * 16), (9120, [1.0, 2.0]), (9140, [1.0, 3.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "v", "q", "shard")})
    found = neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()
    two = [r for r in found if r["query_id"] > 9000]
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in two} == {(9120, 1, 9140, 7.0), (9140, 1, 9120, 7.0)}
    want = exact({i: np.array(np.float32(v), np.float64) for i, v in rows}, 20)
    assert held_against([r for r in found if r["query_id"] < 9000], want) >= 0.9
    assert [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == 2000), key=lambda r: r["rank"])] == [i for i, _ in want[2000]]
    assert neighbours.nearest(df.where("false"), F.lit(True)).count() == 0


def test_recall_on_a_graph_of_many_independent_vectors():
    """Independent directions are the hardest case; so many points that a beam covers a small share of them."""
    rng = np.random.default_rng(3)
    x, q = (v / np.linalg.norm(v, axis=1)[:, None] for v in (rng.standard_normal((40_000, 64)), rng.standard_normal((100, 64))))
    g = neighbours.build(neighbours.lifted(x))
    found, _ = g.search(np.concatenate([q, np.zeros((100, 1))], axis=1).astype(np.float32), neighbours.beam_of(len(x)))
    exact = np.argsort(-(q @ x.T), axis=1)[:, :20]
    pairs = lambda rows: ((i, int(p)) for i, r in enumerate(rows) for p in r)
    assert neighbours.beam_of(len(x)) < len(x) / 100
    assert neighbours.recall(pairs(found), pairs(exact)) >= 0.9


def test_shards_and_blocks_of_queries(spark, monkeypatch):
    """Many small graphs and several blocks of queries give what all pairs give."""
    monkeypatch.setattr(neighbours, "SHARD_BYTES", 40 * 8 * 4)
    monkeypatch.setattr(neighbours, "QUERIES", 25)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((240, 8)).astype(np.float32)
    for kind in ("float", "double"):
        df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>").withColumn("query", F.lit(1))
        rows = neighbours.nearest(df, F.col("vec_id") % 2 == 0, k=5).collect()
        score = x.astype(np.float64) @ x.astype(np.float64).T
        np.fill_diagonal(score, -np.inf)
        for i in range(0, 240, 2):
            own = sorted((r for r in rows if r["query_id"] == i), key=lambda r: r["rank"])
            want = np.argsort(-score[i], kind="stable")[:5]
            assert [r["vec_id"] for r in own] == want.tolist() and np.allclose([r["score"] for r in own], score[i][want], rtol=1e-12)


def test_graph_reaches_every_node():
    x = np.concatenate([np.random.default_rng(0).normal(0, 0.01, (200, 4)) + c for c in range(0, 50, 10)])
    g = neighbours.build(neighbours.lifted(x))
    seen, front = {g.entry}, [g.entry]
    while front:
        front = [int(j) for i in front for j in g.edges[i] if j >= 0 and j not in seen and not seen.add(int(j))]
    assert len(seen) == len(x)


def test_url_lists(spark):
    entries = spark.createDataFrame(
        [("s", "bad.com", "2024-01-10", "block"), ("s", "bad.com", "2024-02-10", "clear"), ("s", "bad.com", "2024-03-10", "block"), ("a", "ok.bad.com", "2024-01-01", "allow"), ("t", "BAD.com", "2024-01-20", "block"), ("t", None, "2024-01-01", "block"), ("t", "x.com", None, "block")],
        "list string, host string, dated string, action string",
    )
    cases = [
        ("http://bad.com/x", "2024-01-09", "none", None),
        ("http://bad.com/x", "2024-01-10", "block", "s"),
        ("https://u:p@WWW.Bad.com.:8080/x?y#z", "2024-01-25", "block", "s,t"),
        ("http://bad.com", "2024-02-10", "block", "t"),
        ("http://a.ok.bad.com", "2024-03-11", "allow", "a"),
        ("http://notbad.com", "2024-03-11", "none", None),
        ("http://x.com", "2024-03-11", "none", None),
        ("bad.com", "2024-03-11", "none", None),
        (None, "2024-03-11", "none", None),
        ("http://bad.com", None, "none", None),
        ("", "2024-03-11", "none", None),
        ("http://" + "a." * 200 + "bad.com", "2024-03-11", "none", None),
    ]
    df = spark.createDataFrame([(k, u, f, "old") for k, (u, f, _, _) in enumerate(cases * 2)], "page_id long, url string, fetched string, verdict string")
    rows = {r["page_id"]: (r["verdict"], r["lists"]) for r in urls.judge(df, entries).collect()}
    assert rows == {k: (v, x) for k, (_, _, v, x) in enumerate(cases * 2)}
    assert urls.judge(df.where("false"), entries).count() == 0
    assert {r["verdict"] for r in urls.judge(df, entries.where("false")).collect()} == {"none"}


def test_op7_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SMALL}/pages.parquet'")
    df = QUERIES["op7_urls"](spark, SMALL)
    want = con.execute(ORACLES["op7_urls"])
    names = [x[0] for x in want.description]
    assert sorted(map(str, df.select(names).collect())) == sorted(str(df.select(names).collect()[0].__class__(**dict(zip(names, r)))) for r in want.fetchall())


def test_urls_with_clashing_columns_and_hot_hosts(spark):
    """Columns named as those of the operator; a host and date of nearly all captures, and a suffix of all of them."""
    df = spark.range(3000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("http://h"), F.col("id").cast("string"), F.lit(".com/"))).when(F.col("id") % 10 == 1, F.lit(None)).otherwise("http://big.com/x").alias("url"), F.lit("2024-03-01").alias("fetched"))
    df = df.withColumns({c: F.lit(5) for c in ("host", "matched", "lists", "verdict", "_fetched", "_key", "_own", "_entries", "d", "__salt", "__hot")})
    entries = spark.createDataFrame([("a", "big.com", "2024-01-01", "block"), ("b", "big.com", "2024-02-01", "block"), ("b", "big.com", "2024-04-01", "allow"), ("a", "h10.com", "2024-01-01", "allow"), ("a", "h20.com", "2024-03-02", "block"), ("a", None, "2024-01-01", "block")], "list string, host string, dated string, action string")
    rows = {r["page_id"]: r for r in urls.judge(df, entries).collect()}
    assert len(rows) == 3000 and rows[5]["_key"] == rows[5]["__salt"] == rows[5]["_fetched"] == 5
    assert all((r["verdict"], r["matched"], r["lists"]) == (("block", "big.com", "a,b") if i % 10 > 1 else ("allow", "h10.com", "a") if i == 10 else ("none", None, None)) for i, r in rows.items())


def test_pipeline_stages(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"word{k * k % 997}" for k in range(300))
    words = [f"{w} some plain english words that stand here for a page number {k} of the book" for k, w in enumerate(("alpha", "beta", "gamma"))]
    made = [(1, long, "en", "s", 0), (2, long + " end", "en", "s", 0), (3, "12 34", "en", "s", 0), (4, None, "en", "s", 0), (5, words[0], "en", "s", 0), (6, "mail a@b.co " + words[1], "en", "s", 0), (6, "mail a@b.co " + words[1], "en", "s", 0), (7, "q" + " other" + long[-400:], "en", "s", 0)]
    docs = spark.createDataFrame(made, schema)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "repeats", "personal_data", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = written(stage(spark, docs, SMALL))
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == before
    assert sorted(r["doc_id"] for r in seen["language"]) == [1, 2, 5, 6, 6, 7]
    assert sorted(r["doc_id"] for r in seen["near_duplicates"]) == [1, 5, 6, 7]
    left = {r["doc_id"]: r["text"] for r in seen["repeats"]}
    assert len(left[7]) < 20 and len(left[1]) < len(long) - 390 and left[5] == words[0]
    assert {r["doc_id"]: r["text"] for r in seen["personal_data"]}[6] == "mail <email> " + words[1]
    assert {r["doc_id"] for r in seen["packing"]} == {1, 5, 6, 7}


def test_pipeline_without_labels(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    made = [(1, "plain words " * 40, None, "s", 0), (2, "12 34", None, "s", 0), (3, None, None, "s", 0), (4, "\u65e5\u672c", None, "s", 0)]
    docs = spark.createDataFrame(made, schema)
    assert sorted(r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, SMALL).collect()) == [1, 4]
    one = spark.createDataFrame([(k, "plain words " * 40, "en", "s", 0) for k in range(40) if zlib.crc32(str(k).encode()) % 3 == 1], schema)
    assert corpus_pipeline.identify_language(spark, one, SMALL).count() == one.count() > 0


def test_pipeline_rejects_gibberish_of_any_length(spark):
    import random

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    rng = random.Random(4)
    noise = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 10))) for _ in range(n // 6))
    made = [(-k, noise(n), None, "s", 0) for k, n in enumerate([150] * 4 + [400] * 4 + [5000] * 4 + [20000] * 4, 1)]
    made += [(1000000 + k, t[:n], None, "s", 0) for k, (t, n) in enumerate((t, n) for t in texts[:40] if t for n in (30, 150, 300))]
    more = docs.unionByName(spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").select(docs.columns))
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, more, SMALL).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} | {r[0] for r in made if r[0] > 0}


def test_pipeline_judges_short_texts_by_their_size(spark):
    """Texts of 50 to 200 characters are judged against labelled ones of their size; clean ones stay, and get a language."""
    import random

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in docs.orderBy("doc_id").collect() if r["text"] and r["lang"]]
    rng = random.Random(6)
    noise = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 10))) for _ in range(n // 6))
    # labelled short texts, as a corpus of short texts has them, and unlabelled ones
    made = [(10**6 + k, r["text"][:n], r["lang"] if k % 2 else None, "s", 0) for k, (r, n) in enumerate((r, n) for r in rows[:150] for n in (20, 50, 100, 200))]
    junk = [(-k, noise(n), None, "s", 0) for k, n in enumerate([50, 70, 100, 200] * 25, 1)]
    more = docs.unionByName(spark.createDataFrame(made + junk, "doc_id long, text string, lang string, source string, n_chars long").select(docs.columns))
    kept = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, more, SMALL).select("doc_id", "lang").collect()}
    clean = [r for r in made if any(c.isalpha() for c in r[1])]
    assert sum(r[0] in kept for r in clean) >= 0.99 * len(clean) and all(kept[r[0]] for r in clean if r[0] in kept)
    assert sum(r[0] not in kept for r in junk) >= 0.9 * len(junk)
    of = {10**6 + k: r["lang"] for k, (r, n) in enumerate((r, n) for r in rows[:150] for n in (20, 50, 100, 200)) if n == 200}
    assert sum(kept.get(i) == lang for i, lang in of.items()) >= 0.97 * len(of)


def test_pipeline_finds_repeats_of_short_words(spark):
    passage = " ".join(chr(97 + k * k % 23) for k in range(51))
    made = [(k, f"{w} {passage} {w}", "en", "s", 0) for k, w in enumerate(("alpha", "beta"))]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    assert all(len(r["text"]) < 20 for r in corpus_pipeline.remove_repeats(spark, docs, SMALL).collect())


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).where("n <> t").count() == 0
    kept = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert kept == {i for i, (_, c) in brute(rows, 5, 80).items() if i == c}


def test_pipeline_fits_its_least_size_on_all_labelled_rows(spark, monkeypatch):
    from corpuscount.llm import language

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen, plain = [], language.likeness
    monkeypatch.setattr(corpus_pipeline, "SAMPLE", 10, raising=False)
    monkeypatch.setattr(language, "likeness", lambda rows, *a, **b: seen.append(rows.count()) or plain(rows, *a, **b))
    assert corpus_pipeline.identify_language(spark, docs, SMALL).count() > 0
    assert seen == [docs.count()]


def test_pipeline_stages_begin_with_memory_given_back(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(corpus_pipeline, "give_back", lambda s: asked.append(s))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(5)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        stage(spark, docs, SMALL)
        assert len(asked) == k


def test_executors_collect(spark):
    from corpuscount.runtime import give_back

    bean = spark._jvm.java.lang.management.ManagementFactory
    times = lambda: sum(x.getCollectionCount() for x in bean.getGarbageCollectorMXBeans())
    before = times()
    give_back(spark)
    assert times() > before  # those asked for at once are one
