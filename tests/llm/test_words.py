"""Periodic runs, token counts of prefixes, spelling variants: against brute force and the library."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpuscount.llm import counts, periods, variants
from corpuscount.llm.queries import ORACLES, QUERIES, tokenizer_path

SMALL = "/root/testdata/sf0.001"
PIECES = "piece_bpe_32k.model"
ODD = ["", None, " \n\t", "a", "a", "x" * 3000, "a " * 40, "  two  blanks ", "▁a ▁▁b", "<s> </s> <unk> <0x0A>", "a\r\n\x0b\x0cb\x85c\xa0d", "İstanbul ΑΣ 日本語 𝒳 \U0001f600!!", "\0y"]


def table(spark, texts):
    """Texts with ids, and extra columns whose names are used inside the operators."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df.withColumns({c: F.lit(7) for c in ("id", "n", "runs", "counts", "word", "n_words", "n_chars", "best", "key", "block")})


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def all_runs(words, least=24, ratio=3):
    """Every stretch of every lag."""
    found = {}
    for q in range(1, len(words) // ratio + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, ratio * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def cut_runs(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


@pytest.mark.parametrize("cost", [12.0, 1e9, 1e-9])
def test_runs_equal_all_lags(monkeypatch, cost):
    """Whether words count as frequent (all by transforms), rare (all by pairs) or both."""
    monkeypatch.setattr(periods, "PAIR_COST", cost)
    rng = random.Random(1)
    for least, ratio in ((24, 3), (2, 2), (6, 4)):
        batch = []
        for _ in range(150):
            n, kinds = rng.choice([0, 1, 23, 24, 30, 100, 300]), rng.choice([1, 2, 3, 30])
            words = [b"%d" % rng.randrange(kinds) for _ in range(n)]
            for _ in range(rng.randrange(4) if n > 23 else 0):
                a, p = rng.randrange(n), rng.randrange(1, 12)
                for i in range(a + p, min(n, a + rng.randrange(10, n))):
                    words[i] = words[i - p]
            batch.append(words)
        assert periods.batch_runs(batch, least, ratio) == [all_runs(w, least, ratio) for w in batch]


def test_long_texts_of_few_words_have_their_runs():
    rng = random.Random(2)
    words = [b"%d" % rng.randrange(2) for _ in range(300_000)]
    words[1000:91_000] = words[1000:1300] * 300
    (found,) = periods.batch_runs([words], 24, 3)
    assert (300 in [q for _, _, q in found]) and all(words[s + i] == words[s + i + q] for s, n, q in found for i in range(n - q))
    assert periods.batch_runs([[b"a"] * 500_000], 24, 3) == [[(0, 500_000, 1)]]


def test_periodic_runs(spark):
    rows = periods.periodic_runs(table(spark, ODD)).orderBy("doc_id").collect()
    for r, t in zip(rows, ODD, strict=True):
        words = (t or "").encode().split()
        runs = all_runs(words)
        assert r["n_words"] == len(words) and [tuple(x) for x in r["runs"]] == runs
        assert r["collapsed"] == b" ".join(cut_runs(words, runs)).decode()
    assert rows[6]["collapsed"] == "a" and [tuple(x) for x in rows[6]["runs"]] == [(0, 40, 1)]
    assert periods.periodic_runs(table(spark, ["x"]).where("doc_id < 0")).count() == 0
    assert periods.periodic_runs(table(spark, ["a " * 40] * 2).withColumn("doc_id", F.lit(None).cast("long"))).where("size(runs) = 1").count() == 2


def test_op11(spark, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op11_periods"](spark, SMALL).collect()}
    assert rows.keys() == texts.keys()
    repeated = 0
    for i, t in texts.items():
        words, h = (t or "").encode().split(), zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs, r = all_runs(words), rows[i]
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if runs else None
        repeated += bool(runs)
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(cut_runs(words, runs))).hexdigest()
    assert repeated > 5


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))


def test_counts_of_all_prefixes_equal_the_library(spark, texts, monkeypatch):
    rng, lib = random.Random(3), library()
    made = ["".join(rng.choice(" ab\n▁éthe日s1") for _ in range(60)) for _ in range(60)]
    every = [*ODD, *made, *(t[:150] for t in texts.values())]
    monkeypatch.setattr(counts, "KEPT_WORDS", 50)
    own = counts.PrefixCounts(tokenizer_path(PIECES))
    for t in every[:40]:  # also where a worker starts afresh
        own.know(set(own.cut(t)))
        assert own.counts(own.cut(t)).tolist() == [len(lib.encode(t[:k])) for k in range(1, len(t or "") + 1)]
    found = counts.prefix_counts(table(spark, every), tokenizer_path(PIECES), limit=20)
    found = found.withColumns({f"first_{b}": counts.longest_prefix(b) for b in (0, 1, 7, 20)}).withColumns({f"at_{k}": counts.tokens_at(k) for k in (0, 3, 10**6)})
    for r in found.collect():
        t = every[r["doc_id"]] or ""
        want = [len(lib.encode(t[:k])) for k in range(len(t) + 1)]
        assert r["counts"] == want[1:] and r["n_tokens"] == want[-1] and r["over_limit"] == (want[-1] > 20)
        assert (r["n_chars"], r["n_bytes"]) == (len(t), len(t.encode()))
        assert r["fitting_chars"] == max(k for k, n in enumerate(want) if n <= 20)
        assert all(r[f"first_{b}"] == max(k for k, n in enumerate(want) if n <= b) for b in (0, 1, 7, 20))
        assert (r["at_0"], r["at_3"], r["at_1000000"]) == (0, want[min(3, len(t))], want[-1])
    assert counts.prefix_counts(table(spark, ["x"]).where("doc_id < 0"), tokenizer_path(PIECES)).count() == 0


def test_a_long_text_is_counted(spark):
    t = "the quick brown fox\njumps, 42 times. " * 60_000
    (r,) = counts.prefix_counts(table(spark, [t]), tokenizer_path(PIECES), keep_counts=False).collect()
    assert r["n_tokens"] == len(library().encode(t)) and len(library().encode(t[: r["fitting_chars"]])) <= 4096


def test_op12(spark, texts):
    lib = library()
    for r in QUERIES["op12_counts"](spark, SMALL).collect():
        t = texts[r["doc_id"]] or ""
        n = len(lib.encode(t))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 4096)
        assert n <= 4096 and r["fitting_chars"] == len(t) or n > 4096 and len(lib.encode(t[: r["fitting_chars"]])) <= 4096 < len(lib.encode(t[: r["fitting_chars"] + 1]))


def near(a, b):
    k = variants.shared(a, b)
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def grouped(words):
    """word -> (form, root, n, near words, n of the form), by comparing all words."""
    form, beside = {}, {w: [x for x in words if near(w, x)] for w in words}
    for w, n in words.items():
        best = min(beside[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(beside[w]), words.get(form[w]))
    return out


@pytest.mark.parametrize("letters", [5, 60, 10**6])
def test_variants_equal_all_comparisons(spark, monkeypatch, letters):
    """In one block of words or many."""
    monkeypatch.setattr(variants, "BLOCK_LETTERS", letters)
    rng = random.Random(letters)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7))): rng.choice([1, 2, 5, 10, 30, 200]) for _ in range(150)}
    words |= {"aaaa": 7, "aaa": 40, "a" * 3000: 1, "a" * 2999: 5, "a" * 1500 + "b" + "a" * 1499: 25}
    df = spark.createDataFrame(list(words.items()), "word string, n int").withColumns({c: F.lit(1) for c in ("form", "root", "block", "key", "how", "best", "own", "x")})
    df = df.unionByName(df.limit(1).withColumn("word", F.lit(None).cast("string"))).repartition(3)
    rows = variants.spelling_variants(df).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows} == grouped(words) and len(rows) == len(words)
    assert variants.spelling_variants(df.where("n < 0")).count() == 0


def test_a_word_with_very_many_variants(spark):
    """One form that nearly all words lead to, and a chain of forms."""
    words = {"abcdefgh"[:k] + c + "abcdefgh"[k:]: 1 for k in range(9) for c in "ijklmnopqrstuvwxyz"} | {"abcdefgh": 500, "abcdefg": 3000, "abcdef": 20_000}
    rows = variants.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows} == grouped(words)
    assert {r["root"] for r in rows} == {"abcdef"}


def words_of(texts, slip):
    out = Counter()
    for i, t in texts:
        for w in variants._RUN.findall((t or "").encode().lower().decode()):
            h = zlib.crc32(f"{i}:{w}".encode())
            out[w[: h % len(w)] + w[h % len(w) + 1 :] if slip and i is not None and not h % slip else w] += 1
    return {w: n for w, n in out.items() if w}


def test_word_counts(spark, texts, monkeypatch):
    monkeypatch.setattr(variants, "KEPT_WORDS", 100)
    every = [*ODD, "Été ÉTÉ été × ÷ ſ K I İ", *texts.values()]
    for slip in (None, 7):
        rows = variants.word_counts(table(spark, every), slip).collect()
        assert {r["word"]: r["n"] for r in rows} == words_of(enumerate(every), slip) and len({r["word"] for r in rows}) == len(rows)
    assert variants.word_counts(table(spark, ["x"]).where("doc_id < 0")).count() == 0


def test_op13(spark, texts):
    import duckdb

    words = {w: n for w, n in words_of(texts.items(), 199).items() if len(w) >= 6 and n >= 5}
    by_short = defaultdict(set)
    for w in words:
        for s in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            by_short[s].add(w)
    rows = QUERIES["op13_variants"](spark, SMALL).collect()
    assert {r["word"]: r["n"] for r in rows} == words
    for r in rows:
        w = r["word"]
        beside = {x for s in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))} for x in by_short[s] if near(w, x)}
        assert r["n_near"] == len(beside)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    cols = ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(str, con.execute(f"select {', '.join(cols)} from ({ORACLES['op13_variants']})").fetchall())) == sorted(str(tuple(r[c] for c in cols)) for r in rows)



def test_long_texts_are_cut_nowhere(spark, monkeypatch):
    """Texts of several megabytes: language bundles over spans, and the BPE of a text beyond a block."""
    import numpy as np

    from corpuscount.llm import bpe, language

    rng = random.Random(12)
    words = ["the", "Straße", "été", "x1", "naïve", "日本", "end.", "\n", "it's"]
    long = " ".join(rng.choice(words) + rng.choice(["", ",", "s"]) for _ in range(400_000))
    assert len(long) > language.SPAN
    whole = language.bundles([long, "the end"], 64)
    monkeypatch.setattr(language, "SPAN", 1000)
    assert np.array_equal(language.bundles([long, "the end"], 64), whole)
    lib = bpe.Pieces(tokenizer_path(), "library").library
    text = (long + " ") * 5
    assert len(text) > bpe.BLOCK_CHARS
    ids = lib.encode(text, add_special_tokens=False).ids
    for r in bpe.bpe_round_trip(table(spark, [text, "the end"]), tokenizer_path(), keep_ids=False).where("doc_id = 0").collect():
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
