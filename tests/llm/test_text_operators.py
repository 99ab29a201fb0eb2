import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscount.llm import bpe, fingerprint, grams, language, packing, pii, scoring, suffixes
from corpuscount.llm.queries import QUERIES, tokenizer_path

SMALL = "/root/testdata/sf0.001"
ODD = ["", None, "a", "a", " \n\t", "x" * 3000, "Σίσυφος ΑΣ İstanbul", "<|endoftext|>x <|startoftext|>", "it's we'll don'T", "日本語 𝒳 \U0001f600!!", "\x1ca\x85b\xad", "one two\nthree. four! " * 40]


def table(spark, texts, first=0):
    """Texts with ids, and extra columns whose names are used inside the operators."""
    df = spark.createDataFrame([(first + k, x) for k, x in enumerate(texts)], "doc_id long, text string")
    return df.withColumns({c: F.lit(7) for c in ("h", "n", "block", "score", "id", "digits", "spans", "k")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def empty(spark):
    return table(spark, ["x"]).where("doc_id < 0")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_bpe_equals_the_library(spark, texts):
    lib = library()
    every = [*ODD, *texts.values()]
    for r in bpe.bpe_round_trip(table(spark, every), tokenizer_path()).collect():
        ids = lib.encode(every[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded"] == lib.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.bpe_round_trip(empty(spark), tokenizer_path()).count() == 0


def test_op10(spark, texts):
    lib = library()
    rows = QUERIES["op10_bpe"](spark, SMALL).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


@pytest.mark.parametrize("capacity", [4, 64, 4096])
def test_packing_holds_every_token_once(spark, texts, capacity):
    lib = library()
    every = [*ODD, *texts.values()][: 80 if capacity < 64 else None]
    rows = packing.harmonic_pack(table(spark, every), tokenizer_path(), capacity=capacity).collect()
    docs_, sequences = {}, {}
    for r in rows:
        assert r["length"] == len(r["ids"]) > 0 and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"]))
        docs_.setdefault(r["doc_id"], {})[r["start"]] = r["ids"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, t in enumerate(every):
        want, at = [*lib.encode(t or "", add_special_tokens=False).ids, 2], 0
        for start in sorted(docs_[k]):
            assert start == at and docs_[k][start] == want[at : at + len(docs_[k][start])]
            at += len(docs_[k][start])
        assert at == len(want)
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity and at & (at - 1) == 0  # nothing to pad
    assert packing.harmonic_pack(empty(spark), tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        packing.harmonic_pack(empty(spark), tokenizer_path(), capacity=100)


def test_op8(spark, texts):
    rows = QUERIES["op8_packing"](spark, SMALL).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and all(r["n"] == r["t"] for r in rows)


def edited(a, b):
    half = len(a) // 2
    return a[: len(a) - half] + b[:half]


def digest(raw):
    import base64

    import xxhash

    return base64.urlsafe_b64encode(xxhash.xxh3_128(raw).digest()).decode().rstrip("=")


def branches(f):
    """A fingerprint read by hand: the root, and sections as (hash, [(paragraph's hash, [(leaf's hash, length)])])."""
    root, *sections = f.split("/")
    out = []
    for x in sections:
        name, *paragraphs = x.split(";")
        out.append((name, [(p.split(",")[0], [(h, int(n, 16)) for h, n in (y.split(":") for y in p.split(",")[1:])]) for p in paragraphs]))
    return root, out


def by_hand(f, g):
    """Likeness from the branches: equal sections, then paragraphs, then leaves go together."""
    from collections import Counter

    (rf, sf), (rg, sg) = branches(f), branches(g)
    if rf == rg:
        return 1.0
    size = lambda node: node[1] if isinstance(node[1], int) else sum(map(size, node[1]))
    both = sum(map(size, sf)) + sum(map(size, sg))
    shared, a, b = 0, sf, sg
    for _ in range(3):
        same = Counter(x[0] for x in a) & Counter(x[0] for x in b)
        rest = []
        for nodes, counts in ((a, True), (b, False)):
            left = Counter(same)
            out = []
            for x in nodes:
                if left[x[0]]:
                    left[x[0]] -= 1
                    shared += size(x) if counts else 0
                else:
                    out.append(x)
            rest.append(out)
        a, b = ([c for x in r if not isinstance(x[1], int) for c in x[1]] for r in rest)
    return 2 * shared / both


def test_fingerprints(spark, texts):
    rows = {r["doc_id"]: r for r in QUERIES["op6_fingerprint"](spark, SMALL).collect()}
    order = sorted(texts, reverse=True)
    assert set(rows) == set(texts)
    for k, i in enumerate(order):
        nxt = texts[order[(k + 1) % len(order)]]
        e = edited(texts[i], nxt)
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(texts[i]), hashlib.sha256(e.encode()).hexdigest())
        assert r["fingerprint"] == fingerprint.fingerprint_of(texts[i]) and r["edited_fingerprint"] == fingerprint.fingerprint_of(e)
        assert r["near_edited"] == pytest.approx(by_hand(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(by_hand(r["fingerprint"], fingerprint.fingerprint_of(nxt)))
    for t in [*texts.values(), *(x or "" for x in ODD)]:  # the root, from the leaves up
        root, sections = branches(fingerprint.fingerprint_of(t))
        at = 0
        for name, paragraphs in sections:
            for own, leaves in paragraphs:
                for h, n in leaves:
                    assert h == digest(b"l" + t[at : at + n].encode())
                    at += n
                assert own == digest(("p" + "".join(h for h, _ in leaves)).encode())
            assert name == digest(("s" + "".join(h for h, _ in paragraphs)).encode())
        assert at == len(t) and root == digest(("r" + "".join(h for h, _ in sections)).encode())


def test_fingerprints_of_other_ids(spark):
    every = ["one. two. three.", "two. three. four.", "x", None]
    for ids in (["b", "a", "c", None], [__import__("datetime").date(2024, 1, k) for k in (2, 1, 3)] + [None]):
        kind = "string" if isinstance(ids[0], str) else "date"
        df = spark.createDataFrame(list(zip(ids, every)), f"doc_id {kind}, text string")
        order = [every[2], every[0], every[1], ""]
        got = {r["doc_id"]: r["edited_sha256"] for r in fingerprint.edit_fingerprints(df).collect()}
        assert got == {i: hashlib.sha256(edited(t, order[(k + 1) % 4]).encode()).hexdigest() for k, (i, t) in enumerate(zip((ids[2], ids[0], ids[1], None), order))}


def test_fingerprint_cases(spark, texts):
    for t in [x or "" for x in ODD] + list(texts.values())[:50]:
        assert "".join(fingerprint.leaves_of(t)) == t
        f = fingerprint.fingerprint_of(t)
        assert fingerprint.likeness(f, f) == 1 and fingerprint.differing(f, f) == []
    a = "One. Two two.\nThree.\n\nFour. Five."
    b = a.replace("Two two.", "Zwei zwei zwei.")
    assert [a[x:y] for x, y in fingerprint.differing(fingerprint.fingerprint_of(a), fingerprint.fingerprint_of(b))] == ["Two two.\n"]
    assert 0 < fingerprint.likeness(fingerprint.fingerprint_of(a), fingerprint.fingerprint_of(b)) < 1
    one = fingerprint.edit_fingerprints(table(spark, ["abcd"])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1
    rows = fingerprint.edit_fingerprints(table(spark, ODD).unionByName(table(spark, ["q", "r"]).withColumn("doc_id", F.lit(None).cast("long")))).collect()
    assert len(rows) == len(ODD) + 2
    assert fingerprint.edit_fingerprints(empty(spark)).count() == 0 and fingerprint.fingerprints(table(spark, ODD)).count() == len(ODD)


def test_language(spark, docs):
    rows = QUERIES["op1_language"](spark, "/root/testdata/sf0.01").collect()
    want = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(want) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(want[r["doc_id"]] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_cases(spark, docs):
    known = language.learn(docs)
    got = language.predict(table(spark, ODD).withColumn("lang", F.lit("zz")), known)
    rows = got.collect()
    assert len(rows) == len(ODD) and "lang" in got.columns and got.columns.count("score") == 1
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    none = language.learn(docs.where("false"))
    assert {r["lang_pred"] for r in language.predict(docs, none).select("lang_pred").collect()} == {"und"}
    assert language.predict(docs.where("false"), known).count() == 0
    again = language.learn(docs.repartition(7))
    assert again.languages == known.languages and (again.vectors == known.vectors).all()
    a, b, c = (language.letter_vector(ord(x), 512).astype(int) for x in "abc")
    import numpy as np

    key = np.array([ord("a") << 42 | ord("b") << 21 | ord("c")])
    assert (language.trigram_vectors(key, 512)[0] == np.roll(a, 2) * np.roll(b, 1) * c).all()


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(found):
    d = [int(c) for c in found if c.isdigit()]
    return 13 <= len(d) <= 19 and sum(v if k % 2 == 0 else sum(divmod(2 * v, 10)) for k, v in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    t = t or ""
    ok = {"email": lambda x: True, "ip": lambda x: all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in x.split(".")), "card": luhn, "phone": lambda x: 9 <= sum(c.isdigit() for c in x) <= 15}
    return [(k, m.start(), m.end()) for k, r in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)) for m in r.finditer(t) if ok[k](m[0])]


PERSONAL = ["1" * 3000, "1 2-" * 1500 + "9", "a.b@" * 500 + "c.d x@y.z", "é𝒳 x@y.co +1 (222) 333-4444 4111 1111 1111 1111 999.1.1.1 0.0.0.0 1.2.3.4.5", "+123456789", "1.2.3.4 " * 300, "x@y.z,x@y.z"]


def test_personal_data(spark, texts):
    every = [*ODD, *PERSONAL, *texts.values()]
    rows = pii.find_personal_data(table(spark, every)).collect()
    assert len(rows) == len(every)
    for r in rows:
        want = base_spans(every[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))
    assert pii.find_personal_data(empty(spark)).count() == 0


def test_bootstrapping_finds_unseen(spark):
    rng = random.Random(3)

    def card(valid):
        while True:
            x = "4" + "".join(rng.choice("0123456789") for _ in range(15))
            if luhn(x) == valid:
                return x

    every = [f"text {k} paid with card {card(True)} today" for k in range(12)] + [f"and card {card(False)} too", "a plain room 12 here", "number 1234567 alone"]
    rows = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(table(spark, every)).collect()}
    assert rows[12] == "card:9:25" and rows[13] == rows[14] == ""


def test_bootstrapping_finds_whole_spans(spark):
    rng = random.Random(5)

    def card(valid):
        while True:
            x = "".join(rng.choice("0123456789") for _ in range(16))
            if luhn(x) == valid:
                return " ".join(x[k : k + 4] for k in range(0, 16, 4))

    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    every = [f"card {card(True)} today" for _ in range(8)]
    every += [f"phone +1 ({k}17) 555-77{k}3 today" for k in range(1, 9)]
    every += [f"mail {name()}@{name()}.org today" for _ in range(8)]
    unseen = [("card 4111 1111 1111 1112 too", "card:5:24"), ("phone 020 7946 0958 too", "phone:6:19"), ("phone (017) 555-7713 too", "phone:6:20"), ("phone 112", "phone:6:9"), ("mail jane@localhost too", "email:5:19"), ("mail jane at example too", "email:5:20"), ("mail jane [at] example [dot] org too", "email:5:32"), ("mail é at é", "email:5:11")]
    unseen += [("phone +1 (017) 555-7713 phone (020) 7946", "phone:6:23,phone:30:40"), ("card 1.2.3.4 (020) phone 1.2.3.4 5", "ip:5:12,ip:25:32")]
    unseen += [("we met at noon in room 12", ""), ("on 020 7946 0958", "")]
    rows = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(table(spark, every + [t for t, _ in unseen])).collect()}
    assert [rows[len(every) + k] for k in range(len(unseen))] == [w for _, w in unseen]


def test_planted_identifiers_are_found_and_plain_numbers_left_alone(spark):
    """Contexts that tell, on either side and at any distance; contexts that stand before anything, and numbers of like shape."""
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice("the of and a in to report was sent on time by our team with new data".split()) for _ in range(4 * n))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(valid):
        while True:
            x = digits(16)
            if luhn(x) == valid:
                return x

    seeds, hidden, plain = [], [], []
    for k in range(60):
        seeds += [f"{prose(30)} visa {card(True)} {prose(30)}", f"{prose(20)} dial +44 {digits(3)} {digits(7)} tonight {prose(20)}", f"{prose(9)} write{' ' * 100}u{digits(3)}@mail{k % 9}.org {prose(9)}", f"{prose(9)} the {card(True)} {prose(5)}"]
    for _ in range(25):
        hidden += [(f"{prose(30)} visa {card(False)} {prose(3)}", "card"), (f"{prose(20)} dial 0{digits(2)} {digits(3)} {digits(4)} {prose(4)}", "phone"), (f"{prose(3)} write{' ' * 100}q{digits(2)} at mail dot org {prose(2)}", "email"), (f"ring {digits(3)} {digits(7)} tonight", "phone")]
        plain += [f"{prose(30)} the {card(False)} {prose(3)}", f"{prose(20)} of {digits(3)} {digits(7)} {prose(2)}", f"in {digits(4)} to {digits(16)} was {digits(3)} {digits(4)}", f"{prose(4)} met at noon {prose(3)}"]
    rows = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(table(spark, [*seeds, *(t for t, _ in hidden), *plain])).collect()}
    got = [rows[len(seeds) + k].split(":")[0] == kind for k, (_, kind) in enumerate(hidden)]
    left = [not set(rows[len(seeds) + len(hidden) + k].split(",")) - {f"{a}:{b}:{c}" for a, b, c in base_spans(t)} - {""} for k, t in enumerate(plain)]
    assert sum(got) / len(got) >= 0.9 and sum(left) / len(left) == 1.0


def test_words_written_onto_a_span_tell(spark):
    seeds = [f"reach us: tel:+44 20 7946 0{k:03d} or ({k}) see (+44 20 7946 1{k:03d})" for k in range(8)]
    unseen = [("tel:020 7946 0958", "phone:4:17"), ("see (020 7946 0958)", ""), ("x:020 7946 0958", "")]
    rows = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(table(spark, seeds + [t for t, _ in unseen])).collect()}
    assert [rows[len(seeds) + k] for k in range(3)] == [w for _, w in unseen]


def test_redaction(spark):
    every = ["mail a@b.co now", "clean 12 text", None, "1.2.3.4 and x@y.zz"]
    df = table(spark, every)
    got = pii.redact(df)
    assert got.columns == df.columns
    assert [r["text"] for r in got.orderBy("doc_id").collect()] == ["mail <email> now", "clean 12 text", None, "<ip> and <email>"]


def words_of(t):
    return [w for w in re.split(rb"[ \t-\r]+", (t or "").encode().lower()) if w]


def test_scoring(spark):
    import math
    from collections import Counter

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    tok = {i: [*words_of(t), None] for i, t in texts.items()}
    c = Counter(w for i in tok if not held[i] for w in tok[i])
    total, kinds = sum(c.values()), len(c)
    sums = Counter()
    for r in QUERIES["op2_scoring"](spark, "/root/testdata/sf0.01").collect():
        w = tok[r["doc_id"]]
        base = sum(math.log10((c[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(c[x] > 0 for x in w), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        if r["held_out"]:
            sums["base"] += r["base_score"]
            sums["model"] += r["score"]
    assert sums["model"] > sums["base"]


def test_scoring_cases(spark):
    rows = scoring.score(table(spark, ODD), F.col("doc_id") % 2 == 0).collect()
    assert len(rows) == len(ODD) and all(r["score"] <= 0 and r["n_tokens"] == len(words_of(ODD[r["doc_id"]])) + 1 for r in rows)
    assert {r["train_tokens"] for r in scoring.score(table(spark, ODD), F.lit(False)).collect()} == {0}
    assert scoring.score(empty(spark), F.lit(True)).count() == 0


def test_weights_by_expectation_maximisation():
    import pandas as pd

    none = scoring.NONE
    cells = pd.DataFrame({"bucket": [1, 1], "q3": [none, none], "q2": [-2, none], "q1": [-10, -4], "q0": [-12, -6], "n": [90, 10]})
    w = scoring.expectation_maximisation(cells).table
    assert w[1][1] == pytest.approx(0.9, abs=0.02) and w[1][0] == 0 and w.sum(axis=1) == pytest.approx(1)
    assert (w[5] == w[1]).all() and (w[0] == [0, 0, 0, 1]).all()


def test_weights_learned_by_tasks_equal_those_in_memory(spark):
    import pandas as pd

    rng = np.random.default_rng(5)
    cells = pd.DataFrame({"bucket": rng.integers(0, 30, 400), **{q: rng.choice([scoring.NONE, -2, -6, -11], 400) for q in ("q3", "q2", "q1")}, "q0": rng.integers(-20, -1, 400), "n": rng.integers(1, 99, 400)})
    whole = scoring.expectation_maximisation(cells).table
    twice = pd.concat([cells.assign(n=cells["n"] - 1), cells.assign(n=1)])
    assert np.allclose(scoring.learned_weights(spark.createDataFrame(twice).repartition(5)).table, whole, atol=1e-9)
    assert (scoring.learned_weights(spark.createDataFrame(twice).where("n < 0")).table == [0, 0, 0, 1]).all()


def mixture(tok, train, weights):
    """The score of every text, by plain counts of n-grams."""
    import math
    from collections import Counter

    one, two, three = Counter(), Counter(), Counter()
    grams_of = lambda w: zip(w, [None, *w[:-1]], [None, None, *w[:-2]][: len(w)])
    for i in train:
        for z, y, x in grams_of(tok[i]):
            one[z] += 1
            two[y, z] += 1
            three[x, y, z] += 1
    total, kinds = sum(one.values()), len(one)
    out = {}
    for i, w in tok.items():
        s = 0.0
        for k, (z, y, x) in enumerate(grams_of(w)):
            c1, c2 = one[y], one[None] if k == 0 else two[x, y]
            p = [three[x, y, z] / c2 if c2 else 0, two[y, z] / c1 if c1 else 0, one[z] / total, (one[z] + 0.1) / (total + 0.1 * (kinds + 1))]
            bucket = 1 + scoring.LOGS + int(math.log2(c2)) if c2 else 1 + int(math.log2(c1)) if c1 else 0
            s += math.log10(sum(a * b for a, b in zip(p, weights.table[bucket])))
        out[i] = s
    return out


@pytest.mark.parametrize("fan", [64, 2])
def test_scores_equal_plain_counts(spark, texts, monkeypatch, fan):
    made = []
    learn = scoring._learn
    monkeypatch.setattr(scoring, "_learn", lambda *a: made.append(learn(*a)) or made[0])
    every = [*ODD, *texts.values()]
    tok = {k: [*words_of(t), None] for k, t in enumerate(every)}
    got = {r["doc_id"]: r["score"] for r in scoring.score(table(spark, every), F.col("doc_id") % 5 != 0, fan=fan).collect()}
    want = mixture(tok, [k for k in tok if k % 5], made[0])
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


@pytest.mark.parametrize(("blocks", "fan"), [(1, 64), (7, 64), (7, 2), (10, 3), (65, 4)])
def test_exchange_of_lists(blocks, fan):
    """The tree's nodes by hand: counts of all blocks come back in each block's own order."""
    import numpy as np
    import pandas as pd

    from corpuscount.llm.exchange import Counts, Tree

    rng = np.random.default_rng(blocks)
    tree = Tree(blocks, [Counts(16), Counts(20, 2, most=3)], fan)
    own = []
    for _ in range(blocks):
        keys = [np.unique(rng.integers(0, 1 << b, rng.integers(0, 200)).astype(np.uint64)) for b in (16, 6)]
        own.append([(keys[0], rng.integers(1, 9, (1, len(keys[0])))), (keys[1], rng.integers(0, 2, (2, len(keys[1]))))])

    class Frame:
        """Rows by group, as Spark deals them."""

        def __init__(self, pdf):
            self.pdf = pdf

        def nodes(self):
            return self.pdf.groupby(["g", "r"])

    ups = [Frame(pd.concat([tree.sent(x, g) for g, x in enumerate(own)], ignore_index=True))]
    for level in range(1, tree.levels):
        ups.append(Frame(pd.concat([tree.sent([e for e, _ in tree._merged(p, r, level)], g, r, level) for (g, r), p in ups[-1].nodes()], ignore_index=True)))
    down = pd.concat([tree._returned(m := tree._merged(p, r, tree.levels), [e[1] for e, _ in m], r) for (g, r), p in ups[-1].nodes()], ignore_index=True)
    for level in range(tree.levels - 1, 0, -1):
        assert len(down) <= tree.width ** (tree.levels + 1)
        down = pd.concat([tree._returned(tree._merged(p, r, level), tree.answered(down[(down.g == g) & (down.r == r)]), r) for (g, r), p in ups[level - 1].nodes()], ignore_index=True)
    for k, most in ((0, 1 << 60), (1, 3)):
        total = {}
        for x in own:
            for key, c in zip(x[k][0].tolist(), x[k][1].T):
                total[key] = np.minimum(total.get(key, 0) + c, most)
        for g, x in enumerate(own):
            got = tree.answered(down[down.g == g])[k]
            assert got.T.tolist() == [total[key].tolist() for key in x[k][0].tolist()]


def test_word_hashes_and_packing_of_lists():
    import numpy as np

    t = "a  bb\tA é\x0bbb  "
    h = grams.word_hashes(t.encode().lower())
    assert len(h) == 5 and h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3
    v = np.sort(np.random.default_rng(0).integers(0, 1 << 56, 1000)).astype(np.uint64)
    assert (grams.unpacked(grams.packed(v)) == v).all()
    n = np.array([0, 1, 254, 255, 70000])
    assert (grams.unpacked_counts(grams.packed_counts(n)) == n).all()
    big = ("x" * 10 + " ") * 400_000
    assert len(set(grams.word_hashes(big.encode()).tolist())) == 1


def removal(every, length):
    from collections import Counter

    c = Counter()
    raws = [(t or "").encode() for t in every]
    for b in raws:
        c.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for b in raws:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if c[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(v for v, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(300):
        t = [rng.randrange(1, rng.choice([2, 3, 6]) + 1) for _ in range(rng.randrange(0, 60))] + [0]
        assert suffixes.grouping(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_many_suffix_arrays_at_once():
    import numpy as np

    rng = random.Random(1)
    for _ in range(100):
        ts = sorted(([rng.randrange(1, rng.choice([2, 3, 6]) + 1) for _ in range(rng.randrange(0, 60))] + [0] for _ in range(rng.randrange(1, 12))), key=len, reverse=True)
        off = np.cumsum([0, *map(len, ts)])
        got = suffixes.grouping_many(np.array(sum(ts, [])), off)
        for t, a, b in zip(ts, off[:-1], off[1:]):
            assert (got[a:b] - a).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_repeats_come_from_the_arrays(monkeypatch):
    """Without the suffix arrays nothing repeats, equal tiles included."""
    import numpy as np

    rows = np.zeros((3, 64), np.uint8)
    rows[:, 0] = rows[:, 32] = 31
    rows[2, 1:32] = 7
    core, several = np.array([5, 5, 9], np.uint64), np.array([False, False, True])
    rows[1, 40] = 1
    full = suffixes.repeated_starts(core, rows, several)
    assert full.tolist() == [(1 << 8) - 1, (1 << 8) - 1, (1 << 32) - 1]
    monkeypatch.setattr(suffixes, "_by_suffixes", lambda *a: np.zeros(0, np.int64))
    assert not suffixes.repeated_starts(core, rows, several).any()


def test_repeats(spark, texts, monkeypatch):
    rng = random.Random(2)
    ab = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    made = ["a" * 199, "a" * 200, "a" * 1000, "ab" * 300, ab[:200], ab[1:202], ab[100:420] + "X" + ab[500:719], "é" * 150, ab[2000:2200], "Q" + ab[2000:2200] + "Z", "R" + ab[1999:2201], ab[3000:3199], ab[3000:3199] + "K", ab[3500:3700], ab[3500:3700]]
    made += [ab[s : s + n] for s, n in ((rng.randrange(4500), rng.randrange(150, 500)) for _ in range(30))]
    every = [*ODD, *made, *texts.values()]
    want = removal(every, 200)
    for r in suffixes.remove_repeats(table(spark, every)).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]
    assert suffixes.remove_repeats(empty(spark)).count() == 0
    for length in (64, 100):
        monkeypatch.setattr(suffixes.repeated_spans, "__defaults__", ("text", 200, 2))  # a tree of several levels
        some = every[len(ODD) : len(ODD) + len(made)]
        assert [tuple(r)[1:] for r in suffixes.remove_repeats(table(spark, some), length=length).orderBy("doc_id").collect()] == removal(some, length)


def test_repeats_with_runs_of_nul(spark):
    import numpy as np

    rows = np.zeros((3, 32), np.uint8)
    rows[:, 0] = (31, 1, 31)
    assert suffixes._reach(np.zeros(3, np.uint64), rows).tolist() == [31, 1, 31]
    rng = random.Random(6)
    p = "".join(rng.choice("abcd") for _ in range(64))
    every = [f"{k}" + p[: 64 - k] + "\0" * n for k, n in enumerate((60, 1, 31, 0, 60, 33, 2, 200))] + ["\0" * n for n in (63, 64, 65, 130)]
    assert [tuple(r)[1:] for r in suffixes.remove_repeats(table(spark, every), length=64).orderBy("doc_id").collect()] == removal(every, 64)


def test_texts_without_repeats(spark):
    p = "".join(chr(97 + k * k % 26) for k in range(260)) + "é" * 30
    df = table(spark, ["one " + p, "two " + p + " end", None, "clean"]).withColumn("n_chars", F.lit(0))
    got = {r["doc_id"]: r for r in suffixes.without_repeats(df).collect()}
    assert (got[0]["text"].strip(), got[1]["text"].replace("  ", " "), got[2]["text"], got[3]["text"]) == ("one", "two end", None, "clean")
    assert got[3]["n_chars"] == 5 and suffixes.without_repeats(df).columns == df.columns


def test_library_words_are_encoded_without_places():
    """The library's plain encode also tracks each token's place in the text, which nothing here reads."""
    from types import SimpleNamespace

    texts = ["Plain words, plain", "naïve café 日本 x1y22 it's", "", None, "a\x1fb <unk>  z"]
    own, plain = bpe.Pieces(tokenizer_path(), "library"), library()
    own.library = SimpleNamespace(normalizer=plain.normalizer, pre_tokenizer=plain.pre_tokenizer, encode_batch_fast=plain.encode_batch_fast)
    want = [np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [raw for raw, _ in own.encoded(texts)] == want


def test_no_repeated_start_is_found_by_hashing(monkeypatch):
    """Steps of the construction are many and small: numpy's hashing unique() took a fifth of it."""
    plain = np.unique

    def unique(x, **asked):
        assert asked, "unique() without places or counts hashes its values"
        return plain(x, **asked)

    rng = np.random.default_rng(3)
    raw = [bytes(rng.integers(97, 99, 300, np.uint8)) + b"q" * 260 + bytes(rng.integers(97, 99, 40, np.uint8)) for _ in range(30)]
    raw += [raw[0][:280] + b"zz", raw[1][50:]]
    data = [np.frombuffer(x, np.uint8) for x in raw]
    monkeypatch.setattr(np, "unique", unique)
    got = [suffixes.tiles(b, 200) for b in data]
    core = np.concatenate([c for _, c in got])
    rows = np.concatenate([np.concatenate(suffixes.sides(b, f, 200), axis=1) for b, (f, _) in zip(data, got, strict=True)])
    c, r, times, place = suffixes.distinct_tiles(core, rows, np.ones(len(core), np.int64))
    masks = suffixes.repeated_starts(c, r, times > 1)[place].astype(np.uint64)
    seen = {}
    for k, x in enumerate(raw):
        for at in range(len(x) - 199):
            seen.setdefault(x[at : at + 200], []).append((k, at))
    want = {y for places in seen.values() if len(places) > 1 for y in places}
    owner = np.repeat(np.arange(len(raw)), [len(f) for f, _ in got])
    first = np.concatenate([f for f, _ in got])
    t, x = np.nonzero((masks[:, None] >> np.arange(suffixes.TILE, dtype=np.uint64)) & np.uint64(1))
    assert {(int(owner[k]), int(first[k] + y)) for k, y in zip(t, x, strict=True)} == want and len(want) > 100


def test_a_round_of_patterns_is_one_write_with_two_joins(spark, monkeypatch):
    """Rounds are many: what a pattern has and gains is summed in one exchange, and its change is seen as it is written."""
    plans, keep = [], pii.written
    monkeypatch.setattr(pii, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    # p0 has seeds; each next pattern shares an instance with the one before it
    rows = [("p0", f"s{k}", "card") for k in range(9)] + [x for k in range(6) for x in ((f"p{k}", f"i{k}", None), (f"p{k + 1}", f"i{k}", None))]
    found = pii.learned_patterns(spark.createDataFrame(rows, "pattern string, instance string, kind string")).collect()
    assert [(r["pattern"], r["kind"]) for r in found] == [("p0", "card")] and found[0]["score"] > 9 / 11
    assert len(plans) > 3 and not any("Join" in x for x in plans[:2]) and all(x.count("Join ") == 2 for x in plans[2:])
