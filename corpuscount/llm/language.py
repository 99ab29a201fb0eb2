"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds its letters' vectors, permuted by their
place: rot2(a) * rot1(b) * c, elementwise. A text's vector bundles (adds up) those of all its trigrams, and a
language's prototype bundles those of all its training texts. The prediction is the prototype with the largest
cosine to the text.

Letters are what Unicode calls letters, in lower case; any run of other characters counts as one blank.
Bundles are sums of whole numbers, so neither partitions nor their order change a prototype.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuscount.llm.exchange import trim
from corpuscount.runtime import SMALL_BATCH, prepare

DIMENSIONS, SEED = 1024, 7
#: Texts counted together, trigram vectors made at a time, and code points of a text taken at a time.
TEXTS, ROWS, SPAN = 64, 4096, 1 << 20
#: A blank, where a word begins or ends.
BLANK = 0x20
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """For every code point: its lower-case letter, or BLANK."""
    codes = np.full(0x110000, BLANK, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            codes[c] = ord(low) if len(low) == 1 else c
    return codes


@lru_cache(maxsize=1 << 13)
def letter_vector(code: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng([SEED, code]).integers(0, 2, dimensions, np.int8) * np.int8(2) - np.int8(1)


def trigram_vectors(keys: np.ndarray, dimensions: int) -> np.ndarray:
    """Row k: the vector of trigram keys[k], as -1 and +1."""
    parts = [(keys >> s) & 0x1FFFFF for s in (42, 21, 0)]
    letters, places = np.unique(np.concatenate(parts), return_inverse=True)
    vectors = np.stack([letter_vector(int(x), dimensions) for x in letters])
    a, b, c = places.reshape(3, -1)
    return np.roll(vectors, 2, axis=1)[a] * np.roll(vectors, 1, axis=1)[b] * vectors[c]


def trigrams(text: str) -> Iterator[np.ndarray]:
    """The keys of all trigrams of a text, in spans of bounded length."""
    codes = letter_codes()
    tail = np.full(1, BLANK, np.int64)
    for at in range(0, len(text), SPAN):
        last = at + SPAN >= len(text)
        own = codes[np.frombuffer(text[at : at + SPAN].encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        own = np.concatenate([tail, own, np.full(int(last), BLANK, np.int64)])
        blank = own == BLANK
        own = own[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]
        if len(own) >= 3:
            yield own[:-2] << 42 | own[1:-1] << 21 | own[2:]
        tail = own[-2:]


def bundles(texts: list[str], dimensions: int) -> np.ndarray:
    """Row k: the vector of texts[k]. Zero for a text without a letter."""
    keys, owner, times = [], [], []
    for k, text in enumerate(texts):
        for span in trigrams(text):
            u, n = np.unique(span, return_counts=True)
            keys.append(u)
            times.append(n)
            owner.append(np.full(len(u), k))
    out = np.zeros((len(texts), dimensions), np.float64)
    if not keys:
        return out
    distinct, column = np.unique(np.concatenate(keys), return_inverse=True)
    owner, times = np.concatenate(owner), np.concatenate(times)
    order = np.argsort(column, kind="stable")
    column, owner, times = column[order], owner[order], times[order]
    for at in range(0, len(distinct), ROWS):
        lo, hi = np.searchsorted(column, (at, at + ROWS))
        part = distinct[at : at + ROWS]
        counts = np.zeros((len(texts), len(part)), np.float32)
        np.add.at(counts, (owner[lo:hi], column[lo:hi] - at), times[lo:hi])
        # float32 sums are exact below 2**24 trigrams; SPAN keeps each span's counts far below that
        out += counts @ trigram_vectors(part, dimensions).astype(np.float32)
    return out


def expected(text: str, dimensions: int) -> tuple[np.ndarray, int]:
    """The vector that independent letters would give on average, as often used and in words as long as the text's; and the number of distinct trigrams."""
    spans = list(trigrams(text))
    if not spans:
        return np.zeros(dimensions), 0
    keys, times = np.unique(np.concatenate(spans), return_counts=True)
    a, b, c = ((keys >> s) & 0x1FFFFF for s in (42, 21, 0))
    kinds = np.bincount((a == BLANK) * 4 + (b == BLANK) * 2 + (c == BLANK), weights=times, minlength=8)
    inner = b != BLANK
    letters, place = np.unique(b[inner], return_inverse=True)
    share = np.bincount(place, weights=times[inner])
    mean, blank = np.zeros(dimensions), letter_vector(BLANK, dimensions).astype(np.float64)
    for x, n in zip(letters.tolist(), share / share.sum(), strict=True):
        mean += n * letter_vector(x, dimensions)
    of = (mean, blank)
    out = sum(n * np.roll(of[k >> 2 & 1], 2) * np.roll(of[k >> 1 & 1], 1) * of[k & 1] for k, n in enumerate(kinds) if n)
    return out, len(keys)


def structures(texts: list[str], dimensions: int) -> np.ndarray:
    """bundles() less expected(), in whole numbers: how letters follow one another. Near 0 in any direction for random letters."""
    return np.rint(bundles(texts, dimensions) - np.stack([expected(x, dimensions)[0] for x in texts]))


@dataclass(frozen=True)
class Prototypes:
    """Languages in alphabetical order, and a prototype for each, of length 1."""

    languages: tuple[str, ...]
    vectors: np.ndarray

    @property
    def dimensions(self) -> int:
        return self.vectors.shape[1]


#: More languages than this are refused: the prototypes, of DIMENSIONS numbers each, go to every executor.
MOST_LANGUAGES = 10_000


def learn(training: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, vectors=bundles) -> Prototypes:
    """Prototypes from all rows of training with a language and a text; vectors: bundles or structures.

    Every partition bundles its rows by language; what is exchanged and gathered has a row for each language and
    dimension (and partition), whatever the number of texts.
    """
    prepare(training.sparkSession, SMALL_BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(texts), TEXTS):
                own = vectors(texts[at : at + TEXTS], dimensions)
                for lang, v in zip(langs[at : at + TEXTS], own, strict=True):
                    sums[lang] = sums.get(lang, 0) + v
        for lang, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * dimensions), "dim": pa.array(range(dimensions), pa.int32()), "v": pa.array(v.astype(np.int64), pa.int64())})
        trim()

    rows = training.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    got = rows.mapInArrow(run, "lang string, dim int, v long").groupBy("lang", "dim").agg(F.sum("v").alias("v")).limit(MOST_LANGUAGES * dimensions + 1).toPandas()
    if len(got) > MOST_LANGUAGES * dimensions:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not len(got):
        return Prototypes((), np.zeros((0, dimensions)))
    grid = got.pivot(index="lang", columns="dim", values="v").sort_index()
    sums = grid.to_numpy(np.float64)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return Prototypes(tuple(grid.index), np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0))


def cosines(texts: list[str], known: Prototypes) -> tuple[np.ndarray, np.ndarray]:
    """Cosine of every text with every prototype, and whether the text has a letter at all."""
    own = bundles(texts, known.dimensions)
    norm = np.linalg.norm(own, axis=1, keepdims=True)
    return np.divide(own, norm, out=np.zeros_like(own), where=norm > 0) @ known.vectors.T, norm[:, 0] > 0


def predict(docs: DataFrame, known: Prototypes, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with two more columns, ``lang_pred`` and ``score`` (with a prefix to their names).

    lang_pred: the language whose prototype has the largest cosine with the text's vector; ties go to the
    alphabetically first. score: that cosine, 0 where it is negative. ``und`` and 0 for a null text, one
    without a letter, and all texts if no language is known. Every row stays, with all its columns as they are
    (one named as the new ones, prefix included, is replaced). One pass, no shuffle; an empty table stays empty.
    """
    spark = prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (f"{prefix}lang_pred", f"{prefix}score")]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    place = kept.index(text_col)
    model = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for b in batches:
            texts = b.column(place).to_pylist()
            langs, scores = [], []
            for at in range(0, len(texts), TEXTS):
                part = [x or "" for x in texts[at : at + TEXTS]]
                if not own.languages:
                    langs += [UNKNOWN] * len(part)
                    scores += [0.0] * len(part)
                    continue
                cos, has = cosines(part, own)
                best = cos.argmax(axis=1)
                langs += [own.languages[k] if ok else UNKNOWN for k, ok in zip(best, has, strict=True)]
                scores += [min(1.0, max(0.0, float(c[k]))) if ok else 0.0 for c, k, ok in zip(cos, best, has, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*kept, f"{prefix}lang_pred", f"{prefix}score"])
        trim()

    for name, t in ((f"{prefix}lang_pred", "string"), (f"{prefix}score", "double")):
        schema = schema.add(name, t)
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def likeness(docs: DataFrame, known: Prototypes, text_col: str = "text", prefix: str = "__") -> DataFrame:
    """docs with four more columns: ``letters``, ``distinct``, ``like`` and ``best`` (with a prefix to their names).

    letters: whether the text has one; distinct: how many distinct trigrams; like: the largest cosine of the text's
    structure with those of known (learned with vectors=structures), 0 where none is known; best: the language that has it,
    the alphabetically first of equal ones, null where none is known. Null texts count as empty.
    """
    spark = prepare(docs.sparkSession, SMALL_BATCH)
    schema = StructType(list(docs.schema))
    names = [*docs.columns, *[f"{prefix}{c}" for c in ("letters", "distinct", "like", "best")]]
    place = docs.columns.index(text_col)
    model = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for b in batches:
            texts = [x or "" for x in b.column(place).to_pylist()]
            distinct, like, best = [], [], []
            for at in range(0, len(texts), TEXTS):
                part = texts[at : at + TEXTS]
                means, n = zip(*[expected(x, own.dimensions) for x in part], strict=True)
                distinct += n
                if not own.languages:
                    like += [0.0] * len(part)
                    best += [None] * len(part)
                    continue
                v = np.rint(bundles(part, own.dimensions) - np.stack(means))
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                cos = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0) @ own.vectors.T
                like += cos.max(axis=1).tolist()
                best += [own.languages[k] for k in cos.argmax(axis=1)]
            letters = [any(c.isalpha() for c in x) for x in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(letters, pa.bool_()), pa.array(distinct, pa.int32()), pa.array(like, pa.float64()), pa.array(best, pa.string())], names)
        trim()

    for c, t in zip(names[-4:], ("boolean", "integer", "double", "string"), strict=True):
        schema = schema.add(c, t)
    return docs.mapInArrow(run, schema)


def chance(known: Prototypes, odds: float = 1e-3) -> float:
    """A cosine that a random vector reaches with the nearest of the prototypes at these odds or less."""
    return float(np.sqrt(2 * np.log(max(1, len(known.languages)) / odds) / known.dimensions))


def fold(id_col: str, n: int):
    """crc32 of the id as text, modulo n; ids that are null count as fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(0))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_out: int = 1, dimensions: int = DIMENSIONS) -> DataFrame:
    """Learn from the rows whose fold isn't held out and that have a language; predict every row.

    Returns id, held_out, lang_pred, score. See learn() and predict() for nulls, ties and empty tables.
    """
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (fold(id_col, folds) == held_out).alias("held_out"))
    known = learn(rows.where(~F.col("held_out")), dimensions=dimensions)
    return predict(rows.select(id_col, "held_out", "text"), known).select(id_col, "held_out", "lang_pred", "score")
