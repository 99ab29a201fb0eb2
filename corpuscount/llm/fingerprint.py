"""Merkle fingerprints of documents.

A text is a tree: sections of paragraphs, paragraphs of leaves. A leaf is a sentence, which runs up to its full stops
and the white space after them; one of over LONG code points is cut into blocks. A paragraph is a line with its line break. A
section ends after an empty line, or after a paragraph whose hash ends in three zero bits, so that an edit moves no
section border but those it touches. Joined, the leaves give the text again.

Every node has a hash of 128 bits. A leaf's is that of its bytes; any other node's is that of its children's hashes alone,
with the node's level. So the root can be computed from the branches, and equal roots mean equal texts.

A fingerprint is text, and the whole tree: the root, then for each section its hash, and for each paragraph its hash and its
leaves, each with the leaf's length in code points. It stands by itself: where roots differ, equal sections are set
against each other first, then equal paragraphs of the sections that differ, then equal leaves of the paragraphs that
differ. What is left locates the edits.
"""

from __future__ import annotations

import hashlib
import re
from base64 import b64encode
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscount.runtime import parallelism, prepare

LONG, BLOCK = 64, 32
#: A section ends where the last but one of a paragraph's 22 base-64 digits is one of these 8 of 64.
_LAST = "08AIQYgo"
#: Ids that are looked at for each bound between ranges: they only even out the ranges.
SAMPLED = 50
_SENTENCE = re.compile(r"[^\n.!?]*(?:[.!?]+[^\S\n]*\n?|\n|\Z)")
#: A node: (its hash, its code points, its children; a leaf has none).
Node = tuple[str, int, tuple]
#: Root's hash, and the sections.
Tree = tuple[str, list[Node]]


def _hash(raw: bytes) -> str:
    return b64encode(xxhash.xxh3_128_digest(raw), b"-_")[:22].decode()


def leaves_of(text: str) -> Iterator[str]:
    for s in _SENTENCE.findall(text):
        if len(s) <= LONG:
            if s:
                yield s
        else:
            yield from (s[k : k + BLOCK] for k in range(0, len(s), BLOCK))


def node_of(level: str, children: list[Node]) -> Node:
    """The node over some children: level is p, s or r for paragraphs, sections and the root."""
    return _hash((level + "".join([c[0] for c in children])).encode()), sum([c[1] for c in children]), tuple(children)


def tree_of(text: str) -> Tree:
    sections: list[Node] = []
    paragraphs: list[Node] = []
    leaves: list[Node] = []
    for leaf in leaves_of(text):
        leaves.append((_hash(b"l" + leaf.encode("utf-8", "surrogatepass")), len(leaf), ()))
        if leaf[-1] == "\n":
            node = node_of("p", leaves)
            paragraphs.append(node)
            leaves = []
            if node[1] == 1 or node[0][20] in _LAST:
                sections.append(node_of("s", paragraphs))
                paragraphs = []
    if leaves:
        paragraphs.append(node_of("p", leaves))
    if paragraphs:
        sections.append(node_of("s", paragraphs))
    return node_of("r", sections)[0], sections


def render(tree: Tree) -> str:
    root, sections = tree
    leaf = lambda x: f"{x[0]}:{x[1]:x}"
    return "/".join([root, *[";".join([s[0], *[",".join([p[0], *map(leaf, p[2])]) for p in s[2]]]) for s in sections]])


def parse(fingerprint: str) -> Tree:
    root, *sections = fingerprint.split("/")

    def over(name: str, children: tuple) -> Node:
        return name, sum([c[1] for c in children]), children

    def paragraph(x: str) -> Node:
        name, *leaves = x.split(",")
        return over(name, tuple([(h, int(n, 16), ()) for h, n in (y.split(":") for y in leaves)]))

    def section(x: str) -> Node:
        name, *paragraphs = x.split(";")
        return over(name, tuple([paragraph(y) for y in paragraphs]))

    return root, [section(x) for x in sections]


def fingerprint_of(text: str | None) -> str:
    return render(tree_of(text or ""))


def _unmatched(a: list[Node], b: list[Node], at: list[int]) -> tuple[list[tuple[Node, int]], list[Node]]:
    """The nodes of a and of b that are left when equal ones are set against each other, first ones first; a's with their places."""
    have = Counter([x[0] for x in b])
    left, used = [], Counter()
    for x, place in zip(a, at, strict=True):
        if used[x[0]] < have[x[0]]:
            used[x[0]] += 1
        else:
            left.append((x, place))
    rest = []
    for x in b:
        if used[x[0]] > 0:
            used[x[0]] -= 1
        else:
            rest.append(x)
    return left, rest


def _places(nodes: list[Node], start: int) -> list[int]:
    out = [start]
    for x in nodes:
        out.append(out[-1] + x[1])
    return out[:-1]


def _differing(a: Tree | str, b: Tree | str) -> tuple[list[tuple[Node, int]], int]:
    """The leaves of a, with their places, that b doesn't have; and a's code points: level by level, only below what differs."""
    (ra, sa), (rb, sb) = (parse(x) if isinstance(x, str) else x for x in (a, b))
    total = sum([x[1] for x in sa])
    if ra == rb:
        return [], total
    left, rest = _unmatched(sa, sb, _places(sa, 0))
    for _ in range(2):  # paragraphs, then leaves
        own = [(c, place) for x, at in left for c, place in zip(x[2], _places(x[2], at), strict=True)]
        left, rest = _unmatched([x for x, _ in own], [c for x in rest for c in x[2]], [p for _, p in own])
    return left, total


def likeness(a: Tree | str, b: Tree | str) -> float:
    """Twice the code points in branches that both trees hold, over those of both: 1 for equal texts, 0 with nothing in common."""
    (ra, sa), (rb, sb) = (parse(x) if isinstance(x, str) else x for x in (a, b))
    if ra == rb:
        return 1.0
    own, total = _differing((ra, sa), (rb, sb))
    both = total + sum([x[1] for x in sb])
    return 2 * (total - sum([x[1] for x, _ in own])) / both if both else 1.0


def differing(a: Tree | str, b: Tree | str) -> list[tuple[int, int]]:
    """The spans of a, in code points, that lie in branches which b doesn't have."""
    out: list[tuple[int, int]] = []
    for (_, size, _), at in _differing(a, b)[0]:
        if out and out[-1][1] == at:
            out[-1] = (out[-1][0], at + size)
        else:
            out.append((at, at + size))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every whole text: id, n_chars, fingerprint. Null text counts as empty. One pass, no shuffle."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(fingerprint_of, texts), pa.string())], [id_col, "n_chars", "fingerprint"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_chars long, fingerprint string")


def in_descending_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, ghost, id, text): buckets are ranges of ids, each whole in one partition and in descending order, and
    each followed by a ghost: the row that comes next after the bucket's last one (after the last of all: the first).

    Only range bounds, a sample of ids for them, and the largest id of each range, one of each for a partition, come to the
    driver. The texts are moved once. Ids may be of any type that has an order and literals. Equal ids follow each other in
    the order of their texts; null ids come last.
    """
    n = parallelism(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    some = rows.select("id").where("id is not null").orderBy(F.xxhash64("id")).limit(SAMPLED * n).collect()
    ids = sorted(r[0] for r in some)
    cuts = sorted({ids[k * len(ids) // n] for k in range(1, n)}) if ids else []
    above_cuts = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("id"))) if cuts else F.lit(0)
    bucket = F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.lit(1) + above_cuts)
    most = {r[0]: r[1] for r in rows.select("id").groupBy(bucket.cast("int").alias("b")).agg(F.max("id")).collect()}
    have = sorted(most)
    above = {b: have[(k + 1) % len(have)] for k, b in enumerate(have)}
    first = F.lit(False)
    up = F.lit(None).cast("int")
    if have:
        table = F.create_map(*[F.lit(x) for b in have for x in (b, above[b])])
        tops = F.create_map(*[F.lit(x) for b in have if most[b] is not None for x in (b, most[b])]) if any(v is not None for v in most.values()) else None
        first = F.col("id").eqNullSafe(tops[F.col("bucket")]) if tops is not None else F.lit(True)
        up = table[F.col("bucket")]
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ghost"))
    there = F.struct(up.alias("bucket"), F.lit(1).alias("ghost"))
    sent = rows.withColumn("bucket", bucket.cast("int")).withColumn("to", F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here))))
    sent = sent.select("to.bucket", "to.ghost", "id", "text")
    return sent.repartitionById(n + 1, F.col("bucket")).sortWithinPartitions("bucket", "ghost", F.col("id").desc_nulls_last(), "text")


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every whole text and an edit of it, and compare them, and it with the next document's.

    The edited text has its last floor(n_chars/2) code points replaced by the first as many (or all) of the next
    document's in descending order of ids; after the last comes the first, so a single document follows itself.
    Null text counts as empty. Equal ids follow each other in the order of their texts, null ids come last, each
    row gives a row, and other columns of docs are left out; an empty table gives none.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    prepare(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before: bucket, id, text, tree
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for bucket, ghost, i, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                same = held is not None and held[0] == bucket
                if ghost and not same:
                    continue
                tree = tree_of(text)
                if same:
                    _, own_id, own, own_tree = held
                    half = len(own) // 2
                    edited = own[: len(own) - half] + text[:half]
                    edited_tree = tree_of(edited)
                    for col, v in zip(cols, (own_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), render(own_tree), render(edited_tree), likeness(own_tree, edited_tree), likeness(own_tree, tree)), strict=True):
                        col.append(v)
                held = None if ghost else (bucket, i, text, tree)
            types = [b.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return in_descending_order(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
