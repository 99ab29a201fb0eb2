"""BPE encoding and decoding over a prefix-sharing trie.

The distinct words of a block of documents are inserted into a trie (in sorted order, so that the path to
the current word is a stack). A depth-first walk gives every node the *last token* of its prefix's
encoding: the only token that ends there and stands validly after the last token of the prefix before it.
A prefix that many words share is therefore encoded once, and a word's encoding is read off by following
last tokens back to the root.

A pair of tokens is valid when encoding the two tokens' symbols together gives the same two tokens.
A sequence is a word's BPE encoding exactly when every adjacent pair in it is valid.

Texts are cut at white space first. No pre-token of the vocabulary's pattern contains white space, and
neither NFC nor lower-casing looks across it, so a piece between white space always has the same ids.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscount.llm.exchange import trim
from corpuscount.runtime import prepare

#: Fixed value: what the vocabulary's pattern counts as a pre-token, here for pieces of ASCII and Latin-1 only.
LATIN_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-z0-9ªµºß-öø-ÿ²³¹¼½¾]+")
_LATIN = re.compile(r"[\x21-\x7e\xa1-\xff]+")
#: str.split() also cuts at these, which the vocabulary does not take as white space.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]+")
#: Pieces kept between blocks by a worker; when there are more, the worker starts afresh.
KEPT_PIECES, KEPT_PAIRS = 400_000, 1_000_000
#: Where no decoded texts are kept, there is room for more pieces.
KEPT_WITHOUT_TEXT = 1_000_000
#: A block of texts is encoded at once: at most so many characters (one text more than this is a block alone).
BLOCK_CHARS = 8_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Trie:
    """Encodes words (as byte strings) with the merges of a vocabulary with word ends."""

    def __init__(self, vocab: dict[str, int], merges: Iterable, end: str):
        self.rank = {}
        for n, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank.setdefault((a, b), n)
        letters = byte_letters()
        self.letters, self.end, self.vocab = letters, end, vocab
        code = {x: bytes([n]) for n, x in enumerate(letters)}
        self.symbols: dict[int, list[str]] = {}
        inner: dict[bytes, int] = {}
        final: dict[bytes, int] = {}
        for token, i in vocab.items():
            body, last = (token[: -len(end)], True) if token.endswith(end) else (token, False)
            if not body or any(x not in code for x in body):
                continue
            symbols = list(body)
            if last:
                symbols[-1] += end
            if self.merged(symbols) != [token]:
                continue  # no text is ever encoded with it
            self.symbols[i] = symbols
            (final if last else inner)[b"".join(code[x] for x in body)] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self._automaton(inner, final)

    def _automaton(self, inner: dict[bytes, int], final: dict[bytes, int]) -> None:
        """For every state (a longest suffix that begins some token): the tokens that end there, longest first."""
        step: dict[int, int] = {}  # state * 256 + byte -> state
        depth, own, kids = [0], [{}], [[]]
        for which, tokens in enumerate((inner, final)):
            for body, i in tokens.items():
                state = 0
                for c in body:
                    to = step.get(state << 8 | c)
                    if to is None:
                        to = step[state << 8 | c] = len(depth)
                        depth.append(depth[state] + 1)
                        own.append({})
                        kids.append([])
                        kids[state].append((c, to))
                    state = to
                own[state][which] = i
        fail, ends = [0] * len(depth), [((), ())] * len(depth)
        queue = [to for _, to in kids[0]]
        for state in queue:
            shorter = ends[fail[state]]
            ends[state] = tuple(((depth[state], own[state][w]), *shorter[w]) if w in own[state] else shorter[w] for w in (0, 1))
            for c, to in kids[state]:
                f = fail[state]
                while f and (f << 8 | c) not in step:
                    f = fail[f]
                fail[to] = step.get(f << 8 | c, 0)
                queue.append(to)
        self.step, self.fail, self.ends = step, fail, ends

    def move(self, state: int, c: int) -> int:
        """The next state where the trie of tokens has no edge; kept for the next time."""
        f = state
        while f and (f << 8 | c) not in self.step:
            f = self.fail[f]
        to = self.step[state << 8 | c] = self.step.get(f << 8 | c, 0)
        return to

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a few symbols: the lowest-ranked pair first, leftmost first."""
        out, rank = list(symbols), self.rank
        while len(out) > 1:
            best = min(range(len(out) - 1), key=lambda k: rank.get((out[k], out[k + 1]), 1 << 60))
            if (out[best], out[best + 1]) not in rank:
                break
            out[best : best + 2] = [out[best] + out[best + 1]]
        return out

    def valid(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            got = self.merged(self.symbols[a] + self.symbols[b])
            known = len(got) == 2 and got[0] == "".join(self.symbols[a]) and got[1] == "".join(self.symbols[b])
            self.pairs[a, b] = known
        return known

    def encode(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """The distinct words in order, each with its ids."""
        valid, pairs, step, ends, move = self.valid, self.pairs, self.step, self.ends, self.move
        last, size, states = [-1], [0], [0]  # of the path's first d bytes: last token, its bytes, state
        path = b""
        for word in sorted(words):
            n = len(word) - 1
            same, top = 0, min(len(path), n)
            if path[:top] == word[:top]:
                same = top
            else:
                while path[same] == word[same]:
                    same += 1
            del last[same + 1 :], size[same + 1 :], states[same + 1 :]
            state = states[same]
            for d in range(same, n):  # a new node of the trie
                c = word[d]
                to = step.get(state << 8 | c)
                state = move(state, c) if to is None else to
                for k, t in ends[state][0]:
                    before = last[d + 1 - k]
                    ok = True if before == -1 else pairs.get((before, t))
                    if valid(before, t) if ok is None else ok:
                        break
                else:
                    raise ValueError(f"no token ends {word[: d + 1]!r}")
                last.append(t)
                size.append(k)
                states.append(state)
            path = word[:n]
            c = word[n]
            to = step.get(state << 8 | c)
            for k, t in ends[move(state, c) if to is None else to][1]:  # the leaf, with the word end
                before = last[n + 1 - k]
                ok = True if before == -1 else pairs.get((before, t))
                if valid(before, t) if ok is None else ok:
                    break
            else:
                raise ValueError(f"no token ends {word!r}")
            ids, d = [t], n + 1 - k
            while d:
                ids.append(last[d])
                d -= size[d]
            ids.reverse()
            yield word, ids


class Pieces:
    """Maps each piece between white space to its ids as little-endian bytes, and to its decoded text.

    words: "trie" encodes new words over the trie and keeps decoded texts; "library" has the library encode
    them, and keeps no texts.
    """

    def __init__(self, path: str, words: str = "trie"):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model = spec["model"]
        end = model.get("end_of_word_suffix") or ""
        self.specials = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.marks = {x[:2] for x in self.specials}  # how special tokens begin: other texts aren't searched
        self.text = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.specials.items()}
        self.kept: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.decoded: dict[str, str] | None = {} if words == "trie" else None
        self.ends = np.zeros(max(self.text) + 1, bool)
        self.ends[[i for t, i in model["vocab"].items() if end and t.endswith(end)]] = True
        self.trie = Trie(model["vocab"], model["merges"], end) if words == "trie" else None
        self.unletter = {x: bytes([n]) for n, x in enumerate(byte_letters())}

    def words_of(self, piece: str) -> list[str]:
        """Its pre-tokens, normalised; beyond Latin-1 by the library's own tables."""
        if _LATIN.fullmatch(piece):
            low = piece.lower()
            piece = piece if low == piece else low  # both dictionaries then keep one string
            return [piece] if piece.isalpha() else LATIN_PRETOKEN.findall(piece)
        whole = self.library.normalizer.normalize_str(piece)
        unletter = self.unletter
        return [b"".join(unletter[x] for x in w).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(whole)]

    def ids_of(self, words: set[str]) -> Iterable[tuple[str, bytes]]:
        if self.trie is not None:
            return ((w.decode(), array("I", ids).tobytes()) for w, ids in self.trie.encode([w.encode() for w in words]))
        # one call of the library for all words, without the places in the text: each word ends with a token of a word end
        order = list(words)
        ids = np.array(self.library.encode_batch_fast([" ".join(order)], add_special_tokens=False)[0].ids, np.uint32)
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(stops) != len(order) or stops and stops[-1] != 4 * len(ids):
            raise ValueError("the vocabulary's words can't be told apart")
        raw = ids.tobytes()
        return zip(order, map(raw.__getitem__, map(slice, [0, *stops], stops)), strict=True)

    def learn(self, pieces: set[str]) -> None:
        """Encode what a block has of new pieces; their words are encoded once."""
        kept, words, decoded = self.kept, self.words, self.decoded
        new = pieces.difference(kept)
        if len(new) + len(kept) > (KEPT_WITHOUT_TEXT if decoded is None else KEPT_PIECES):
            kept.clear()
            words.clear()
            if decoded is not None:
                decoded.clear()
            new = pieces
        split = {p: self.words_of(p) for p in new}
        words.update(self.ids_of({w for ws in split.values() for w in ws}.difference(words)))
        for p, ws in split.items():
            kept[p] = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])
        if decoded is not None:
            text = self.text
            for p in new:
                decoded[p] = " ".join([text[i] for i in memoryview(kept[p]).cast("I")])

    def pieces(self, text: str | None) -> list[str]:
        if not text:
            return []
        if _NOT_SPACE.search(text):
            return [p for p in _SPACE.split(text) if p]
        return text.split()

    def parts(self, text: str | None) -> list[list[str] | str]:
        """Lists of pieces, and between them the special tokens that the text holds."""
        if text and self.cut and any(x in text for x in self.marks) and len(found := self.cut.split(text)) > 1:
            return [x if k % 2 else self.pieces(x) for k, x in enumerate(found)]
        return [self.pieces(text)]

    def encoded(self, texts: list[str | None]) -> Iterator[tuple[bytes, str | None]]:
        """For each text: its ids as little-endian unsigned 32-bit integers, and the decoded text if kept."""
        block: list[list] = []
        chars = 0
        for t in texts:
            block.append(self.parts(t))
            chars += len(t or "")
            if chars >= BLOCK_CHARS:
                yield from self._block(block)
                block, chars = [], 0
        yield from self._block(block)

    def _block(self, block: list[list]) -> Iterator[tuple[bytes, str | None]]:
        wanted: set[str] = set()
        for parts in block:
            for x in parts:
                if not isinstance(x, str):
                    wanted.update(x)
        self.learn(wanted)
        kept, decoded, specials = self.kept, self.decoded, self.specials
        for parts in block:
            if len(parts) == 1:
                own = parts[0]
                yield b"".join(map(kept.__getitem__, own)), " ".join(map(decoded.__getitem__, own)) if decoded is not None else None
                continue
            raw = [struct.pack("<I", specials[x]) if isinstance(x, str) else b"".join(map(kept.__getitem__, x)) for x in parts]
            texts = [x if isinstance(x, str) else " ".join(map(decoded.__getitem__, x)) for x in parts if x] if decoded is not None else None
            yield b"".join(raw), " ".join(texts) if texts is not None else None


@lru_cache(maxsize=2)
def pieces_of(path: str, words: str = "trie") -> Pieces:
    """The worker's own copy: read once, used by all its tasks."""
    return Pieces(path, words)


def bpe_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode every text by a vocabulary with word ends, and decode the ids again.

    Returns id, ``ids`` (array of long, only with keep_ids), n_tokens, ids_sha256, decoded (only with
    keep_ids), decoded_sha256. Null text counts as empty: no ids, and the digests of nothing. Rows are
    neither merged nor dropped, whatever they repeat; other columns of docs are left out; an empty table gives none.
    One pass, no shuffle; a worker's memory is bounded by a block of texts and by KEPT_PIECES.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces_of(tokenizer)
        gc.disable()  # millions of small tuples live long and form no cycles
        try:
            yield from coded(own, batches)
        finally:
            gc.enable()
            trim()

    def coded(own: Pieces, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digests, decoded, ids, texts = [], [], [], [], []
            for raw, text in own.encoded(b.column(1).to_pylist()):
                n.append(len(raw) // 4)
                digests.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
                if keep_ids:
                    ids.append(list(struct.unpack(f"<{len(raw) // 4}I", raw)))
                    texts.append(text)
            cols = {id_col: b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            if keep_ids:
                cols |= {"ids": pa.array(ids, pa.list_(pa.int64())), "decoded": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if keep_ids else "")
    return rows.mapInArrow(run, schema)
