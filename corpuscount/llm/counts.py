"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

The encoding of a prefix ends with one token, its last token; before it stands the encoding of a shorter prefix. So the
count of a prefix is the count of that shorter one, plus one, and the counts of all prefixes come from one walk over the text.
A last token is found among the pieces that end there: it is the one that stands validly after the shorter prefix's own last
token, where two pieces are valid side by side if encoding their characters together gives these two again. A sequence is an
encoding exactly when all its neighbours are valid, since merges go by rank and then from the left, and the first merge that
crossed a border would also cross it in the encoding of the two pieces beside it.

No piece of the vocabulary goes on with a blank after another character, so the walk starts anew at each word, and words that
share a prefix share its walk. A text's counts are those of its words, each added to what stands before it.
"""

from __future__ import annotations

import gc
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscount.llm.exchange import trim
from corpuscount.runtime import SMALL_BATCH, prepare

#: The character that stands for a blank in the vocabulary.
BLANK = "▁"
#: Words whose counts a worker keeps, and validities of pairs; beyond, it starts afresh.
KEPT_WORDS, KEPT_PAIRS = 300_000, 2_000_000


class PrefixCounts:
    """The counts of all prefixes under a sentencepiece vocabulary of the kind BPE.

    Vocabularies that change characters before they merge them, that have user-defined pieces or pieces with an inner blank
    are refused: counts of prefixes would mean something else there.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as schema

        spec = schema.ModelProto()
        own = sentencepiece.SentencePieceProcessor(model_file=path)
        spec.ParseFromString(own.serialized_model_proto())
        kinds = schema.ModelProto.SentencePiece
        rules = spec.normalizer_spec
        pieces = [(p.piece, p.score) for p in spec.pieces if p.type == kinds.NORMAL]
        if spec.trainer_spec.model_type != schema.TrainerSpec.BPE or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("the vocabulary isn't a plain BPE")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces) or any(BLANK in p.lstrip(BLANK) for p, _ in pieces):
            raise ValueError("the vocabulary has pieces that words can't be cut by")
        if not spec.trainer_spec.byte_fallback:
            raise ValueError("the vocabulary has no pieces for single bytes")
        self.lead = BLANK if rules.add_dummy_prefix else ""
        self.score = dict(pieces)
        self.pieces = [p for p, _ in pieces if self.merged(p) == [p]]  # others are never the outcome of merges
        self.pairs: dict[int, bool] = {}
        self._automaton()
        # a line end that is no part of any piece is a word of its own
        lines = any("\n" in p for p, _ in pieces)
        self.word = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+" if lines else f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
        #: counts at all prefixes of words, from the empty one on
        self.kept: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> list[str]:
        """Plain BPE of a few characters: the pair whose piece has the best score first, leftmost first."""
        out, score = list(text), self.score
        while len(out) > 1:
            best = max(range(len(out) - 1), key=lambda k: score.get(out[k] + out[k + 1], -np.inf))
            if out[best] + out[best + 1] not in score:
                break
            out[best : best + 2] = [out[best] + out[best + 1]]
        return out

    def _automaton(self) -> None:
        """For every state (a longest suffix that begins some piece): the pieces that end there, longest first."""
        step: dict[tuple[int, str], int] = {}
        depth, own, kids = [0], [-1], [[]]
        for i, piece in enumerate(self.pieces):
            state = 0
            for c in piece:
                to = step.get((state, c))
                if to is None:
                    to = step[state, c] = len(depth)
                    depth.append(depth[state] + 1)
                    own.append(-1)
                    kids.append([])
                    kids[state].append((c, to))
                state = to
            own[state] = i
        fail, ends = [0] * len(depth), [()] * len(depth)
        queue = [to for _, to in kids[0]]
        for state in queue:
            ends[state] = ((depth[state], own[state]), *ends[fail[state]]) if own[state] >= 0 else ends[fail[state]]
            for c, to in kids[state]:
                f = fail[state]
                while f and (f, c) not in step:
                    f = fail[f]
                fail[to] = step.get((f, c), 0)
                queue.append(to)
        self.step, self.fail, self.ends = step, fail, ends

    def move(self, state: int, c: str) -> int:
        """The next state where the pieces' trie has no edge."""
        f = state
        while f and (f, c) not in self.step:
            f = self.fail[f]
        return self.step.get((f, c), 0)

    def valid(self, a: int, b: int) -> bool:
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        one, two = self.pieces[a], self.pieces[b]
        known = self.pairs[a << 32 | b] = self.merged(one + two) == [one, two]
        return known

    def learn(self, words: Iterable[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Each of the distinct words with the counts of its prefixes, from the empty one on; words are written with BLANK.

        Words go in order, so the path to a word's shared prefix with the one before it is a stack: last tokens, their
        lengths, counts and states of the automaton are kept for it.
        """
        step, ends, pairs, move, valid = self.step, self.ends, self.pairs, self.move, self.valid
        last, counts, states = [-1], [0], [0]
        before = ""
        for word in sorted(words):
            same, top = 0, min(len(word), len(before))
            while same < top and word[same] == before[same]:
                same += 1
            del last[same + 1 :], counts[same + 1 :], states[same + 1 :]
            state = states[same]
            for d in range(same, len(word)):
                c = word[d]
                to = step.get((state, c))
                state = move(state, c) if to is None else to
                for size, piece in ends[state]:
                    prior = last[d + 1 - size]
                    ok = True if prior < 0 else pairs.get(prior << 32 | piece)
                    if valid(prior, piece) if ok is None else ok:
                        last.append(piece)
                        counts.append(counts[d + 1 - size] + 1)
                        break
                else:  # in no piece: a token for each of its bytes, and nothing merges across it
                    last.append(-1)
                    counts.append(counts[d] + len(c.encode()))
                states.append(state)
            before = word
            yield word, tuple(counts)

    def cut(self, text: str | None) -> list[str]:
        """The words of a text, with the blanks before them and written with BLANK; a line end is a word of its own."""
        return self.word.findall(self.lead + text.replace(" ", BLANK)) if text else []

    def know(self, wanted: set[str]) -> None:
        """Have the counts of these words at hand."""
        new = wanted.difference(self.kept)
        if len(self.kept) + len(new) > KEPT_WORDS:
            self.kept.clear()
            new = wanted
        self.kept.update(self.learn(new))

    def totals(self, words: list[str]) -> list[int]:
        """Tokens up to the end of each word."""
        kept = self.kept
        return list(accumulate([kept[w][-1] for w in words]))

    def fitting(self, words: list[str], limit: int) -> int:
        """Code points of the longest prefix with at most limit tokens."""
        totals = self.totals(words)
        k = bisect_right(totals, limit)  # the first word that ends beyond the limit; after it all counts are larger
        chars = sum(map(len, words[:k]))
        if k < len(words):
            left = limit - (totals[k - 1] if k else 0)
            chars += max(d for d, n in enumerate(self.kept[words[k]]) if n <= left)
        return max(0, chars - len(self.lead))

    def counts(self, words: list[str]) -> np.ndarray:
        """The counts of all prefixes of the text, from that of one code point on."""
        kept, out, before = self.kept, [], 0
        for w in words:
            own = np.array(kept[w][1:], np.int32) + before
            out.append(own)
            before = int(own[-1])
        return np.concatenate(out)[len(self.lead) :] if out else np.zeros(0, np.int32)


@lru_cache(maxsize=2)
def counts_of(path: str) -> PrefixCounts:
    """The worker's own copy: read once, used by all its tasks."""
    return PrefixCounts(path)


def prefix_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", keep_counts: bool = True) -> DataFrame:
    """Counts the tokens of every prefix of every text under a sentencepiece vocabulary of the kind BPE.

    Counts are those of the library's encode() of the prefix alone, with the model's own blank before the text but no token
    that stands for a beginning or an end; strings that look like such a token are ordinary text.

    Returns id, n_chars long (code points), n_bytes long (UTF-8), n_tokens long, over_limit boolean (n_tokens > limit),
    fitting_chars long (code points of the longest prefix with at most limit tokens) and, with keep_counts, counts
    array<int>: the tokens of the first 1, 2, ... n_chars code points. A written table of these answers tokens_at() and
    longest_prefix() without a vocabulary.

    Null text counts as empty: no token, no counts. Rows are neither merged nor dropped, whatever ids and texts they repeat;
    null ids stay. Other columns are left out, whatever their names; an empty table gives none. One pass without a shuffle;
    a worker's memory is bounded by an Arrow batch (or the longest text), KEPT_WORDS and KEPT_PAIRS.
    """
    prepare(docs.sparkSession, SMALL_BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counts_of(model)
        gc.disable()  # millions of small tuples live long and form no cycles
        try:
            for b in batches:
                words = [own.cut(t) for t in b.column(3).to_pylist()]
                own.know(set(chain.from_iterable(words)))
                kept = own.kept
                tokens = [sum([kept[x][-1] for x in w]) for w in words]
                chars = b.column(1).to_pylist()
                fitting = [n if t <= limit else own.fitting(w, limit) for n, t, w in zip(chars, tokens, words, strict=True)]
                cols = [*b.columns[:3], pa.array(tokens, pa.int64()), pa.array(fitting, pa.int64())]
                if keep_counts:
                    cols.append(pa.array([own.counts(w) for w in words], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names)
        finally:
            gc.enable()
            trim()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.char_length(text).cast("long").alias("n_chars"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    names = ["id", "n_chars", "n_bytes", "n_tokens", "fitting_chars", *(["counts"] if keep_counts else [])]
    kind = rows.schema[0].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_chars long, n_bytes long, n_tokens long, fitting_chars long" + (", counts array<int>" if keep_counts else ""))
    return out.select(F.col("id").alias(id_col), "n_chars", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fitting_chars", *names[5:])


def tokens_at(chars: Column | int, counts: str = "counts") -> Column:
    """Tokens of the first so many code points of a text (all, if it has fewer), from its stored counts."""
    at = F.least(chars if isinstance(chars, Column) else F.lit(chars), F.size(counts))
    return F.when(at <= 0, F.lit(0)).otherwise(F.try_element_at(F.col(counts), at.cast("int")))


def longest_prefix(budget: Column | int, counts: str = "counts") -> Column:
    """Code points of the longest prefix with at most so many tokens, from a text's stored counts.

    Counts may fall from one prefix to the next, so it is the last such prefix that counts, not the first one's end.
    """
    from_end = F.array_position(F.reverse(F.transform(counts, lambda n: n <= budget)), True)
    return F.when(from_end > 0, F.size(counts) - from_end + 1).otherwise(F.lit(0)).cast("long")
