"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates, for every place of a text, the vocabulary's pieces that end there. Dynamic
programming carries the best score and the number of pieces of the path that has it; no path is kept. Tie rule, as
in public unigram tokenizers: of paths with equal scores up to a place, the one whose last piece is longest wins; a
character that is no piece by itself may be an unknown one, with the vocabulary's lowest score less 10.

With byte fallback an unknown character counts as many tokens as it has UTF-8 bytes. Without it, unknown characters
in a row count as one token.

Spaces become U+2581 and one is put before the text. Where no piece has U+2581 after another character, a text's
best path is made of those of its words, which are counted once and kept (up to WORDS_KEPT of them). With byte
fallback the same holds at line breaks, if no piece has one. The scores are doubles, summed within a word.

Null and empty texts have no tokens. Rows that repeat are counted one by one; other columns stay, except those that
have the name of an added column.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from papyra.llm.common import append_columns

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
WORDS_KEPT = 500_000
WORD = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
WORD_ONLY_SPACES = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """The pieces and scores of a sentencepiece model file, and whether it has byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)]
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(n) if not special[i]]
    return pieces, any(model.is_byte(i) for i in range(n))


class Counter(dict):
    """Word -> tokens. Missing words are counted by the automaton and kept."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        import ahocorasick

        super().__init__({"": 0})
        scores = dict(pieces)
        self.byte_fallback = byte_fallback
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.single = {p for p in scores if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.splits = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in scores)
        self.splits_lines = self.splits and byte_fallback and not any("\n" in p for p in scores)

    def viterbi(self, word: str) -> int:
        n = len(word)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        unknown_last = [False] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if len(self.automaton):
            for end, found in self.automaton.iter(word):
                ends[end].append(found)
        for end, char in enumerate(word):
            # longest first, so a later one wins only by a higher score
            for length, score in sorted(ends[end], reverse=True):
                if (before := best[end + 1 - length]) is not None and (best[end + 1] is None or before + score > best[end + 1]):
                    best[end + 1], count[end + 1], unknown_last[end + 1] = before + score, count[end + 1 - length] + 1, False
            if char not in self.single and best[end] is not None and (best[end + 1] is None or best[end] + self.unknown > best[end + 1]):
                tokens = len(char.encode()) if self.byte_fallback else not unknown_last[end]
                best[end + 1], count[end + 1], unknown_last[end + 1] = best[end] + self.unknown, count[end] + tokens, True
        return count[n]

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
            self[""] = 0
        n = self[word] = self.viterbi(word)
        return n

    def tokens(self, text: str | None) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if not self.splits:
            return self.viterbi(text)
        if not self.byte_fallback:
            # unknown characters in a row may meet at a border of words only if U+2581 is unknown itself
            return sum(map(self.__getitem__, WORD_ONLY_SPACES.findall(text))) if SPACE in self.single else self.viterbi(text)
        if not self.splits_lines:
            return sum(map(self.__getitem__, WORD_ONLY_SPACES.findall(text)))
        breaks = text.count("\n")
        if SPACE + SPACE in text or text.endswith(SPACE) or SPACE + "\n" in text:
            return breaks + sum(map(self.__getitem__, WORD.findall(text)))
        # the common case, split at speed: there are no spaces left in the text, so one can mark the borders
        return breaks + sum(map(self.__getitem__, text.replace(SPACE, " " + SPACE).replace("\n", " ").split(" ")))


_KEPT: dict[str, Counter] = {}


def _counter(key: str, shared) -> Counter:
    """The worker's counter for one call of count_tokens; its words serve all the worker's tasks."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Counter(*shared.value)
    return _KEPT[key]


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], byte_fallback: bool, text_col: str = "text") -> DataFrame:
    """Adds n_tokens. The vocabulary is of fixed size (a tokenizer's file) and is sent to the tasks."""
    shared, key = docs.sparkSession.sparkContext.broadcast((pieces, byte_fallback)), uuid.uuid4().hex

    def start():
        counter = _counter(key, shared)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array([counter.tokens(t) for t in batch.column(text_col).to_pylist()], pa.int64())]

        return work

    return append_columns(docs, T.StructType([T.StructField("n_tokens", T.LongType())]), start)
