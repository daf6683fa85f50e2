"""Token counts of a unigram tokenizer by count-only Viterbi, without making the tokens.

A text becomes a space mark before its first word and for every space, and is cut before each mark, as
the tokenizers library's Metaspace step does. Aho-Corasick finds all vocabulary pieces of a word; the
dynamic program keeps, for each end, the best score and the number of pieces on the way to it. The
library's rules are kept: scores add from left to right; of equal scores the path whose last piece starts
first stays; a character that is no piece by itself costs the lowest score less 10; such characters count
as their bytes where the vocabulary holds all of them, else a run of them is one unknown piece.

Defined cases: a null text counts as the empty one, with 0 tokens; repeated rows count alike; very long
words take time in proportion to their length; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_COST = 10.0
#: Words remembered within a task; beyond it the memory starts anew.
REMEMBERED = 200_000

_counters: dict[str, "Counter"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_COST
        pieces = {piece for piece, _ in vocabulary}
        self.bytes = {b for b in range(256) if f"<0x{b:02X}>" in pieces}
        self.alone = frozenset(p for p in pieces if len(p) == 1)
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """The number of tokens of one word. At an end, the machine names the longest piece first, so the
        path whose last piece starts first comes first, and only a better score displaces it."""
        if not self.alone.issuperset(word):
            return self._word_with_unknown(word)
        n = len(word)
        score, count = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        for last, (length, value) in self.machine.iter(word):
            start = last + 1 - length
            s = score[start] + value
            if s > score[last + 1]:
                score[last + 1] = s
                count[last + 1] = count[start] + 1
        return count[n]

    def _word_with_unknown(self, word: str) -> int:
        """As ``word``, where some character is no piece: the path is walked back to join unknown runs."""
        n = len(word)
        matches: list[list] = [[] for _ in range(n)]
        for end, value in self.machine.iter(word):
            matches[end].append(value)
        alone = [any(length == 1 for length, _ in found) for found in matches]
        score, origin = [0.0] * (n + 1), [0] * (n + 1)
        for end, found in enumerate(matches, 1):
            best, start = None, 0
            for length, value in sorted(found, reverse=True):  # by start
                s = score[end - length] + value
                if best is None or s > best:
                    best, start = s, end - length
            if not alone[end - 1]:
                s = score[end - 1] + self.unknown
                if best is None or s > best:
                    best, start = s, -end  # a negative origin marks an unknown character
            score[end], origin[end] = best, start
        count, at, run = 0, n, []
        while at > 0:
            if origin[at] < 0:
                run.append(word[at - 1])
                at -= 1
            else:
                count += 1 + self._unknown_tokens(run)
                run = []
                at = origin[at]
        return count + self._unknown_tokens(run)

    def _unknown_tokens(self, run: list[str]) -> int:
        if not run:
            return 0
        raw = "".join(run).encode("utf-8", "surrogatepass")
        return len(raw) if self.bytes.issuperset(raw) else 1

    def text(self, text: str) -> int:
        if not text:
            return 0
        if MARK in text:
            text = text.replace(MARK, " ")
        parts = text.split(" ")
        if parts[0] == "":
            parts = parts[1:]
        known, total = self.known, 0
        for part in parts:
            n = known.get(part)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = known[part] = self.word(MARK + part)
            total += n
        return total


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(read_vocabulary(path))
    return _counters[path]


def count_tokens(docs: DataFrame, text: str = "text", to: str = "n_tokens", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with the number of tokens of ``text`` in column ``to``."""
    path = vocabulary or default_path()

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = counter(path)
        for batch in batches:
            yield pd.Series([tool.text(x or "") for x in batch], dtype="int64")
        tool.known.clear()

    return docs.withColumn(to, tokens(F.col(text)))
