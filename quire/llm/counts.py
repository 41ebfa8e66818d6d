"""Token counts of a unigram tokenizer without its tokens.

The vocabulary's pieces are found by one Aho-Corasick automaton; dynamic programming over a word's ends carries the best score
and the number of pieces on its path. Ties go as in the tokenizers library's unigram model: ends are updated in the order of the
pieces' starts and only by a strictly better score, so the longest last piece wins; a character that is no piece of
its own costs ten less than the least score, and counts as its bytes where the vocabulary has all of these, else runs of
such characters count as one.

Words are cut at ASCII white space and before every word mark; each begins with the mark. Pieces do not cross words, so a
word's count is kept and looked up where it comes again.

Cases: null and empty texts, and texts of white space, have no tokens; texts of any length are counted whole; repeated rows are counted alike;
null ids are kept; an empty table gives no rows; columns besides id and text are ignored.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.base import slices, whole_text

MARK = "▁"
PENALTY = 10.0
SPACE = re.compile(r"[\x09-\x0D\x20]+")
MARKED = re.compile(f"{MARK}[^{MARK}]*")
BYTE = re.compile(r"<0x[0-9A-F]{2}>")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model: a path, or the name of one of the public tokenizers' files."""
    import sentencepiece

    if os.sep not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


class Counter(dict):
    """Pieces by word, kept for up to ``keep`` words."""

    def __init__(self, pieces: list[tuple[str, float]], keep: int = 400_000):
        import ahocorasick

        self.keep = keep
        self.unknown = min(s for _, s in pieces) - PENALTY
        self.has_bytes = sum(BYTE.fullmatch(p) is not None for p, _ in pieces) == 256
        self.machine = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.longest = max((len(p) for p, _ in pieces), default=1)

    def path(self, word: str) -> tuple[float, int]:
        """Score and number of pieces of the best path; what lies further back than the longest piece is forgotten."""
        n = len(word)
        size = min(n, self.longest) + 1
        score, count, open_unknown = [0.0] * size, [0] * size, [False] * size
        matches = self.machine.iter(word)
        ahead = next(matches, None)
        for end in range(1, n + 1):
            found = []
            while ahead is not None and ahead[0] < end:
                found.append(ahead[1])
                ahead = next(matches, None)
            best = None
            single = False
            for length, s in sorted(found, reverse=True) if len(found) > 1 else found:
                start = (end - length) % size
                single = single or length == 1
                if best is None or score[start] + s > best:
                    best, pieces = score[start] + s, count[start] + 1
            now, last = end % size, (end - 1) % size
            unknown = not single and (best is None or score[last] + self.unknown > best)
            if unknown:
                best, pieces = score[last] + self.unknown, count[last]
                if self.has_bytes:
                    pieces += len(word[end - 1].encode("utf-8", "surrogatepass"))
                elif not open_unknown[last]:
                    pieces += 1
            score[now], count[now], open_unknown[now] = best, pieces, unknown
        return score[n % size], count[n % size]

    def __missing__(self, word: str) -> int:
        out = sum(self.path(part)[1] for part in MARKED.findall(MARK + word))
        if len(word) <= 256:  # longer ones hardly come again
            self[word] = out
        return out

    def count(self, text: str) -> tuple[int, int]:
        """Words and tokens of a text."""
        if len(self) > self.keep:
            self.clear()
        words = [w for w in SPACE.split(text) if w]
        return len(words), sum(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every row."""

    def run(batches):
        by_word = counter(model)
        for b in slices(batches):
            found = [by_word.count(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([w for w, _ in found], pa.int64()), pa.array([t for _, t in found], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
