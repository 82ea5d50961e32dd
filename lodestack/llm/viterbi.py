"""Token counts under a unigram vocabulary: Aho-Corasick matches and a Viterbi pass that keeps score and count only."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import KEPT, text_slices, tidy

#: Bytes that kept results of segments may take in a worker, about; a full cache is emptied, and each one when its task ends.
CACHE = 48 << 20
#: Bytes of a kept segment besides its characters.
ENTRY = 220
#: Longer segments aren't kept.
LONG = 64
MARK = "▁"
#: What a character without a piece costs below the lowest score; a fixed value of the tokenizer.
UNKNOWN_PENALTY = 10.0


class Unigram:
    """Counts pieces of the best segmentation of a text under pieces with scores.

    The tie rules are those of the tokenizer: ends are reached by pieces from the left; a later start replaces an
    earlier one only if its sum is strictly larger, so of equal paths the one with the longest last piece stays. A
    character that starts no piece of its own length is unknown: it scores the lowest score less a penalty, and a
    run of unknown characters on the best path counts as its UTF-8 bytes (byte fallback) or as one piece."""

    def __init__(self, pieces: dict[str, float], byte_fallback: bool = True, cache: int = CACHE):
        if not pieces:
            raise ValueError("the vocabulary is empty")
        self.machine = ahocorasick.Automaton()
        for p, score in pieces.items():
            self.machine.add_word(p, (len(p), score))
        self.machine.make_automaton()
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.fallback, self.size, self.weight = byte_fallback, cache, 0
        #: No piece has a mark after another character: then no piece spans the start of a segment and a text's
        #: best path is that of its segments, one after the other.
        self.split = byte_fallback and not any(MARK in p.lstrip(MARK) for p in pieces) and MARK in pieces
        self.kept: dict[str, tuple[float, int]] = {}

    def best(self, text: str) -> tuple[float, int]:
        """Score and number of pieces of a text in the vocabulary's own alphabet."""
        n = len(text)
        score: list = [None] * (n + 1)
        count, open_run = [0] * (n + 1), [False] * (n + 1)
        ending: list = [()] * n
        for end, piece in self.machine.iter(text):  # longest first: the earliest start
            if ending[end]:
                ending[end].append(piece)
            else:
                ending[end] = [piece]
        score[0] = 0.0
        for end in range(1, n + 1):
            top, at, known, single = None, 0, False, False
            for size, s in ending[end - 1]:
                single = single or size == 1
                total = score[end - size] + s
                if top is None or total > top:
                    top, at, known = total, end - size, True
            if not single and (top is None or score[end - 1] + self.unknown > top):
                top, at, known = score[end - 1] + self.unknown, end - 1, False
            score[end], open_run[end] = top, not known
            if known:
                count[end] = count[at] + 1
            elif self.fallback:
                count[end] = count[at] + len(text[at:end].encode())
            else:
                count[end] = count[at] + (not open_run[at])
        return score[n], count[n]

    def forget(self) -> None:
        self.kept.clear()
        self.weight = 0

    def count(self, text: str) -> tuple[float, int]:
        """Score and number of pieces of a plain text: blanks become marks and one more stands in front."""
        if not text:
            return 0.0, 0
        marked = MARK + text.replace(" ", MARK)
        if not self.split:
            return self.best(marked)
        total, n, kept = 0.0, 0, self.kept
        blanks = 1
        for word in marked[1:].split(MARK):  # marks before a word belong to its segment
            if not word:
                blanks += 1
                continue
            segment = MARK * blanks + word
            blanks = 1
            found = kept.get(segment)
            if found is None:
                found = self.best(segment)
                if len(segment) <= LONG:
                    self.weight += ENTRY + 2 * len(segment)
                    if self.weight > self.size:
                        self.forget()
                    kept[segment] = found
            total += found[0]
            n += found[1]
        if blanks > 1:
            s, k = self.best(MARK * (blanks - 1))
            total, n = total + s, n + k
        return total, n


_vocabularies: dict[str, Unigram] = {}


def vocabulary(path: str) -> Unigram:
    """The vocabulary of a .model file, one a worker and file."""
    if path not in _vocabularies:
        _vocabularies[path] = load(path)
    return _vocabularies[path]


def _forget() -> None:
    for v in _vocabularies.values():
        v.forget()


KEPT.append(_forget)


def load(path: str) -> Unigram:
    """The normal pieces of a .model file with their scores."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    normal = [i for i in range(n) if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i))]
    return Unigram({model.id_to_piece(i): float(model.get_score(i)) for i in normal})


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and score of the best segmentation of every document's whole text.

    docs needs doc_id and text; other columns are ignored. Null and empty texts have 0 tokens and score 0. Repeated
    rows give repeated results, an empty table none. Map-only: each text is one pass, segments are kept up to a
    bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = vocabulary(path)
        for batch in batches:
            for part in text_slices(batch):
                found = [unigram.count(t or "") for t in part["text"].to_pylist()]
                yield pa.record_batch([part["doc_id"], pa.array([n for _, n in found], pa.int64()), pa.array([s for s, _ in found], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, score double")
