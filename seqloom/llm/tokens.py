"""Token counts without tokens: Viterbi over a unigram vocabulary.

For each word an Aho-Corasick automaton lists every vocabulary piece that ends at
each character; a dynamic program keeps the best score, the number of pieces and
nothing else. Ties go the way the public unigram tokenizer decides them: a later
start replaces an earlier one only if its score is strictly greater, which is the
order in which the automaton reports matches of one end (longest first).
Characters without a piece of their own cost ten below the least score; they
count one piece for each UTF-8 byte if the vocabulary has byte pieces, else one
for each run of them.

Words are tokenised apart, each with the word mark before it, so a worker's memo
of words makes common ones cheap. It is a cache of bounded size: it is emptied
when full, and no result depends on it.

The vocabulary is a file on the driver, named by parameter; its pieces and scores
(some ten thousand entries, fixed by the file) are broadcast.

Defined cases: null and empty texts have no tokens and score 0; bytes that are
not UTF-8 count as the replacement character; a very long text is cut into words piece
by piece, and a very long word needs no more state than the longest piece; repeated rows
are counted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import binary, words_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK, PENALTY, MEMO = "▁", 10.0, 500_000


@dataclass
class Vocabulary:
    pieces: list[tuple[str, float]]
    bytes_known: bool
    memo: dict[bytes, tuple[int, float]] = field(default_factory=dict)
    automaton: object = None

    def __getstate__(self) -> dict:
        return {"pieces": self.pieces, "bytes_known": self.bytes_known, "memo": {}, "automaton": None}

    def matcher(self):
        import ahocorasick

        if self.automaton is None:
            made = ahocorasick.Automaton()
            for piece, score in self.pieces:
                made.add_word(piece, (len(piece), score))
            if self.pieces:
                made.make_automaton()
            self.automaton, self.unknown, self.longest = made, min((s for _, s in self.pieces), default=0.0) - PENALTY, max((len(p) for p, _ in self.pieces), default=1)
        return self.automaton

    def count(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation of one string."""
        matcher = self.matcher()
        size = len(text)
        # Only as many ends back as the longest piece are looked at again, so that state does not grow with the text.
        ring = self.longest + 2
        best, many, lost, single = [-np.inf] * ring, [0] * ring, bytearray(ring), bytearray(ring)
        best[0], at, opened = 0.0, 0, 0

        def open_(end: int) -> None:
            nonlocal opened
            if opened < end:
                opened, i = end, end % ring
                best[i], many[i], lost[i], single[i] = -np.inf, 0, 0, 0

        def settle(end: int) -> None:
            # Ends up to this one have seen all their matches; without a piece of one character the unknown character competes last.
            nonlocal at
            while at < end:
                at += 1
                open_(at)
                i, j = at % ring, (at - 1) % ring
                if not single[i]:
                    score = best[j] + self.unknown
                    if score > best[i]:
                        best[i], lost[i] = score, 1
                        many[i] = many[j] + (len(text[at - 1].encode("utf-8", "replace")) if self.bytes_known else 1 - lost[j])

        for last, (length, piece) in matcher.iter(text) if self.pieces else ():
            end = last + 1
            settle(end - 1)
            open_(end)
            i, j = end % ring, (end - length) % ring
            if length == 1:
                single[i] = 1
            score = best[j] + piece
            if score > best[i]:
                best[i], many[i], lost[i] = score, many[j] + 1, 0
        settle(size)
        return many[size % ring], best[size % ring]

    def word(self, word: bytes) -> tuple[int, float]:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            got = self.count(MARK + word.decode("utf-8", "replace"))
            if len(word) <= 256:
                self.memo[word] = got
        return got


def load(path: str = VOCABULARY) -> Vocabulary:
    """Pieces and scores of a sentencepiece model file; control, unknown and byte pieces match no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [(model.id_to_piece(i), float(model.get_score(i))) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Vocabulary(pieces, any(model.is_byte(i) for i in ids))


def _counted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        look = vocabulary.word
        for batch in batches:
            words, tokens, scores = [], [], []
            for text in binary(batch.column("text")):
                n = total = 0
                score = 0.0
                for part in words_of(text or b""):
                    n += len(part)
                    for word in part:
                        many, gain = look(word)
                        total += many
                        score += gain
                words.append(n)
                tokens.append(total)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "n_words", "n_tokens", "score"])

    return run


def token_counts(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens, score for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or load())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_counted(shared), "doc_id long, n_words long, n_tokens long, score double")
