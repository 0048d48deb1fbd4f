"""Token counts of a unigram tokenizer, without the tokens.

Words (runs without white space) are written with a leading ``▁`` and segmented on
their own. An Aho-Corasick automaton over the vocabulary lists every piece that
ends at a place of the word; the dynamic program keeps, for each place, the best
score and the number of pieces of the path that has it. Tie rules of the common
unigram implementation: a later candidate must be strictly better, candidates of
one end are met by ascending start, the unknown piece (one character, allowed only
where no piece of one character begins, with the lowest score less 10) last, and
neighbouring unknown characters are one piece. Scores are added from the left in
double precision.

Each different word is segmented once per chunk and worker; the cache holds
``CACHE_WORDS`` words and is then begun anew.

Defined cases: null, empty and blank texts have no words and no tokens; very long
words are segmented whole; repeated rows give repeated results; an empty table gives
an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quantfold.llm import wordscan

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 300_000
CACHED_BYTES = 128


def zipf_vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """Pieces of a public vocabulary file with the log of 1 / rank as their score.

    The public files hold no unigram scores; their order by frequency gives ranks.
    Control and byte pieces are left out, as is white space inside a piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = [p for p in map(model.id_to_piece, ids) if SPACE_MARK not in p[1:]]
    return [(p, -math.log(rank + 1)) for rank, p in enumerate(pieces, 1)]


class Segmenter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY

    def count(self, word: str) -> tuple[int, int]:
        """Pieces of a word and how many of them are unknown."""
        # per place of the word: best score, pieces and unknown pieces of its path, and whether that ends in an unknown piece
        best, pieces, unknown, open_end = [0.0], [0], [0], [False]
        matches = self.automaton.iter(word)
        last, found = next(matches, (-1, None))
        for end, letter in enumerate(word, 1):
            top, start = None, 0
            while last == end - 1:
                length, score = found
                total = score + best[end - length]
                # of equal scores the earliest start wins
                if top is None or total > top or (total == top and end - length < start):
                    top, start = total, end - length
                last, found = next(matches, (-1, None))
            skipped = False
            if letter not in self.single:
                total = self.unknown + best[end - 1]
                if top is None or total > top:
                    top, start, skipped = total, end - 1, True
            more = 0 if skipped and open_end[start] else 1
            best.append(top)
            pieces.append(pieces[start] + more)
            unknown.append(unknown[start] + (more if skipped else 0))
            open_end.append(skipped)
        return pieces[-1], unknown[-1]


_made: dict[int, tuple[Segmenter, dict[int, tuple[int, int]]]] = {}


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown. The vocabulary is broadcast (a parameter of fixed size)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    key = hash(tuple(vocabulary[:1000])) ^ len(vocabulary)

    def count(batches):
        if key not in _made:
            _made.clear()
            _made[key] = Segmenter(shared.value), {}
        segmenter, cache = _made[key]
        for b in batches:
            out = []
            for lo, hi in wordscan.chunks(b.column(1)):
                words = wordscan.scan(b.column(1).slice(lo, hi - lo), fold=False)
                hashes, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
                counts = np.zeros((len(hashes), 2), np.int64)
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                raw = words.data.tobytes()
                starts, ends = words.start[first].tolist(), words.end[first].tolist()
                for i, h in enumerate(hashes.tolist()):
                    got = cache.get(h)
                    if got is None:
                        got = segmenter.count(SPACE_MARK + raw[starts[i] : ends[i]].decode())
                        if ends[i] - starts[i] <= CACHED_BYTES:
                            cache[h] = got
                    counts[i] = got
                totals = np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(counts[back], axis=0)))[words.first]
                out.append(np.column_stack((np.diff(words.first), np.diff(totals, axis=0))))
            found = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(found[:, i].astype(np.int64)) for i in range(3)]], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")
