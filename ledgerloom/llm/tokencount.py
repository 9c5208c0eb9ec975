"""Operator 7, token counts: unigram segmentation of distinct pre-tokens, forward scores shared along a trie."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from math import log

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What stands for the space before a word in the vocabulary file.
MARK = "▁"
#: Text characters whose distinct pre-tokens share one trie, and pre-tokens whose counts a worker keeps.
TOGETHER, KEPT = 2_000_000, 200_000


def unigram_scores(path: str) -> dict[str, float]:
    """Log probability of each piece of a vocabulary file: Zipf's law over the order of its ids.

    Control, unknown and byte pieces are left out; a character without a piece costs one token for each UTF-8 byte.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not skip(i)]
    total = sum(1 / (r + 1) for r in range(len(pieces)))
    return {p: -log((r + 1) * total) for r, p in enumerate(pieces)}


class Segmenter:
    """Number of tokens in the best segmentation of pre-tokens.

    Ties of scores go to fewer tokens. Scores are compared as sums in order of the text.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = 2 * min(scores.values(), default=-1.0)

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """Distinct words in sorted order walk their trie depth first: a word keeps the forward scores of the prefix
        that it shares with the one before, and computes one for each further node. Terminal nodes give the counts."""
        best: list[tuple[float, int]] = [(0.0, 0)]
        out, before = {}, ""
        scores, longest, byte = self.scores, self.longest, self.byte
        for word in sorted(words):
            depth, limit = 0, min(len(word), len(before))
            while depth < limit and word[depth] == before[depth]:
                depth += 1
            del best[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                width = len(word[end - 1].encode("utf-8", "surrogatepass"))
                score, count = best[end - 1]
                top = (score + byte * width, -(count + width)) if word[end - 1] not in scores else (score + scores[word[end - 1]], -(count + 1))
                for start in range(max(0, end - longest), end - 1):
                    piece = scores.get(word[start:end])
                    if piece is not None:
                        score, count = best[start]
                        top = max(top, (score + piece, -(count + 1)))
                best.append((top[0], -top[1]))
            out[word] = best[-1][1]
            before = word
        return out


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter, kept = Segmenter(unigram_scores(path)), {}
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            words_out, tokens_out, row = [], [], 0
            while row < len(texts):
                found, size = [], 0
                while row < len(texts) and (size == 0 or size + len(texts[row]) <= TOGETHER):
                    found.append(_WORD.findall(texts[row]))
                    size += len(texts[row]) + 1
                    row += 1
                fresh = {w for words in found for w in words if w not in kept}
                extra = {w[1:]: n for w, n in segmenter.counts({MARK + w for w in fresh}).items()}
                known = kept | extra if fresh else kept
                words_out += map(len, found)
                tokens_out += [sum(map(known.__getitem__, words)) for words in found]
                kept = known if len(known) <= KEPT else kept
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words_out, pa.int64()), pa.array(tokens_out, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pretokens and n_tokens (unigram tokens of the whole text) of every row.

    Pre-tokens are the words between white space, each with the mark for a space before it. Null and empty texts have
    none. Repeated rows are each counted. Null ids stay. Other columns of ``docs`` are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(_count(path or public_tokenizers.path("piece_bpe_32k.model")), "doc_id long, n_pretokens long, n_tokens long")
