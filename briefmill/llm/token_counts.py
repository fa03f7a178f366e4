"""Token counts (operator 1) by dynamic programming that the words of a trie share.

The tokenizer is a unigram model over a fixed vocabulary: a text's tokens are the segmentation of its words with the
highest sum of piece scores. The distinct pre-tokens of a batch go into a trie; the best forward score of each position
is computed once per trie node, whichever words share the prefix, and a word's count is read at its terminal node.
Documents then add up their words' counts. It is a map over the documents, with no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: trie nodes and words kept between batches, about 150 MB in a worker; beyond that the trie starts anew
MAX_NODES = 500_000
_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = "▁"


def vocabulary(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece file with unigram scores by rank: the n-th ordinary piece has log(1 / (n + 10)).

    The file's own scores are merge ranks; a Zipf law over the same order makes them log-probabilities, up to a constant.
    Control and byte pieces are left out.
    """
    import math

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[str, float] = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            out[sp.id_to_piece(i)] = -math.log(len(out) + 10)
    return out


class Trie:
    """Pre-tokens; each node has the best score and the number of tokens of the string that leads to it.

    ``step`` maps a node and a character, as one number, to the next node. The pieces that end at a new node are found by
    walking back along the word's path through a tree of the reversed pieces.
    """

    def __init__(self, vocab: dict[str, float]) -> None:
        self.back: dict = {}
        for piece, score in vocab.items():
            at = self.back
            for ch in reversed(piece):
                at = at.setdefault(ch, {})
            at[""] = score
        self.unknown = min(vocab.values(), default=0.0) - 10
        self.clear()

    def clear(self) -> None:
        self.step: dict[int, int] = {}
        self.score, self.tokens = [0.0], [0]

    def insert(self, word: str) -> int:
        """The terminal node; only nodes that no earlier word has made are scored."""
        step, score, tokens, path = self.step, self.score, self.tokens, [0]
        node = 0
        for i, ch in enumerate(word):
            key = node * 0x110000 + ord(ch)
            after = step.get(key)
            if after is None:
                # an unknown character is its UTF-8 bytes
                best, count = score[node] + self.unknown, tokens[node] + len(ch.encode("utf-8", "surrogatepass"))
                at, j = self.back, i
                while j >= 0 and (at := at.get(word[j])) is not None:
                    s = at.get("")
                    if s is not None and s + score[path[j]] > best:
                        best, count = s + score[path[j]], tokens[path[j]] + 1
                    j -= 1
                after = step[key] = len(score)
                score.append(best)
                tokens.append(count)
            node = after
            path.append(node)
        return node


class Counting:
    """Token counts of words, kept between batches in a bounded trie."""

    def __init__(self, vocab: dict[str, float], max_nodes: int = MAX_NODES) -> None:
        self.trie, self.max_nodes, self.known = Trie(vocab), max_nodes, {}

    def counts(self, words: Counter) -> dict[str, int]:
        for w in words.keys() - self.known.keys():
            if len(self.trie.score) > self.max_nodes:
                self.trie.clear()
            self.known[w] = self.trie.tokens[self.trie.insert(SPACE + w)]
        out = {w: self.known[w] for w in words}
        if len(self.known) > self.max_nodes:
            self.known.clear()
        return out


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per document: id, ``n_words`` (runs without white space) and ``n_tokens``.

    ``model`` is a path, or the name of one of the public tokenizers' files. Null and empty texts, and texts of white
    space alone, count 0. Repeated rows are counted each; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        counting = Counting(vocabulary(model if "/" in model else public_tokenizers.path(model)))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                split = [_SPLIT.findall(t or "") for t in part.column(1).to_pylist()]
                known = counting.counts(Counter(w for words in split for w in words))
                tokens = [sum(map(known.__getitem__, words)) for words in split]
                yield pa.record_batch([part.column(0).cast(pa.int64()), pa.array([len(w) for w in split], pa.int64()), pa.array(tokens, pa.int64())], names=["id", "n_words", "n_tokens"])

    got = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_words long, n_tokens long")
    return got.withColumnRenamed("id", id_col)
