import random
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer, models

from briefmill.llm import token_counts as tc

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(word, vocab, unknown):
    word = tc.SPACE + word
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        options = [(best[i - 1][0] + unknown, best[i - 1][1] + len(word[i - 1].encode()))]
        options += [(best[j][0] + vocab[word[j:i]], best[j][1] + 1) for j in range(max(0, i - 40), i) if word[j:i] in vocab]
        best.append(max(options, key=lambda o: o[0]))
    return best[-1]


def test_trie_equals_brute_force_and_the_tokenizers_library():
    vocab = tc.vocabulary(PATH)
    unknown = min(vocab.values()) - 10
    rng = random.Random(0)
    words = ["".join(rng.choice("etaoinshrdluéüñ") for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    words += ["information", "info", "informations", "", "漢字漢", "a😀b", "x" * 3000, "the,", "don't"]
    counting = tc.Counting(vocab, max_nodes=400)
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *vocab.items()], 0, False))
    for at in range(0, len(words), 100):
        got = counting.counts(Counter(words[at : at + 100]))
        for w in words[at : at + 100]:
            trie = tc.Trie(vocab) if at == 0 else counting.trie
            node = trie.insert(tc.SPACE + w)
            score, n = brute(w, vocab, unknown)
            assert abs(trie.score[node] - score) < 1e-6
            if w.isascii() and w and "x" * 20 not in w and got[w] != n:  # only equal scores may differ in number
                ids = model.encode(tc.SPACE + w).tokens
                assert abs(sum(vocab[t] for t in ids) - score) < 1e-6


def test_prefixes_are_scored_once():
    trie = tc.Trie({"▁": -1.0, "a": -1.0, "ab": -1.5})
    trie.insert("▁abc")
    n = len(trie.score)
    trie.insert("▁abd")
    assert len(trie.score) == n + 1 and trie.tokens[trie.insert("▁ab")] == 2


def test_documents_and_edge_cases(spark):
    rows = [(1, "the cat", 0), (2, None, 0), (3, "", 0), (4, " \n\t", 0), (5, "the " * 50000, 0), (1, "the cat", 0), (None, "é漢", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    vocab = tc.vocabulary(PATH)
    unknown = min(vocab.values()) - 10
    want = sorted(((d, len((t or "").split()), sum(brute(w, vocab, unknown)[1] for w in (t or "").split())) for d, t, _ in rows if d != 5), key=str)
    got = [tuple(r) for r in tc.count_tokens(docs).collect()]
    assert sorted((r for r in got if r[0] != 5), key=str) == want
    assert (5, 50000, 50000 * brute("the", vocab, unknown)[1]) in got
    assert tc.count_tokens(docs.limit(0)).count() == 0
