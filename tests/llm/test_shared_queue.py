"""One rank queue over many pre-tokens gives the ids of one queue each, and of the library."""

import random

import public_tokenizers
import tiktoken

from seqbin.llm.bpe import BytePairs, TextEncoder

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_many_equal_one_by_one():
    pairs = BytePairs.from_file(RANKS)
    rng = random.Random(12)
    parts = ["es", "er", "ed", "ä", "the", "a", "aa", " ", "ing", "é", "0", "日本", "x", "\n"]
    pieces = ["".join(rng.choices(parts, k=rng.randrange(1, 12))).encode() for _ in range(20_000)]
    pieces += [bytes(rng.choices(range(256), k=rng.randrange(1, 20))) for _ in range(5_000)] + [b"a" * n for n in range(1, 64)]
    assert pairs.encode_many(pieces) == [pairs.encode_piece(p) for p in pieces]
    assert pairs.encode_many([]) == []


def test_pairs_that_undercut_a_rank():
    # after "bc" (rank 260) merges, "a" + "bc" comes up with the lower rank 257
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 257, b"bc": 260, b"bcbc": 261, b"cb": 262}
    pairs = BytePairs(ranks)
    pieces = [b"abcbc", b"bcbcbc", b"abcabcbcbc", b"bcbcbcbcabc", b"cbcbcb"] * 3
    assert pairs.encode_many(pieces) == [pairs.encode_piece(p) for p in pieces]


def test_texts_equal_the_library():
    pairs = BytePairs.from_file(RANKS)
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})
    rng = random.Random(4)
    words = ["theseses", "undäää", "of", "Ωμέγα", "12345", "...", "don't", "\n\n", "x" * 200, "ababab" * 30]
    texts = [None, "", " "] + [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(300)]
    got = list(TextEncoder(pairs, public_tokenizers.PATTERN).encode_all(texts))
    assert got == [library.encode_ordinary(t or "") for t in texts]


def test_vocabulary_without_all_bytes():
    pairs = BytePairs({b"a": 0, b"b": 1, b"ab": 2})
    assert pairs.encode_many([b"abab", b"ba"]) == [(2, 2), (1, 0)]
