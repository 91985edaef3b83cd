"""The text operators against brute force, other libraries and exact round trips."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from seqbin.llm import bpe, decontaminate, grammar, hashing, hmm, lines, minhash, secrets, tokenfile, topk, warc
from seqbin.staging import stage_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LIBRARY = public_tokenizers.path("byte_bpe_50k.json")


def _docs(spark, texts, **more):
    columns = {"doc_id": range(len(texts)), "text": texts, "source": [f"s{i % 5}" for i in range(len(texts))], **more}
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), list(columns))


# --- near duplicates --------------------------------------------------------------


def _components(texts, size, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(find(i), len(s)) for i, s in enumerate(sets)]


def _family_texts(seed, families, copies):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 8, 30, 120]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(words) // 18)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words) if rng.random() < 0.7 else "  ".join(words).upper())
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_match_brute_force(spark, size):
    texts = _family_texts(size, 25, 12) + [None, "", "É é", "é É", "A\x0bB", "a b"]
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in minhash.near_duplicates(_docs(spark, texts), size).collect()}
    assert [got[i] for i in range(len(texts))] == _components(texts, size, 80)


@pytest.mark.parametrize("text", ["a", "a b", "a b c", "a b c d", "a b c d e", "a b c d e f"])
def test_a_single_short_text(text):
    import pyarrow as pa

    doc, value = hashing.shingles(hashing.words(pa.array([text])), 5)
    assert len(doc) == len(value) == max(1, len(text.split()) - 4)


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300)
    texts = _family_texts(9, 6, 60)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(_docs(spark, texts), 4).collect()}
    assert [got[i] for i in range(len(texts))] == [c for c, _ in _components(texts, 4, 80)]


def test_jaccard_estimate():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8):
        n = 2000
        common = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common), dtype=np.uint64)])) for _ in "ab")
        true = len(common) / (len(a) + len(b) - len(common))
        rows = minhash.registers(2, np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]))
        seen = minhash.estimate(rows[:1], rows[1:], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(seen - true) < 0.15
    assert 0 < minhash.chance_matches(np.array([500]), np.array([500]))[0] < 0.01


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["A b  c", "", None, "\tc\x0b", "a B c" * 50])
    whole = hashing.words(texts)
    assert whole.counts.tolist() == [3, 0, 0, 1, 101]
    monkeypatch.setattr(hashing, "SLICE_BYTES", 4)
    parts = [hashing.words(texts.slice(a, b - a)) for a, b in hashing.text_slices(texts)]
    assert np.concatenate([p.hash for p in parts]).tolist() == whole.hash.tolist()


# --- tokens ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def multi():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "", None, "The quick brown fox's 12 jumps.", "naïve ça déjà vu — “quoted” …", "  \n\n tabs\tand  spaces  ",
    "日本語テキスト 한국어 🙂🙂🏽 ‍", "a" * 3000, "ab" * 2500, "x²½Ⅷ ﷽ \x1c\x1f\x85", "<|endoftext|> is text",
]


def test_rank_queue_equals_library(spark, multi):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("abcdeé ñ.1") for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    got = {r.doc_id: r for r in bpe.encode_documents(_docs(spark, texts), RANKS, public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(texts):
        ids = multi.encode_ordinary(text or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_memory_of_the_encoder_is_bounded(multi):
    encoder = bpe.TextEncoder(bpe.BytePairs.from_file(RANKS), public_tokenizers.PATTERN, remember=10)
    for text in ("one two three four five six seven eight", "alpha beta gamma delta epsilon " * 3, "x" * 500):
        assert encoder.encode(text) == multi.encode_ordinary(text)
        assert len(encoder.known) <= 10


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij", "the ing ion", "eaou\u00e9\u00f1"])
def test_long_pieces_equal_library(multi, alphabet):
    rng, pairs = random.Random(1), bpe.BytePairs.from_file(RANKS)
    for length in (2, 7, 40, 300, 4000):
        piece = "".join(rng.choice(alphabet) for _ in range(length)).encode()
        assert list(pairs.encode_piece(piece)) == multi._core_bpe.encode_single_piece(piece)


def test_quick_split_equals_pattern():
    import regex

    from seqbin.llm.pretokens import ODD, splitter

    rng = random.Random(2)
    quick, general = splitter(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN).findall
    plain = [c for c in map(chr, range(0x2100)) if not ODD.search(c)]
    for _ in range(300):
        text = "".join(rng.choice(plain if rng.random() < 0.5 else " '\n\ta1.") for _ in range(60))
        assert quick(text) == general(text)


def test_token_files_round_trip(spark):
    library = Tokenizer.from_file(LIBRARY)
    library.encode_special_tokens = True
    path = stage_path(spark, "tokens")
    docs = _docs(spark, TEXTS).repartition(3)
    tokenfile.write_tokens(docs, path, LIBRARY, end_id=0)
    rows = {r.doc_id: r for r in tokenfile.read_tokens(spark, path).collect()}
    report = {r.doc_id: r for r in tokenfile.token_report(spark, path).collect()}
    start = 0
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert rows[i].ids == ids and rows[i].start == start
        assert tuple(report[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_segment_random_access():
    ids = np.random.default_rng(2).integers(0, 50_257, 5000).astype(np.uint32)
    ids[:700], ids[9] = 3, 1 << 30
    segment = tokenfile.Segment(tokenfile.pack_segment(np.array([4, 9]), np.array([10, 4990]), ids))
    assert (segment.all() == ids).all() and all(segment.get(i) == ids[i] for i in range(5000))
    with pytest.raises(IndexError):
        segment.get(5000)
    assert len(tokenfile.Segment(tokenfile.pack_segment(np.zeros(0), np.zeros(0), np.zeros(0, np.uint32))).all()) == 0


# --- secrets ---------------------------------------------------------------------


def test_secret_linking(spark):
    key, secret = "AKIA" + "Q7" * 8, "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY"
    texts = [
        f"id {key} then {secret} at https://s3.example.com/bucket",
        f"only {secret} here and https://s3.example.com/bucket",
        f"{key}" + " word" * 100 + f" {secret}",
        "user: alice password=hunter2222 at db.prod.internal",
        "user: alice likes db.prod.internal",
        "secret: token: abcdefgh",  # the first match takes the second word, and fails
        "é" * 5 + 'PassWD" : "abc/def"',
        "f" * 24 + " " + "f" * 23,
    ]
    got = {r.doc_id: r for r in secrets.find_secrets(_docs(spark, texts)).collect()}
    kinds = {i: [s.split(":")[0] for s in r.spans.split(",") if s] for i, r in got.items()}
    assert kinds == {
        0: ["access", "token", "endpoint"], 1: [], 2: ["access"], 3: ["user", "assign", "endpoint"], 4: [], 5: [],
        6: ["assign"], 7: ["hex"],
    }
    assert got[6].spans == "assign:5:23" and got[7].spans == "hex:0:24"
    assert got[0].base_sha256 == hashlib.sha256(b"access:3:23").hexdigest()
    kind, start, end = got[0].spans.split(",")[1].split(":")
    assert texts[0][int(start) : int(end)] == secret


def test_long_weak_parts_are_whole(spark):
    key, token = "AKIA" + "Q7" * 8, "aB3_" * 500 + "=="
    user, url = "login=" + "u.x@" * 50, "https://s3.example.com/" + "p/q" * 200
    host = "a-1." * 20 + "internal"
    text = f"{key} {token} {user} {url} {host}"
    (row,) = secrets.find_secrets(_docs(spark, [text])).collect()
    found = [(k, text[int(a) : int(b)]) for k, a, b in (s.split(":") for s in row.spans.split(","))]
    # the key is too far from user, url and host, but the token reaches from it to the user
    assert found[:3] == [("access", key), ("token", token), ("user", user)]
    weak = {text[a:b] for a, _, b in secrets.weak_spans(text)}
    assert {token, user, url, host} <= weak


def test_weak_patterns_take_linear_time():
    for text in ("aB3" * 300_000 + "===", "login=" + "u" * 1_000_000, "https://" + "/a" * 500_000, "a." * 100_000):
        start = time.perf_counter()
        secrets.weak_spans(text)
        assert time.perf_counter() - start < 20


def test_linking_equals_brute_force(spark):
    rng = random.Random(4)
    spans = []
    for row in range(30):
        for _ in range(rng.randrange(1, 40)):
            start = rng.randrange(0, 3000)
            spans.append((row, start, rng.randrange(6), start + rng.randrange(1, 320)))
    spans = sorted(set(spans))

    def near(candidates, parts):
        return {
            c for c in candidates if any(p[0] == c[0] and p[1] - c[3] <= 200 and c[1] - p[3] <= 200 for p in parts)
        }

    of = {k: {s for s in spans if s[2] == k} for k in range(6)}
    tokens = near(of[3], of[1])
    keys = of[0] | of[2] | tokens
    users = near(of[4], keys)
    want = tokens | users | near(near(of[5], keys), of[1] | users)
    frame = spark.createDataFrame(spans, "row long, start int, kind int, end int")
    got = [tuple(r) for r in secrets.linked_candidates(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want


# --- decontamination, lines ----------------------------------------------------------


def test_shuffled_lookup_equals_broadcast(spark):
    rng = random.Random(5)
    items = [" ".join(rng.choice("abcdef") for _ in range(n)) for n in (3, 10, 14, 40)]
    texts = [" ".join(rng.choice("abcdef") for _ in range(300)) + " " + rng.choice(items) for _ in range(30)]
    docs = _docs(spark, texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    a = sorted(map(tuple, decontaminate.contamination(docs, bench).collect()))
    b = sorted(map(tuple, decontaminate.contamination(docs, bench, broadcast_windows=0).collect()))
    assert a == b and any(r[2] for r in a)
    for doc_id, n_words, n_hit, n_items, *_ in a:
        words, hit, found = texts[doc_id].split(), set(), set()
        for k, item in enumerate(items):
            w = item.split()
            size = min(10, len(w))
            for x in range(len(w) - size + 1):
                for i in range(len(words) - size + 1):
                    if words[i : i + size] == w[x : x + size]:
                        hit.update(range(i, i + size)), found.add(k)
        assert (n_words, n_hit, n_items) == (len(words), len(hit), len(found))


def test_native_plans(spark):
    docs = _docs(spark, ["a b c\nd e f"] * 3)
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    for frame in (lines.line_report(docs), decontaminate.contamination(docs, bench)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def test_line_spread(spark):
    nav = "home about contact us"
    passage = " ".join(f"p{i}" for i in range(55))
    texts = [f"{nav}\nown line number {i} here" + (f"\n{passage}" if i in (1, 7) else "") for i in range(10)]
    texts += [f"two sites only line\nx{i} y z" for i in range(2)] + ["ok yes\nok yes"] * 4
    got = {r.doc_id: r.text for r in lines.dedup_lines(_docs(spark, texts)).collect()}
    assert got[0] == texts[0]
    assert got[1] == f"own line number 1 here\n{passage}"
    assert got[7] == "own line number 7 here"
    assert [got[i] for i in range(10, 16)] == texts[10:16]  # two sites, or too short


# --- top k ----------------------------------------------------------------------


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = np.random.default_rng(6)
    values = np.round(rng.normal(0, 0.3, (200, 7)), 1).astype(np.float32)  # many ties
    values[50] = 0
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "vec_id long, embedding array<float>")
    whole = np.floor(values.astype(np.float64) * 256).astype(np.int64)
    want = []
    for q in range(0, 200, 10):
        score = whole @ whole[q]
        best = sorted((i for i in range(200) if i != q), key=lambda i: (-score[i], i))[:5]
        want += [(q, r + 1, i, int(score[i])) for r, i in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(vectors, 5, 10).collect())) == want


def test_slice_sums():
    rng = np.random.default_rng(7)
    values = rng.integers(-300, 300, (130, 9))
    low, slices = topk.build_slices(values)
    for weights in (rng.integers(-200, 200, 9), np.zeros(9, int), np.array([-1] + [0] * 8)):
        parts, constant = topk.add_slices(slices, weights)
        total = np.zeros(130, np.int64)
        for k, part in enumerate(parts):
            total += np.unpackbits(part.view(np.uint8), bitorder="little")[:130].astype(np.int64) << k
        assert (total + constant + int(low @ weights) == values @ weights).all()


# --- language model ---------------------------------------------------------------


def test_forward_equals_enumeration():
    rng = np.random.default_rng(8)
    start, move, emit = rng.random(3), rng.random((3, 3)), rng.random((3, hmm.CLASSES + 1))
    model = hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))
    lengths = np.array([0, 3, 1, 4])
    classes = rng.integers(0, hmm.CLASSES, 8).astype(np.int32)
    got = hmm.forward(model, lengths, classes)
    at = 0
    for n, score in zip(lengths, got, strict=True):
        sequence = [*classes[at : at + n], hmm.CLASSES]
        at += n
        alpha = model.start * model.emit[:, sequence[0]]
        for c in sequence[1:]:
            alpha = (alpha @ model.move) * model.emit[:, c]
        assert math.isclose(score, math.log10(alpha.sum()), rel_tol=1e-9)


def test_expected_counts_equal_brute_force():
    rng = np.random.default_rng(9)
    start, move, emit = rng.random(2), rng.random((2, 2)), rng.random((2, hmm.CLASSES + 1))
    model = hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))
    sequence = [5, 9, 5, hmm.CLASSES]
    table = np.full((hmm.PIECE, 1), -1, np.int32)
    table[:4, 0] = sequence
    a, b, c, _ = hmm.expected_counts(model, table, np.array([True]))
    total, starts, moves, emits = 0.0, np.zeros(2), np.zeros((2, 2)), Counter()
    for code in range(16):
        path = [code >> t & 1 for t in range(4)]
        p = model.start[path[0]] * math.prod(model.emit[s, w] for s, w in zip(path, sequence, strict=True))
        p *= math.prod(model.move[x, y] for x, y in zip(path[:-1], path[1:], strict=True))
        total += p
        starts[path[0]] += p
        for x, y in zip(path[:-1], path[1:], strict=True):
            moves[x, y] += p
        for s, w in zip(path, sequence, strict=True):
            emits[w, s] += p
    assert np.allclose(a, starts / total) and np.allclose(b, moves / total)
    assert all(math.isclose(c[w, s], emits[w, s] / total) for w, s in emits)


def test_language_model_scores(spark, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK_BYTES", 4000)
    rng = random.Random(10)
    topics = [[f"{t}{i}" for i in range(40)] for t in "abc"]
    texts = [" ".join(rng.choice(topics[i % 3]) for _ in range(rng.randrange(0, 90))) for i in range(240)]
    rows = hmm.language_model_scores(_docs(spark, texts).repartition(3)).collect()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(240)}
    counts, ends = Counter(), sum(not h for h in held.values())
    for i, text in enumerate(texts):
        if not held[i]:
            counts.update(text.split())
    n, v = sum(counts.values()) + ends, len(counts) + 1
    for r in rows:
        words = texts[r.doc_id].split()
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(words) + 1, n)
        assert r.n_known == sum(counts[w] > 0 for w in words) + 1 and math.isclose(r.base_score, base, rel_tol=1e-9)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.2 * sum(r.n_tokens for r in out)


# --- archive, toxicity ---------------------------------------------------------------


def test_archive_rebuilds_records(spark):
    rows = [(i, f"http://x/{i}", ("<p>%d</p>" % (i % 4)) * 30 if i % 5 else "short") for i in range(40)]
    path = stage_path(spark, "archive")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), path)
    assert warc.read_payloads(spark, path).count() == 5
    records = {r.page_id: bytes(r.record) for r in warc.read_records(spark, path).collect()}
    firsts = {}
    for i, url, html in rows:
        first = firsts.setdefault(html, i)
        head, _, body = records[i].partition(b"\r\n\r\n")
        assert records[i].startswith(b"WARC/1.1\r\n") and f"WARC-Target-URI: {url}\r\n".encode() in head
        if len(html) >= 100 and first < i:
            assert body == b"\r\n\r\n" and f"WARC-Refers-To-Page-ID: {first}".encode() in head
        else:
            assert body == html.encode() + b"\r\n\r\n"


def test_broken_payload_is_noticed(spark):
    path = stage_path(spark, "archive")
    bad = spark.createDataFrame([(bytearray(32), bytearray(b"x"))], "digest binary, payload binary")
    bad.write.parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_payloads(spark, path).collect()


def test_grammar_states():
    scorer = grammar.Scorer(grammar.Grammar(words={"fool": 3.0}, stems={"vej": 3.0}))
    plain = scorer.features("The fool sat.")
    assert plain[1] > 0 and plain[7] == 1.0
    assert scorer.features("Not a fool at all.")[2] > 0 and scorer.features("They said this fool ran.")[3] > 0
    assert scorer.features("You fool!")[4] > 0 and scorer.features("We vejura here")[1] > 0
    assert scorer.features("I will hurt nobody.")[5] == 0 and scorer.features("you, I will hurt")[5] > 0
    assert scorer.features("Not today. A fool sat.")[2] == 0  # a clause ends the negation
    assert scorer.score("You fool!") > 0.5 > scorer.score("Not a fool at all.")


def test_threat_before_its_target():
    scorer = grammar.Scorer(grammar.Grammar())

    def threats(text):
        return round(math.expm1(scorer.features(text)[5]))

    assert threats("I will kill you") == threats("we will hurt them") == threats("you, I will hurt") == 1
    assert threats("I will beat and kill you and him") == 2  # both wait for one target, and are paid once
    assert threats("kill all of the people") == 1 and threats("kill one two three four you") == 0
    assert threats("I will kill. You see") == threats("kill time") == threats("never kill you") == 0
    assert threats("kill none, not you") == 0 and scorer.features("kill none, not you")[2] > 0


def test_no_learned_entry_is_cut(spark):
    common = ["".join("bcdfghjklm"[int(d)] + v for d, v in zip(f"{i:03}", "aei", strict=True)) for i in range(1000)]
    texts = [" ".join(common) + (f" zonk{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{i % 7}" if i < 30 else "") for i in range(50)]
    texts += [f"plain text {i}" for i in range(50)]
    labels = spark.createDataFrame([(i, int(i < 50)) for i in range(100)], "doc_id long, toxic int")
    scorer = grammar.Scorer(grammar.train(_docs(spark, texts), labels))
    assert all(scorer.symbol(w)[0] == grammar.INSULT for w in common)
    assert scorer.symbol("zonkother")[0] == grammar.INSULT  # less significant than over 2,000 others


def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(11)
    plain = ["".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    texts, toxic = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(60), "zonk" if i % 12 else "qual" + rng.choice(plain))
        texts.append(" ".join(words) + ".")
        toxic.append(int(bad))
    docs = _docs(spark, texts)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    rows = grammar.toxicity(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert [r.held_out for r in rows] == [zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows]
    assert sum(r.predicted != toxic[r.doc_id] for r in held) <= 0.02 * len(held)
    again = {r.doc_id: r.score for r in grammar.toxicity(docs.repartition(7), labels.repartition(3)).collect()}
    assert all(math.isclose(again[r.doc_id], r.score, abs_tol=1e-12) for r in rows)
