"""A hidden Markov language model over whole texts.

Words fall into ``CLASSES`` fixed classes by hash (the end mark has one of its own).
Latent states emit classes; a class emits its words by their training counts:

    P(text) = sum over state paths of  prod A[s, s'] B[s', class(w)]  *  prod P(w | class(w)).

So the part that is trained has a fixed size, while the word counts grow with the
corpus and stay in tables.

* *Corpus.* Texts are packed into blocks of about ``BLOCK_BYTES``: the block's own
  vocabulary and word numbers. A block never exceeds its bound (but for a single
  longer text), and a block's vocabulary meets the corpus counts by one shuffle on
  the word; texts themselves are not shuffled. Words are told apart by 64 bits of
  hash: with ten million words, two are confused with probability 3e-6.
* *Training.* Baum-Welch. Every pass reads all training blocks and cuts their word
  sequences into pieces of ``PIECE`` words, so that all of a block advance together
  (at a cut the chain's steady distribution stands in for the state before); the
  expected counts, of fixed size, are summed over partitions.
* *Scoring.* The scaled forward recursion over each whole text, end mark included;
  the texts of a block advance together, word by word.

Defined cases: a null or empty text is its end mark alone; long texts are scored whole; a null
doc_id, or rows that repeat one, are scored like any other; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqbin.staging import stage

CLASSES = 1 << 14
STATES = 8
ROUNDS = 6
PIECE = 64
BLOCK_BYTES = 16 << 20
#: words of a block that one training step holds in memory
PART_WORDS = 300_000
#: block numbers leave so many bits for the place in the block's vocabulary
PLACE_BITS = 25
#: weight of the corpus-wide class shares in every state's emissions
SMOOTHING = 200.0

_BLOCK = "block long, words binary, train binary, docs binary, body binary"


@dataclass
class Model:
    start: np.ndarray  # (S)
    move: np.ndarray  # (S, S)
    emit: np.ndarray  # (S, CLASSES + 1); the last class is the end mark


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64).view(np.int64)


def classes_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) % np.uint64(CLASSES)).astype(np.int32)


def pack_blocks(docs: DataFrame, modulus: int = 7, held_out: int = 2) -> DataFrame:
    """Blocks of tokenised texts of ``(doc_id, text)``.

    ``words`` are the int64 hashes of the distinct words of a block, ``train`` int64
    counts of each in training texts, ``docs`` int64 triples (doc_id, words, kind) and
    ``body`` the int32 word numbers of all texts in a row. Kind: 0 training, 1 held
    out, 2 null doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = 0, 0
        index: dict[bytes, int] = {}
        head: list[int] = []
        bodies: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            triples = np.array(head, np.int64).reshape(-1, 3)
            flat = np.concatenate(bodies) if bodies else np.zeros(0, np.int32)
            learn = np.repeat(triples[:, 2] != 1, triples[:, 1])
            train = np.bincount(flat[learn], minlength=len(index)).astype(np.int64)
            values = [word_hashes(list(index)), train, triples, flat]
            return pa.record_batch(
                [pa.array([(part << 18) + number], pa.int64())] + [pa.array([v.tobytes()], pa.binary()) for v in values],
                names=["block", "words", "train", "docs", "body"],
            )

        for batch in batches:
            if batch.num_rows:
                part = batch.column(3)[0].as_py()
            for i in range(batch.num_rows):
                doc_id, text, out = (batch.column(c)[i].as_py() for c in range(3))
                # bytes.split() cuts exactly at 0x20 and 0x09-0x0D, bytes.lower() changes A-Z only
                words = (text or "").encode("utf-8").lower().split()
                for word in set(words).difference(index):
                    index[word] = len(index)
                head += [doc_id or 0, len(words), 2 if doc_id is None else int(out)]
                bodies.append(np.array(list(map(index.__getitem__, words)), np.int32))
                size += len(text or "") + 32
                if size >= BLOCK_BYTES:
                    yield flush()
                    number += 1
                    index, head, bodies, size = {}, [], [], 0
            pa.default_memory_pool().release_unused()
        if head:
            yield flush()

    ids = F.col("doc_id").cast("long")
    out = F.coalesce(F.crc32(ids.cast("string").cast("binary")) % modulus == held_out, F.lit(False))
    return docs.select(
        ids.alias("doc_id"), F.col("text").cast("string").alias("text"), out.alias("held_out"),
        F.spark_partition_id().alias("part"),
    ).mapInArrow(run, _BLOCK)


def word_entries(blocks: DataFrame) -> DataFrame:
    """``(word, slot, n)``: every word of every block; ``slot`` is block and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column(0)[i].as_py()
                hashes, train = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in (1, 2))
                slot = (np.int64(block) << PLACE_BITS) + np.arange(len(hashes))
                for at in range(0, len(hashes), 100_000):
                    rows = [x[at : at + 100_000] for x in (hashes, slot, train)]
                    yield pa.record_batch([pa.array(x) for x in rows], names=["word", "slot", "n"])

    return blocks.select("block", "words", "train").mapInArrow(run, "word long, slot long, n long")


def _parts(triples: np.ndarray, classes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts of a block by PART_WORDS words: what is worked on at once."""
    ends = np.concatenate(([0], np.cumsum(triples[:, 1])))
    at = 0
    while at < len(triples):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PART_WORDS, "right")) - 1)
        yield triples[at:to], classes[ends[at] : ends[to]]
        at = to


def _pieces(triples: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(PIECE, n)`` class numbers of training text with ends, -1 past a piece; and first-piece flags."""
    lengths = triples[:, 1] + 1
    ends = np.cumsum(triples[:, 1])
    total = int(lengths.sum())
    flow = np.full(total, CLASSES, np.int32)
    is_word = np.ones(total, bool)
    is_word[np.cumsum(lengths) - 1] = False
    flow[is_word] = classes[: int(ends[-1]) if len(ends) else 0]
    doc = np.repeat(np.arange(len(lengths)), lengths)
    learn = triples[doc, 2] != 1
    place = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    count = -(-lengths // PIECE)
    piece = np.repeat(np.cumsum(count) - count, lengths) + place // PIECE
    table = np.full((PIECE, int(count.sum())), -1, np.int32)
    table[place[learn] % PIECE, piece[learn]] = flow[learn]
    first = np.zeros(table.shape[1], bool)
    first[piece[place == 0]] = True
    used = table[0] >= 0
    return table[:, used], first[used]


def expected_counts(model: Model, table: np.ndarray, first: np.ndarray):
    """Baum-Welch sums over pieces: ``(start, move, emit, log10 likelihood)``."""
    states = len(model.start)
    start, move = np.zeros(states), np.zeros((states, states))
    emit = np.zeros((CLASSES + 1, states))
    by_class = model.emit.T.copy()
    steady = _steady(model.move)
    likelihood = 0.0
    order = np.argsort(-(table >= 0).sum(axis=0), kind="stable")
    table, first = table[:, order], first[order]
    for at in range(0, table.shape[1], 4096):
        some, begins = table[:, at : at + 4096], first[at : at + 4096]
        live = (some >= 0).sum(axis=1)
        steps = int((live > 0).sum())
        alpha = np.zeros((steps, some.shape[1], states))
        scale = np.ones((steps, some.shape[1]))
        now = np.where(begins[:, None], model.start, steady)
        for t in range(steps):
            n = live[t]
            if t:
                now = alpha[t - 1, :n] @ model.move
            now = now[:n] * by_class[some[t, :n]]
            scale[t, :n] = now.sum(axis=1)
            alpha[t, :n] = now / scale[t, :n, None]
        likelihood += float(np.log10(scale).sum())
        beta = np.ones((some.shape[1], states))
        for t in range(steps - 1, -1, -1):
            n = live[t]
            back = by_class[some[t, :n]] * beta[:n] / scale[t, :n, None]
            alpha[t, :n] *= beta[:n]  # from here on the state shares of each word
            if t:
                move += model.move * (alpha[t - 1, :n].T @ back)
                beta[:n] = back @ model.move.T
        start += alpha[0][begins].sum(axis=0)
        used = some[:steps] >= 0
        words, shares = some[:steps][used], alpha[used]
        for s in range(states):
            emit[:, s] += np.bincount(words, shares[:, s], CLASSES + 1)
    return start, move, emit, likelihood


def _steady(move: np.ndarray) -> np.ndarray:
    x = np.full(len(move), 1 / len(move))
    for _ in range(50):
        x = x @ move
    return x / x.sum()


def _smoothed(emit: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """``(S, CLASSES + 1)`` emissions from expected counts, drawn to the corpus shares."""
    counts = emit.T + SMOOTHING * shares
    return counts / counts.sum(axis=1, keepdims=True)


def first_model(class_counts: np.ndarray, states: int = STATES) -> Model:
    """A start that breaks the symmetry: each state prefers its own random half of the classes."""
    shares = (class_counts + 1.0) / (class_counts + 1.0).sum()
    rng = np.random.Generator(np.random.PCG64(5))
    tilt = np.exp(0.7 * rng.standard_normal((states, CLASSES + 1)))
    tilt[:, CLASSES] = 1.0
    emit = tilt * shares
    emit /= emit.sum(axis=1, keepdims=True)
    move = np.full((states, states), 0.08 / (states - 1)) if states > 1 else np.ones((1, 1))
    if states > 1:
        np.fill_diagonal(move, 0.92)
    return Model(np.full(states, 1 / states), move, emit)


def baum_welch(blocks: DataFrame, model: Model, class_counts: np.ndarray) -> Model:
    """One round over all training texts."""
    states = len(model.start)
    shares = (class_counts + 1.0) / (class_counts + 1.0).sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES + 1, states))
        for batch in batches:
            for i in range(batch.num_rows):
                for triples, classes in _parts(*_block_classes(batch, i)):
                    table, first = _pieces(triples, classes)
                    if table.shape[1]:
                        a, b, c, _ = expected_counts(model, table, first)
                        start, move, emit = start + a, move + b, emit + c
            pa.default_memory_pool().release_unused()
        rows = np.concatenate([start[None], move, emit])
        numbers = np.concatenate([np.arange(-1 - states, 0), np.arange(CLASSES + 1)])
        some = np.abs(rows).sum(axis=1) > 0
        yield pa.record_batch(
            [pa.array(numbers[some])] + [pa.array(rows[some, s]) for s in range(states)],
            names=["row", *(f"s{s}" for s in range(states))],
        )

    columns = [f"s{s}" for s in range(states)]
    sums = (
        blocks.select("words", "docs", "body")
        .mapInArrow(run, "row long, " + ", ".join(f"{c} double" for c in columns))
        .groupBy("row")
        .agg(*(F.round(F.sum(c), 6).alias(c) for c in columns))
        .collect()  # 1 + states + CLASSES + 1 rows at most
    )
    total = np.zeros((1 + states + CLASSES + 1, states))
    for r in sums:
        total[r["row"] + 1 + states] = [r[c] for c in columns]
    start = total[0] + 1.0
    move = total[1 : 1 + states] + 1.0
    emit = _smoothed(total[1 + states :], shares)
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit)


def _block_classes(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    words, docs, body = (batch.column(c)[i].as_py() for c in range(3))
    return np.frombuffer(docs, np.int64).reshape(-1, 3), classes_of(np.frombuffer(words, np.int64))[np.frombuffer(body, np.int32)]


def forward(model: Model, lengths: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """log10 probability of each class sequence followed by the end mark.

    Scaled forward recursion, exact for any length; sequences advance together,
    longest first, so a step only touches those that are still running.
    """
    begin = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    length, begin = lengths[order], begin[order]
    total = np.zeros(len(lengths))
    by_class = model.emit.T.copy()
    ending = model.emit[:, CLASSES]
    state = np.tile(model.start, (len(lengths), 1))
    longest = int(length[0]) if len(length) else 0
    live = np.searchsorted(-length, -np.arange(1, longest + 1), "right")
    for t in range(longest):
        n = live[t]
        now = state[:n] * by_class[classes[begin[:n] + t]]
        scale = now.sum(axis=1)
        total[:n] += np.log10(scale)
        state[:n] = (now / scale[:, None]) @ model.move
    total += np.log10(state @ ending)
    out = np.zeros(len(lengths))
    out[order] = total
    return out


def language_model_scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, modulus: int = 7, held_out: int = 2) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row.

    Training texts are those whose crc32(doc_id as text) modulo ``modulus`` is not
    ``held_out`` (a null doc_id trains and has a null fold). ``n_tokens`` counts the
    end mark; a null or empty text is only its end. ``base_score`` is the add-one
    unigram log10 probability, ``score`` that of the model. Without any training text
    the model is the uniform start. Rows that repeat a doc_id are scored each.
    """
    blocks = stage(pack_blocks(docs.select("doc_id", "text"), modulus, held_out), "token-blocks")
    # one shuffle on the word: every block's entry meets the sum over all blocks
    same = Window.partitionBy("word")
    counted = stage(
        word_entries(blocks).select("word", "slot", F.sum("n").over(same).alias("c"), F.min("slot").over(same).alias("lead")),
        "word-counts",
    )

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            cls, c = classes_of(batch.column(0).to_numpy()), batch.column(1).to_numpy()
            tokens += np.bincount(cls, c, CLASSES).astype(np.int64)
            words += np.bincount(cls, c > 0, CLASSES).astype(np.int64)
        some = np.flatnonzero(words)
        yield pa.record_batch(
            [pa.array(some), pa.array(tokens[some]), pa.array(words[some])], names=["class", "tokens", "words"]
        )

    # CLASSES rows at most
    classes = (
        counted.filter("lead = slot").select("word", "c").mapInArrow(by_class, "class long, tokens long, words long")
        .groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect()
    )
    class_tokens, class_words = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in classes:
        class_tokens[r["class"]], class_words[r["class"]] = r["tokens"], r["words"]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for value in batch.column(0):
                n += int((np.frombuffer(value.as_py(), np.int64).reshape(-1, 3)[:, 2] != 1).sum())
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    end_count = blocks.select("docs").mapInArrow(ends, "n long").agg(F.sum("n")).first()[0] or 0
    class_tokens[CLASSES] = end_count
    tokens = int(class_tokens.sum())
    distinct = int(class_words.sum()) + (end_count > 0)

    model = first_model(class_tokens, states)
    for _ in range(rounds if end_count else 0):
        model = baum_welch(blocks, model, class_tokens)

    # a class gives each of its words (c + 1), and a word it has not met 1
    in_class = class_tokens[:CLASSES] + class_words[:CLASSES] + 1
    base_rest = np.log10(tokens + distinct + 1)
    base_end = np.log10(end_count + 1) - base_rest
    kinds = pa.array([True, False, None])

    def run(block: pa.Table, words: pa.Table) -> pa.Table:
        parts = []
        for row in block.select(["words", "docs", "body"]).to_pylist():
            cls = classes_of(np.frombuffer(row["words"], np.int64))
            count = np.zeros(len(cls))
            count[words.column("slot").to_numpy() & ((1 << PLACE_BITS) - 1)] = words.column("c").to_numpy()
            codes = np.frombuffer(row["body"], np.int32)
            triples = np.frombuffer(row["docs"], np.int64).reshape(-1, 3)
            lengths = triples[:, 1]
            doc = np.repeat(np.arange(len(lengths)), lengths)

            def per_doc(values, doc=doc, n=len(lengths)):
                return np.bincount(doc, values, n)

            logs = np.log10(count + 1)
            if len(codes):
                base = per_doc(logs[codes]) - lengths * base_rest
                inside = per_doc((logs - np.log10(in_class[cls]))[codes])
                known = per_doc((count > 0)[codes]).astype(np.int64)
            else:
                base = inside = np.zeros(len(lengths))
                known = np.zeros(len(lengths), np.int64)
            score = forward(model, lengths, cls[codes]) + inside
            kind = triples[:, 2]
            parts.append(
                pa.table(
                    {
                        "doc_id": pa.array(triples[:, 0], mask=kind == 2),
                        "held_out": pa.array(kind == 1, mask=kind == 2),
                        "n_tokens": lengths + 1,
                        "n_known": known + int(end_count > 0),
                        "train_tokens": np.full(len(lengths), tokens, np.int64),
                        "base_score": base + base_end,
                        "score": score,
                    }
                )
            )
        return pa.concat_tables(parts) if parts else _NOTHING

    return (
        blocks.select("block", "words", "docs", "body")
        .groupBy("block")
        .cogroup(counted.select(F.shiftright("slot", PLACE_BITS).alias("block"), "slot", "c").groupBy("block"))
        .applyInArrow(
            run,
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )


_NOTHING = pa.table(
    {
        "doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()),
        "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()),
        "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64()),
    }
)
