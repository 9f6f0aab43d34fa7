"""Hidden Markov language model: Baum-Welch counts aggregated across partitions, exact scaled forward scores.

A text is its words and one end token. Each word belongs to one of a fixed number of classes (short words by the
whole word, long ones by their ending). The model draws a class sequence from a hidden Markov chain and each word
from its class: p(text) = sum over state paths of prod a(s, s') b(s', class) times prod p(word | class). The word part
comes from the counts of all training words, ``(c + 0.1) / (N_class + 0.1 (V_class + 1))``, so an unseen word has a
defined probability in every class; the end token is alone in its class.

Work is done on chunks of documents (a few MB of text). A chunk sends each of its distinct words once, with its
training count, to the word's bucket, and gets the corpus count back, so a word in every document costs one row per
chunk. Baum-Welch passes read all training documents; each task adds up its expected counts and the sums meet in a
tree. Only the parameters (states x classes) come to the driver.

Defined results: NULL text is empty and has the end token only; NULL ids hash as an empty text; repeated rows are
scored and counted each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom.llm.common import crc, rows_of, slices, table, text_bytes
from replyloom.llm.words import prefix_sums, spans, word_bounds
from replyloom.session import stash

STATES = 8
CLASSES = 1024
PASSES = 5
SEGMENT = 128
PIECES_AT_ONCE = 1024
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
END = 0
SMOOTH = 0.1

_CHUNK = "chunk string, doc_ids array<bigint>, held array<boolean>, n_words array<int>, n_bytes bigint, uniq binary, cls binary, n_train binary, inv binary"
_SENT = "bucket int, chunk string, uniq binary, cls binary, n_train binary"
_BACK = "bucket int, chunk string, total binary, class_n binary, class_v binary"
_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, sum_log double, score double"


def _classes(data: np.ndarray, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """1 to CLASSES - 1: by the whole word up to four bytes, else by its last three bytes and whether it is long."""
    size = ends - starts
    short = size <= 4
    code = np.where(short, spans(sums, starts, ends), spans(sums, np.where(short, starts, ends - 3), ends) + (size > 8) + np.uint64(1))
    return (code % np.uint64(CLASSES - 1)).astype(np.uint16) + np.uint16(1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        hashes = np.concatenate([h[3] for h in held])
        uniq, first, inv = np.unique(hashes, return_index=True, return_inverse=True)
        train = np.concatenate([np.repeat(~h[1], h[2]) for h in held])
        row = {
            "chunk": [uuid.uuid4().hex],
            "doc_ids": [[x for h in held for x in h[0]]],
            "held": [np.concatenate([h[1] for h in held]).tolist()],
            "n_words": [np.concatenate([h[2] for h in held]).tolist()],
            "n_bytes": [size],
            "uniq": [uniq.tobytes()],
            "cls": [np.concatenate([h[4] for h in held])[first].tobytes()],
            "n_train": [np.bincount(inv, train, len(uniq)).astype(np.int64).tobytes()],
            "inv": [inv.astype(np.int32).tobytes()],
        }
        types = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

    for part in slices(batches, "text"):
        data, offsets = text_bytes(part.column("text"))
        starts, ends, of_text = word_bounds(data, offsets)
        sums = prefix_sums(data)
        flags = part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        held.append((part.column("doc_id").to_pylist(), flags, np.diff(of_text), spans(sums, starts, ends), _classes(data, sums, starts, ends)))
        size += len(data)
        if size >= CHUNK_BYTES:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _sender(n_buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                uniq = np.frombuffer(row["uniq"], np.uint64)
                cls, n_train = np.frombuffer(row["cls"], np.uint16), np.frombuffer(row["n_train"], np.int64)
                at = np.searchsorted(uniq, _bounds(n_buckets))
                cuts = list(zip(at, [*at[1:], len(uniq)], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(n_buckets), pa.int32()), pa.array([row["chunk"]] * n_buckets),
                        *[pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (uniq, cls, n_train)],
                    ],
                    names=["bucket", "chunk", "uniq", "cls", "n_train"],
                )

    return send


def _bounds(n: int) -> np.ndarray:
    """Where each of ``n`` equal ranges of hash values begins."""
    return np.array([k * 2**64 // n for k in range(n)], np.uint64)


def _total(group: pa.Table) -> pa.Table:
    """Corpus counts of one bucket's words, sent back to each chunk in the chunk's own order; and class totals."""
    rows = group.to_pylist()
    words = [np.frombuffer(r["uniq"], np.uint64) for r in rows]
    uniq, first, inv = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
    counts = np.concatenate([np.frombuffer(r["n_train"], np.int64) for r in rows])
    cls = np.concatenate([np.frombuffer(r["cls"], np.uint16) for r in rows])[first]
    total = np.zeros(len(uniq), np.int64)
    np.add.at(total, inv, counts)
    known = total > 0
    class_n = np.bincount(cls[known], total[known], CLASSES).astype(np.int64)
    class_v = np.bincount(cls[known], minlength=CLASSES).astype(np.int64)
    ends = np.cumsum([len(w) for w in words])
    back = [total[inv[b - len(w) : b]].tobytes() for w, b in zip(words, ends, strict=True)]
    bucket = rows[0]["bucket"]
    return pa.table(
        {
            "bucket": pa.array([bucket] * (len(rows) + 1), pa.int32()),
            "chunk": pa.array([r["chunk"] for r in rows] + [None], pa.string()),
            "total": pa.array([*back, None], pa.binary()),
            "class_n": pa.array([None] * len(rows) + [class_n.tobytes()], pa.binary()),
            "class_v": pa.array([None] * len(rows) + [class_v.tobytes()], pa.binary()),
        }
    )


def _sum_up(columns: list[str], kind: type):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[np.ndarray] | None = None
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
                arrays = [np.frombuffer(x, kind) for x in row]
                sums = arrays if sums is None else [a + b for a, b in zip(sums, arrays, strict=True)]
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in sums], names=columns)

    return add


def _tree_sum(parts: DataFrame, columns: list[str], kind: type) -> list[np.ndarray]:
    """The sums of packed arrays over all rows, best one for each task: over a square root of the tasks, then one.

    A shuffle lies between any two steps, so that no task keeps two Python workers at a time.
    """
    schema = ", ".join(f"{c} binary" for c in columns)
    add = _sum_up(columns, kind)
    width = max(1, math.isqrt(parts.sparkSession.sparkContext.defaultParallelism * 4))
    row = parts.select(*columns).repartition(width).mapInArrow(add, schema).repartition(1).mapInArrow(add, schema).first()
    return [] if row is None else [np.frombuffer(row[c], kind) for c in columns]


def _segments(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class sequence of a chunk with end tokens, and starts and sizes of its training pieces."""
    cls_of = np.frombuffer(row["cls"], np.uint16)
    n_words = np.array(row["n_words"], np.int64)
    seq = _with_ends(cls_of[np.frombuffer(row["inv"], np.int32)], n_words)
    sizes = n_words + 1
    starts = np.cumsum(sizes) - sizes
    keep = ~np.array(row["held"], bool)
    starts, sizes = starts[keep], sizes[keep]
    n_parts = -(-sizes // SEGMENT)
    part = np.arange(n_parts.sum()) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
    seg_starts = np.repeat(starts, n_parts) + part * SEGMENT
    seg_sizes = np.minimum(SEGMENT, np.repeat(starts + sizes, n_parts) - seg_starts)
    return seq, seg_starts, seg_sizes


def _with_ends(seq: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.insert(seq, np.cumsum(n_words), END).astype(np.int64)


def expected_counts(seq, starts, sizes, start_p, move_p, emit_p) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of the pieces of ``seq``: first states, moves, emissions; and the log-likelihood.

    All pieces advance together, longest first, so that a step is a few dense products.
    """
    k = len(start_p)
    first, moves, emits, loglik = np.zeros(k), np.zeros((k, k)), np.zeros((k, emit_p.shape[1])), 0.0
    by_class = np.ascontiguousarray(emit_p.T)
    order = np.argsort(-sizes, kind="stable")
    for at in range(0, len(order), PIECES_AT_ONCE):
        some = order[at : at + PIECES_AT_ONCE]
        s, z = starts[some], sizes[some]
        longest = int(z[0])
        active = np.searchsorted(-z, -np.arange(longest), side="left")  # pieces longer than t
        alphas, scales, obs = [], [], []
        alpha = None
        for t in range(longest):
            n = active[t]
            c = seq[s[:n] + t]
            alpha = (start_p if t == 0 else alpha[:n] @ move_p) * by_class[c]
            scale = alpha.sum(1)
            alpha = alpha / scale[:, None]
            alphas.append(alpha), scales.append(scale), obs.append(c)
            loglik += float(np.log(scale).sum())
        beta = np.ones((active[longest - 1], k))
        gammas = [None] * longest
        for t in range(longest - 1, -1, -1):
            n = active[t]
            if len(beta) < n:
                beta = np.concatenate([beta, np.ones((n - len(beta), k))])
            gammas[t] = alphas[t] * beta
            if t:
                right = by_class[obs[t]] * beta / scales[t][:, None]
                moves += alphas[t - 1][:n].T @ right
                beta = right @ move_p.T
        first += gammas[0].sum(0)
        all_obs, all_gamma = np.concatenate(obs), np.concatenate(gammas)
        for j in range(k):
            emits[j] += np.bincount(all_obs, all_gamma[:, j], emit_p.shape[1])
    return first, moves * move_p, emits, loglik


def forward(seq, starts, sizes, start_p, move_p, emit_p) -> np.ndarray:
    """Exact natural log-likelihood of each whole sequence by the scaled forward recursion."""
    by_class = np.ascontiguousarray(emit_p.T)
    order = np.argsort(-sizes, kind="stable")
    s, z = starts[order], sizes[order]
    out = np.zeros(len(order))
    alpha = None
    active = np.searchsorted(-z, -np.arange(int(z[0]) if len(z) else 0), side="left")
    for t, n in enumerate(active):
        alpha = (start_p if t == 0 else alpha[:n] @ move_p) * by_class[seq[s[:n] + t]]
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        out[:n] += np.log(scale)
    result = np.empty_like(out)
    result[order] = out
    return result


def _counting_pass(params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_p, move_p, emit_p = params.value
        total = None
        for batch in batches:
            for row in rows_of(batch):
                seq, starts, sizes = _segments(row)
                if len(starts):
                    first, moves, emits, loglik = expected_counts(seq, starts, sizes, start_p, move_p, emit_p)
                    flat = np.concatenate([first, moves.ravel(), emits.ravel(), [loglik]])
                    total = flat if total is None else total + flat
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    return run


def fit_hmm(chunks: DataFrame, states: int = STATES, passes: int = PASSES, seed: int = 6):
    """Start, move and emission probabilities after ``passes`` rounds of Baum-Welch over all training documents."""
    spark = chunks.sparkSession
    rng = np.random.default_rng(seed)
    start_p = np.full(states, 1 / states)
    move_p = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
    emit_p = rng.dirichlet(np.full(CLASSES, 1.0), states)
    for _ in range(passes):
        params = spark.sparkContext.broadcast((start_p, move_p, emit_p))
        counted = chunks.select("held", "n_words", "cls", "inv").mapInArrow(_counting_pass(params), "counts binary")
        sums = _tree_sum(counted, ["counts"], np.float64)
        if not sums:
            break
        first, moves, emits = np.split(sums[0][:-1], [states, states + states * states])
        start_p = (first + SMOOTH) / (first + SMOOTH).sum()
        moves = moves.reshape(states, states) + SMOOTH
        move_p = moves / moves.sum(1, keepdims=True)
        emits = emits.reshape(states, CLASSES) + SMOOTH
        emit_p = emits / emits.sum(1, keepdims=True)
    return start_p, move_p, emit_p


def _scoring_pass(params, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_p, move_p, emit_p, class_log = params.value
        for batch in batches:
            for row in rows_of(batch):
                parts = sorted(row["back"] or [], key=lambda r: r["bucket"])
                total = np.frombuffer(b"".join(r["total"] for r in parts), np.int64)
                inv, n_words = np.frombuffer(row["inv"], np.int32), np.array(row["n_words"], np.int64)
                ends = np.cumsum(n_words)
                per_doc = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[np.concatenate([[0], ends])])
                sum_log = per_doc(np.log10(total + SMOOTH)[inv])
                known = per_doc((total > 0)[inv])
                seq = _with_ends(np.frombuffer(row["cls"], np.uint16)[inv], n_words)
                sizes = n_words + 1
                starts = np.cumsum(sizes) - sizes
                path = forward(seq, starts, sizes, start_p, move_p, emit_p) / math.log(10)
                spread = np.add.reduceat(class_log[seq], starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(sizes, pa.int64()),
                        pa.array(np.rint(known).astype(np.int64)), pa.array(sum_log), pa.array(path + sum_log - spread),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "sum_log", "score"],
                )

    return run


def score_documents(docs: DataFrame, states: int = STATES, passes: int = PASSES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc(F.col("doc_id")) % 10 == 0).alias("held_out"))
    chunks = stash(marked.mapInArrow(_chunks, _CHUNK), "hmm-chunks")
    facts = chunks.agg(
        F.sum("n_bytes").alias("bytes"),
        F.sum(F.size(F.filter("held", lambda x: ~x))).alias("train_docs"),
    ).first()
    n_buckets = max(1, math.ceil((facts["bytes"] or 0) / BUCKET_BYTES))
    sent = chunks.select("chunk", "uniq", "cls", "n_train").mapInArrow(_sender(n_buckets), _SENT)
    back = stash(sent.groupBy("bucket").applyInArrow(_total, _BACK), "hmm-back")
    columns = ["class_n", "class_v"]
    by_task = back.filter(F.col("chunk").isNull()).select(*columns).mapInArrow(_sum_up(columns, np.int64), "class_n binary, class_v binary")
    class_sums = _tree_sum(by_task, columns, np.int64) or [np.zeros(CLASSES, np.int64)] * 2
    class_n, class_v = class_sums
    train_docs = facts["train_docs"] or 0
    train_tokens, n_distinct = int(class_n.sum()) + train_docs, int(class_v.sum()) + (train_docs > 0)
    class_log = np.log10(class_n + SMOOTH * (class_v + 1))
    class_log[END] = 0.0
    params = spark.sparkContext.broadcast((*fit_hmm(chunks, states, passes), class_log))
    per_chunk = back.filter(F.col("chunk").isNotNull()).groupBy("chunk").agg(F.collect_list(F.struct("bucket", "total")).alias("back"))
    whole = chunks.select("chunk", "doc_ids", "held", "n_words", "cls", "inv").join(per_chunk, "chunk")
    scored = whole.mapInArrow(_scoring_pass(params, n_buckets), _SCORES)
    end_log = math.log10(train_docs + SMOOTH)
    token_log = math.log10(train_tokens + SMOOTH * (n_distinct + 1))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.lit(int(train_docs > 0))).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("sum_log") + F.lit(end_log) - F.col("n_tokens") * F.lit(token_log)).alias("base_score"),
        "score",
    )


def op6_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
