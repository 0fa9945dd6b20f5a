"""Language-model scoring with a hidden Markov model.

Tokens are the lower-cased words of a text and one end.  Counts of all training tokens are
taken over the whole corpus (they shuffle by word hash, so they grow with the input) and
give the base score, a smoothed unigram.

The HMM emits symbols: each of the TOP most frequent words is a symbol, the end is one, and
all further words share SUFFIXES symbols by a hash of their last three bytes.  A word that
shares its symbol has the share (c + 0.1) / (N_s + 0.1 (V_s + 1)) of it, with c its count and N_s, V_s
the symbol's training tokens and distinct words; so the model is a distribution over tokens
with one unknown word for each shared symbol, as the base has one in all.  A text's score is its
exact log10 likelihood by the scaled forward recursion over the whole sequence, plus its shares.

Training is Baum-Welch: in each of ROUNDS rounds every task runs forward-backward over all
its training texts, and the expected counts (states x symbols, states x states) are summed by
Spark; what reaches the driver has that fixed size.  The start is a mixture of unigrams, one for each state, over the same texts:
every text draws its shares from a hash of its symbols, and START rounds of EM sum its counts over all training texts as well.
A text of more than LONGEST tokens is learned from in parts of that length, and scored whole.

Texts are read twice; then only their symbols and rare words are kept, in a table in the
shared folder.  The counts of the COMMON most frequent words are broadcast (12 bytes each); rarer words are
joined by hash, a distinct word of a text once.  Words are told apart by 64-bit hashes.

Null texts and empty texts have one token, the end.  Repeated rows are scored alike; a null doc_id
is held in for training.  Without training rows every count is 0 and the symbols are uniform.  Words equally frequent are
ranked by hash.  Columns other than doc_id, text and held_out are left out; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.tables import written
from quarry.llm.text_arrays import LOWER, gathered, mix, slices, words

STATES = 8
ROUNDS = 3
TOP = 8192
SUFFIXES = 2048
COMMON = 262_144
#: Rounds of the mixture that the model starts from.
START = 4
#: Tokens that forward-backward holds of one text, and steps whose emissions the forward recursion holds.
LONGEST, STEPS = 1 << 18, 1 << 15
N_SYMBOLS = 1 + TOP + SUFFIXES
ADD = 0.1
#: Bytes of symbols, two a token, that share the recursion's steps.
GATHERED = 6 << 20
#: The end token's hash.
END = 0
_U = np.uint64


def suffix_symbol(w) -> np.ndarray:
    """The shared symbol of each word, by its last three bytes."""
    code = np.zeros(len(w.end), np.int64)
    for back in (1, 2, 3):
        at = w.end - back
        ok = at >= w.start
        code[ok] = code[ok] * 257 + LOWER[w.data[at[ok]]].astype(np.int64) + 1
    return (1 + TOP + (mix(code.astype(_U)) % _U(SUFFIXES)).astype(np.int64)).astype(np.int32)


def word_counts(docs: DataFrame) -> DataFrame:
    """(hash, suffix, c): counts of all tokens of docs (text); the end is hash 0, suffix 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        ends = 0

        def merged():
            h, s, n = (np.concatenate([x[i] for x in held]) for i in range(3))
            u, first, back = np.unique(h, return_index=True, return_inverse=True)
            return u, s[first], np.bincount(back, n, len(u)).astype(np.int64)

        def out(h, s, n):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(s, pa.int32()), pa.array(n, pa.int64())], names=["hash", "suffix", "c"])

        for b in batches:
            ends += b.num_rows
            for _, part in slices(b.column(0)):
                w = words(part)
                if len(w.hash):
                    u, first, n = np.unique(w.hash, return_index=True, return_counts=True)
                    held.append((u, suffix_symbol(w)[first], n))
            if sum(len(x[0]) for x in held) > 1_500_000:
                held = [merged()]
                if len(held[0][0]) > 1_000_000:
                    yield out(*held[0])
                    held = []
        if held:
            yield out(*merged())
        if ends:
            yield out(np.array([END], _U), np.zeros(1, np.int32), np.array([ends]))

    return docs.select("text").mapInArrow(run, "hash long, suffix int, c long").groupBy("hash").agg(F.min("suffix").alias("suffix"), F.sum("c").alias("c"))


class Vocabulary:
    """The COMMON most frequent words (sorted by hash) with count and symbol, and the totals."""

    def __init__(self, counts: DataFrame):
        top = self._frequent(counts.filter(F.col("hash") != END))
        order = np.lexsort((top["hash"].to_numpy(), -top["c"].to_numpy()))
        top = top.take(pa.array(order))
        h, c = top["hash"].to_numpy().view(_U), top["c"].to_numpy()
        symbol = top["suffix"].to_numpy().astype(np.int32)
        symbol[: min(TOP, len(symbol))] = np.arange(1, 1 + min(TOP, len(symbol)))
        own = h[:TOP].view(np.int64)
        total = counts.agg(F.sum("c"), F.count(F.lit(1)), F.max(F.when(F.col("hash") == END, F.col("c")))).first()
        self.N, self.V, self.end_count = int(total[0] or 0), int(total[1] or 0), int(total[2] or 0)
        # one row for each of at most SUFFIXES symbols
        shared = {r["suffix"]: (r["n"], r["v"]) for r in counts.filter(F.col("hash") != END).groupBy("suffix").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
        suffix = top["suffix"].to_numpy()[: len(own)]
        n, v = np.zeros(N_SYMBOLS), np.zeros(N_SYMBOLS)
        for s, (x, y) in shared.items():
            n[s], v[s] = x, y
        np.subtract.at(n, suffix, c[: len(own)].astype(float))
        np.subtract.at(v, suffix, 1.0)
        self.log_share_below = np.log10(n + ADD * (v + 1))
        self.log_share_below[: 1 + TOP] = 0
        self.prior = np.concatenate(([self.end_count], np.zeros(TOP), n[1 + TOP :] + ADD * (v[1 + TOP :] + 1))) + ADD
        self.prior[1 : 1 + len(own)] += c[: len(own)]
        order = np.argsort(h)
        self.hash, self.count, self.symbol = h[order], c[order].astype(np.int64), symbol[order]

    @staticmethod
    def _frequent(counts: DataFrame) -> pa.Table:
        """At most COMMON words: those above the count from which on there are no more.

        Found by a histogram of counts (exact below 2**20, then a thousand steps a doubling: of bounded size), so that no
        task sends its own top words.
        """
        step = F.when(F.col("c") < 1 << 20, F.col("c")).otherwise((1 << 20) + F.floor((F.log2("c") - 20) * 1000)).cast("long")
        steps = counts.select(step.alias("k"), "hash", "suffix", "c")
        hist = steps.groupBy("k").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("k", "descending")])
        fit = np.cumsum(hist["n"].to_numpy()) <= COMMON
        lowest = int(hist["k"].to_numpy()[fit][-1]) if fit.any() else 1 << 62
        return steps.filter(F.col("k") >= lowest).select("hash", "suffix", "c").toArrow()

    def base_below(self) -> float:
        return float(np.log10(self.N + ADD * (self.V + 1)))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, whether it is there)"""
        if not len(self.hash):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return at, self.hash[at] == h


def symbol_table(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(row_id, doc_id, held_out, symbols, n_common, log_counts, log_shares, rare, rare_n): docs (row_id, doc_id, held_out, text) as symbols.

    log_counts: sum of log10(c + 0.1) over the common tokens; log_shares: sum over all tokens of
    what its share adds, but for the rare ones' own log10(c + 0.1).
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        log_c = np.log10(v.count + ADD)
        end_log = float(np.log10(v.end_count + ADD))
        for b in batches:
            for first, part in slices(b.column(3)):
                w = words(part)
                u, one, back = np.unique(w.hash, return_index=True, return_inverse=True)
                at, known = v.find(u)
                symbol = np.where(known, v.symbol[at] if len(v.symbol) else 0, suffix_symbol(w)[one]) if len(u) else np.zeros(0, np.int64)
                logs = np.where(known, log_c[at], 0.0) if len(log_c) else np.zeros(len(u))
                share = np.where(symbol > TOP, logs - v.log_share_below[symbol], 0.0)
                rows = []
                for i in range(len(part)):
                    t = back[w.first[i] : w.first[i + 1]]
                    k = known[t]
                    rare, n = np.unique(u[t[~k]], return_counts=True)
                    rows.append((np.append(symbol[t], 0).astype("<u2").tobytes(), int(k.sum()) + (v.end_count > 0), float(logs[t].sum()) + end_log, float(share[t].sum()), rare.view(np.int64).tolist(), n.tolist()))
                kept = [b.column(i).slice(first, len(part)) for i in range(3)]
                cols = list(zip(*rows))
                kinds = [pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=TABLE_NAMES)

    return docs.select("row_id", "doc_id", "held_out", "text").mapInArrow(run, TABLE)


TABLE = "row_id long, doc_id long, held_out boolean, symbols binary, n_common long, log_counts double, log_shares double, rare array<long>, rare_n array<long>"
TABLE_NAMES = [x.split()[0] for x in TABLE.split(", ")]


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # emit: symbol x state


def _aligned(seqs: list[np.ndarray]):
    """Sequences by falling length, laid out step by step: symbols, first cell of each step, sequences at each step."""
    length = np.array([len(x) for x in seqs])
    order = np.argsort(-length, kind="stable")
    length = length[order]
    steps = int(length[0])
    active = np.searchsorted(-length, -np.arange(1, steps + 1), "right")
    first = np.concatenate(([0], np.cumsum(active)))
    flat = np.empty(int(first[-1]), np.int64)
    for rank, i in enumerate(order.tolist()):
        flat[first[: length[rank]] + rank] = seqs[i]
    return order, length, active.tolist(), first.tolist(), flat


def _groups(seqs: list[np.ndarray], most: int = 600_000):
    """Index lists of sequences of similar length with about `most` tokens together."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    group, n = [], 0
    for i in order:
        if group and n + len(seqs[i]) > most:
            yield group
            group, n = [], 0
        group.append(i)
        n += len(seqs[i])
    if group:
        yield group


def forward(m: Model, seqs: list[np.ndarray], keep: bool = False):
    """log10 likelihood of each sequence (none is empty); with keep, what the backward recursion needs."""
    order, length, active, first, flat = _aligned(seqs)
    cells = len(flat)
    e = m.emit[flat] if keep else None
    alpha = np.empty((cells, m.emit.shape[1])) if keep else None
    scale = np.empty(cells) if keep else None
    logs = np.zeros(len(seqs))
    a, part, begin = None, e, 0
    for t, n in enumerate(active):
        z = first[t]
        if not keep and (part is None or z + n > begin + len(part)):
            # the emissions of some steps at a time
            last = int(np.searchsorted(first, z + max(STEPS, n), "right")) - 1
            begin, part = z, m.emit[flat[z : first[last]]]
        x = part[z - begin : z - begin + n]
        a = (m.start * x) if t == 0 else (a[:n] @ m.move) * x
        c = a.sum(axis=1)
        a /= c[:, None]
        logs[:n] += np.log10(c)
        if keep:
            alpha[z : z + n], scale[z : z + n] = a, c
    out = np.empty(len(seqs))
    out[order] = logs
    return (out, (active, first, flat, e, alpha, scale)) if keep else out


def expected(m: Model, seqs: list[np.ndarray], emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> None:
    """Adds the sequences' expected counts."""
    _, (active, first, flat, e, alpha, scale) = forward(m, seqs, True)
    beta = None
    for t in range(len(active) - 1, -1, -1):
        n, z = active[t], first[t]
        now = np.ones((n, e.shape[1]))
        if beta is not None:
            k = active[t + 1]
            y = first[t + 1]
            x = e[y : y + k] * beta / scale[y : y + k, None]
            move += (alpha[z : z + k].T @ x) * m.move
            now[:k] = x @ m.move.T
        beta = now
        alpha[z : z + n] *= now  # alpha becomes the posterior
    start += alpha[: active[0]].sum(axis=0)
    for s in range(e.shape[1]):
        emit[:, s] += np.bincount(flat, alpha[:, s], len(emit))


def _initial(x: np.ndarray, states: int) -> np.ndarray:
    """A text's first shares of the states: exponential numbers drawn from a hash of its symbols, cubed to be uneven."""
    h = mix(x.astype(_U) + _U(1)).sum(dtype=_U) + np.arange(1, states + 1, dtype=_U)
    u = ((mix(h) >> _U(11)).astype(float) + 0.5) / float(1 << 53)
    w = (-np.log(u)) ** 3
    return w / w.sum()


def _mixed(seqs: list[np.ndarray], emit: np.ndarray | None, weight: np.ndarray | None, states: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts by symbol and state, and shares of the states, of a mixture of unigrams over whole texts."""
    if emit is None:
        post = np.stack([_initial(x, states) for x in seqs])
    else:
        log = np.log(emit)
        logs = np.stack([log[x].sum(axis=0) / max(1.0, len(x) / 60) for x in seqs]) + np.log(weight)  # tempered: long texts would freeze the first shares
        post = np.exp(logs - logs.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
    doc = np.repeat(np.arange(len(seqs)), [len(x) for x in seqs])
    flat = np.concatenate(seqs)
    return np.stack([np.bincount(flat, post[doc, s], n) for s in range(states)], 1), post.sum(axis=0)


def train(table: DataFrame, prior: np.ndarray, states: int = STATES, rounds: int = ROUNDS, start_rounds: int = START) -> Model:
    """A mixture's rounds, then Baum-Welch's, over all rows of table that aren't held out."""
    sc = table.sparkSession.sparkContext
    n = len(prior)
    share = prior / prior.sum()
    rows = table.filter("not held_out").select("symbols")

    def summed(task) -> np.ndarray:
        """The sums over all texts of what task(sequences, emit, move, start) adds."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            emit, move, start = np.zeros((n, states)), np.zeros((states, states)), np.zeros(states)
            for b in gathered(batches, 0, GATHERED):
                seqs = [np.frombuffer(x.as_py(), "<u2") for x in b.column(0)]
                seqs = [x[i : i + LONGEST] for x in seqs for i in range(0, len(x), LONGEST)]
                for group in _groups(seqs):
                    task([seqs[i] for i in group], emit, move, start)
            out = np.concatenate([emit.ravel(), move.ravel(), start])
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out[at])], names=["i", "x"])

        sums = rows.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
        flat = np.zeros(n * states + states * states + states)
        flat[sums["i"].to_numpy()] = sums["x"].to_numpy()
        return flat

    emit = weight = None
    for _ in range(start_rounds):
        sent = sc.broadcast((emit, weight))

        def mixture(seqs, emit, move, start):
            counts, shares = _mixed(seqs, *sent.value, states, n)
            emit += counts
            start += shares

        flat = summed(mixture)
        sent.destroy()
        counts = flat[: n * states].reshape(n, states) + 20.0 * share[:, None]
        emit, weight = counts / counts.sum(axis=0), flat[-states:] + 1e-3
        weight = weight / weight.sum()
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9)
    m = Model(np.full(states, 1 / states), move, np.repeat(share[:, None], states, axis=1) if emit is None else emit)
    for _ in range(rounds):
        sent = sc.broadcast(m)

        def baum_welch(seqs, emit, move, start):
            expected(sent.value, seqs, emit, move, start)

        flat = summed(baum_welch)
        sent.destroy()
        emit = flat[: n * states].reshape(n, states) + 10.0 * share[:, None]
        move = flat[n * states : -states].reshape(states, states) + 0.1
        start = flat[-states:] + 0.1
        m = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return m


def likelihoods(table: DataFrame, m: Model) -> DataFrame:
    """(row_id, n_tokens, hmm): exact log10 likelihood of every row's symbols."""
    sent = table.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in gathered(batches, 1, GATHERED):
            seqs = [np.frombuffer(x, "<u2") for x in b.column(1).to_pylist()]
            out = np.zeros(len(seqs))
            for group in _groups(seqs):
                out[group] = forward(m, [seqs[i] for i in group])
            rest = [b.column(i) for i in (0, *range(2, b.num_columns))]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([len(x) for x in seqs], pa.int64()), pa.array(out)], names=["row_id", "doc_id", "held_out", "n_common", "log_counts", "log_shares", "n_tokens", "hmm"])

    return table.select("row_id", "symbols", "doc_id", "held_out", "n_common", "log_counts", "log_shares").mapInArrow(
        run, "row_id long, doc_id long, held_out boolean, n_common long, log_counts double, log_shares double, n_tokens long, hmm double"
    )


def score(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, held_out) scored; see the module."""
    train_rows = docs.filter("not held_out")
    counts = written(word_counts(train_rows))
    v = Vocabulary(counts)
    table = written(symbol_table(docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text"), v))
    m = train(table, v.prior)
    rare = table.filter(F.size("rare") > 0).select("row_id", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row_id", F.col("x.rare").alias("hash"), F.col("x.rare_n").alias("n"))
    # words outside the most frequent: none is a hot key
    joined = rare.join(counts.select("hash", "c"), "hash", "left")
    rare_sums = joined.groupBy("row_id").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + ADD)).alias("rare_logs"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known")
    )
    out = likelihoods(table, m).join(rare_sums, "row_id", "left")
    logs = F.coalesce("rare_logs", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(v.N).cast("long").alias("train_tokens"),
        (F.col("log_counts") + logs - F.col("n_tokens") * F.lit(v.base_below())).alias("base_score"),
        (F.col("hmm") + F.col("log_shares") + logs).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    return score(docs.select("doc_id", "text", held.alias("held_out")))
