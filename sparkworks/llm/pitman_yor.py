"""A hierarchical Pitman-Yor language model over words (operator 2).

A restaurant for each context, which is the class of the previous word, has
the restaurant of no context as its parent, and that one a uniform base over
the known words and one unknown.  Words fall into ``CLASSES`` context classes
by hash, so that what restaurants share, a few numbers a class, has a fixed
size, however large the corpus is; counts are per (word, class) and grow with
the corpus.

Seating.  Given an auxiliary gamma variable for each restaurant, g, which
follows Gamma(strength / discount + tables), the dishes of a restaurant are
independent: the number of tables t of a dish with c customers has probability
proportional to S(c, t) * (discount * g * parent's probability) ** t, with S
the generalised Stirling numbers.  So a Gibbs sweep draws g for every
restaurant on the driver and all table counts in the tasks; a table in a
context restaurant is a customer of the parent, whose tables are drawn next.
Draws come from hashes of (word, class, sweep), so a task that runs again
seats everyone alike, and later sweeps replay earlier ones instead of storing
the seating.  For dishes with more than ``EXACT`` customers, t is drawn from
the normal limit of the same distribution.

A text's score is the sum of log10 of each word's predictive probability,
averaged over the sweeps after burn-in.

Layout.  Words are dealt into buckets by hash, and a very frequent word's
classes into several.  A task packs what it has for a bucket into one row, so
Spark shuffles some hundred bytes a row for a few thousand words.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkworks.llm.common import settle
from sparkworks.llm.textnum import mix, run_starts, text_buffers, uniform, word_chunks

CLASSES = 1 << 16
EXACT = 64
#: Tokens that a task gathers before it packs them, and about as many meet in a bucket.
BLOCK_TOKENS = 1_500_000
BLOCK_DOCUMENTS = 60_000

_END = np.uint64(0xE0D0E0D0E0D0E0D1)
_START = np.uint64(0x57A2757A2757A275)
_LOW = np.uint64(CLASSES - 1)
_WORD_BITS = np.uint64(16)

TOTAL, TABLES, CUSTOMERS, HOT = range(4)
#: Keys of the TOTAL rows.
N_TOKENS, N_WORDS, C1, T1, ONCE, TWICE, ONCE1, TWICE1 = range(8)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    parts = [pa.compress(pa.py_buffer(np.ascontiguousarray(a)), codec="zstd", asbytes=True) for a in arrays]
    head = b"".join(struct.pack("<II", len(p), a.nbytes) for p, a in zip(parts, arrays, strict=True))
    return head + b"".join(parts)


def unpack_arrays(data: bytes, *kinds: type) -> list[np.ndarray]:
    at, out = 8 * len(kinds), []
    for k, kind in enumerate(kinds):
        size, whole = struct.unpack_from("<II", data, 8 * k)
        out.append(np.frombuffer(pa.decompress(data[at : at + size], whole, codec="zstd", asbytes=True), kind) if whole else np.zeros(0, kind))
        at += size
    return out


def split_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, entries per word and classes of sorted keys."""
    words = keys >> _WORD_BITS
    first = run_starts(words)
    return words[first], np.diff(np.append(first, len(keys))).astype(np.uint32), (keys & _LOW).astype(np.uint16)


def join_keys(words: np.ndarray, entries: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return (np.repeat(words, entries) << _WORD_BITS) | classes.astype(np.uint64)


# --- tokens ------------------------------------------------------------------


def token_stream(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word keys (48 bits), context classes and tokens per document, ends included."""
    n_docs = len(words.at) - 1
    n_tokens = np.diff(words.at) + 1
    at = np.concatenate(([0], np.cumsum(n_tokens)))
    token = np.empty(at[-1], np.uint64)
    is_end = np.zeros(at[-1], bool)
    is_end[at[1:] - 1] = True
    token[~is_end] = words.hash
    token[is_end] = _END
    before = np.empty(at[-1], np.uint64)
    before[1:] = token[:-1]
    if n_docs:
        before[at[:-1]] = _START
    return token >> _WORD_BITS, mix(before) >> np.uint64(48), n_tokens


@dataclass(frozen=True)
class Dealing:
    """How words are dealt into buckets: ``hot`` words (sorted) over ``shares`` of their own."""

    buckets: int
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    shares: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def find_hot(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is hot, place in ``hot``)."""
        if not len(self.hot):
            return np.zeros(len(words), bool), np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
        return self.hot[at] == words, at

    def __call__(self, words: np.ndarray, classes: np.ndarray) -> np.ndarray:
        is_hot, at = self.find_hot(words)
        salt = np.zeros(len(words), np.uint64)
        if is_hot.any():
            salt[is_hot] = classes[is_hot].astype(np.uint64) % self.shares[at[is_hot]].astype(np.uint64)
        return (mix(words + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.buckets)).astype(np.int32)


def _blocks(batches: Iterator[pa.RecordBatch], only_learned: bool) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(record batches of ids, words, classes, tokens per document) of about BLOCK_TOKENS tokens."""
    held: list[list] = [[], [], [], []]
    tokens = documents = 0
    for batch in batches:
        for a, b, words in word_chunks(batch["text"], lower=True):
            word, context, per_doc = token_stream(words)
            if tokens and (tokens + len(word) > BLOCK_TOKENS or documents + b - a > BLOCK_DOCUMENTS):
                yield held[0], *(np.concatenate(h) for h in held[1:])
                held, tokens, documents = [[], [], [], []], 0, 0
            for part, value in zip(held, (batch.slice(a, b - a), word, context, per_doc), strict=True):
                part.append(value)
            tokens, documents = tokens + len(word), documents + b - a
    if documents:
        yield held[0], *(np.concatenate(h) for h in held[1:])


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words that are frequent in some chunk, and of all tokens (as word -1)."""
    counts: dict[int, int] = {}
    total = 0
    for batch in batches:
        for _, _, words in word_chunks(batch["text"], lower=True):
            word, _, _ = token_stream(words)
            total += len(word)
            values, n = np.unique(word, return_counts=True)
            often = n >= max(2, len(word) // 2000)
            for w, c in zip(values[often].tolist(), n[often].tolist(), strict=True):
                counts[w] = counts.get(w, 0) + c
    yield pa.RecordBatch.from_arrays([pa.array([-1, *counts], pa.int64()), pa.array([total, *counts.values()], pa.int64())], ["word", "n"])


def deal(rows: DataFrame) -> Dealing:
    """Fit the dealing: at most 100,000 hot words, those with a notable part of a bucket's fill."""
    counts = rows.select("text").mapInArrow(_heavy, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = settle(counts)
    total = counts.filter("word = -1").agg(F.sum("n")).first()[0] or 0
    fill = 2 * BLOCK_TOKENS
    least = max(fill // 8, total // 100_000)
    found = sorted((r["word"], r["n"]) for r in counts.filter((F.col("word") >= 0) & (F.col("n") > least)).collect())
    shares = [min(CLASSES, -(-n // max(1, fill // 8))) for _, n in found]
    return Dealing(max(8, -(-total // fill)), np.array([w for w, _ in found], np.uint64), np.array(shares, np.int64))


# --- counts ------------------------------------------------------------------


def _emit_counts(dealing: Dealing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, word, context, _ in _blocks(batches, True):
            bucket = dealing(word, context)
            keys = (word << _WORD_BITS) | context
            order = np.argsort(bucket.astype(np.uint16) if dealing.buckets < 65536 else bucket, kind="stable")
            bucket, keys = bucket[order], keys[order]
            cuts = np.append(run_starts(bucket), len(bucket))
            names, rows = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = np.sort(keys[a:b])
                first = run_starts(own)
                count = np.diff(np.append(first, len(own))).astype(np.uint32)
                names.append(int(bucket[a]))
                rows.append(pack_arrays(*split_keys(own[first]), count))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(rows, pa.binary())], ["bucket", "data"])

    return run


def _unpack_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    words, entries, classes, count = unpack_arrays(data, np.uint64, np.uint32, np.uint16, np.uint32)
    return join_keys(words, entries, classes), count.astype(np.int64)


def _merge_counts(key: tuple, table: pa.Table) -> pa.Table:
    parts = [_unpack_counts(x) for x in table["data"].to_pylist()]
    keys, count = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, count = keys[order], count[order]
    first = run_starts(keys)
    total = np.add.reduceat(count, first)
    if total.max() > 0xFFFFFFFF:
        raise OverflowError("a word follows one context class more than 2**32 times")
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([pack_arrays(*split_keys(keys[first]), total.astype(np.uint32))], pa.binary())})


# --- seating -----------------------------------------------------------------


def stirling(discount: float) -> np.ndarray:
    """log S(c, t) for c and t up to EXACT; -inf where t > c."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, EXACT):
        t = np.arange(1, c + 1)
        stay = out[c, 1 : c + 1] + np.log(c - discount * t)
        out[c + 1, 1 : c + 1] = stay
        out[c + 1, 2 : c + 2] = np.logaddexp(out[c + 1, 2 : c + 2], out[c, 1 : c + 1])
    return out


def draw_tables(count: np.ndarray, weight: np.ndarray, chance: np.ndarray, discount: float, table: np.ndarray) -> np.ndarray:
    """Table numbers for dishes with ``count`` customers and ``weight`` a table, at the quantiles ``chance``."""
    out = np.ones(len(count), np.int64)
    for c in np.unique(count[(count > 1) & (count <= EXACT)]).tolist():
        own = np.flatnonzero(count == c)
        t = np.arange(1, c + 1)
        for a in range(0, len(own), max(1, (1 << 20) // c)):
            part = own[a : a + max(1, (1 << 20) // c)]
            logs = table[c, 1 : c + 1] + np.log(weight[part])[:, None] * t
            logs -= logs.max(axis=1, keepdims=True)
            mass = np.exp(logs).cumsum(axis=1)
            out[part] = 1 + (mass < chance[part][:, None] * mass[:, -1:]).sum(axis=1)
    own = np.flatnonzero(count > EXACT)
    if len(own):
        c, a, d = count[own].astype(np.float64), weight[own], discount
        # Sizes of tables have the generating function (1 - (1 - z) ** d) / d; z makes c the expected sum.
        low, high = np.full(len(own), -60.0), np.zeros(len(own))  # log(1 - z)
        for _ in range(50):
            middle = (low + high) / 2
            over = np.log(a) + np.log(-np.expm1(middle)) + (d - 1) * middle > np.log(c)
            low, high = np.where(over, middle, low), np.where(over, high, middle)
        y = np.exp((low + high) / 2)
        z = 1 - y
        mean = a * (1 - y**d) / d
        spread = a * (z**2 * (1 - d) * y ** (d - 2) + z * y ** (d - 1))
        deviation = np.sqrt(np.maximum(mean - c**2 / spread, 0))
        out[own] = np.clip(np.rint(mean + deviation * _normal(chance[own])), 1, count[own])
    return out


def _normal(p: np.ndarray) -> np.ndarray:
    """Quantiles of the standard normal."""
    return np.array([NormalDist().inv_cdf(x) for x in p.tolist()])


@dataclass(frozen=True)
class Sweep:
    """What a sweep has to know of the one before it, and the gamma variables drawn for it."""

    gamma: np.ndarray  # of each context class
    root_gamma: float
    customers: float  # of the restaurant without context, as are tables
    tables: float
    hot_probability: np.ndarray


@dataclass(frozen=True)
class Setting:
    dealing: Dealing
    discount: float = 0.5
    root_discount: float = 0.5
    strength: float = 1.0
    root_strength: float = 1.0
    n_words: int = 0

    @property
    def base(self) -> float:
        return 1.0 / (self.n_words + 1)

    def probability(self, customers, tables, sweep: Sweep) -> np.ndarray:
        """Predictive probabilities of words without context."""
        rest = (self.root_strength + self.root_discount * sweep.tables) * self.base
        return (customers - self.root_discount * tables + rest) / (self.root_strength + sweep.customers)


def replay(keys: np.ndarray, count: np.ndarray, setting: Setting, sweeps: list[Sweep]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(tables per key, customers and tables of the words without context) before the sweeps and after each."""
    words, entries, classes = split_keys(keys)
    first = np.concatenate(([0], np.cumsum(entries, dtype=np.int64)))[:-1]
    word_of = np.repeat(np.arange(len(words)), entries)
    is_hot, hot_at = setting.dealing.find_hot(words)
    tables = np.ones(len(keys), np.int64)
    customers, root = np.add.reduceat(tables, first), np.ones(len(words), np.int64)
    yield tables, customers, root
    several = np.flatnonzero(count > 1)
    log_s, log_s1 = stirling(setting.discount), stirling(setting.root_discount)
    for k, sweep in enumerate(sweeps, 1):
        p = setting.probability(customers, root, sweep)
        p[is_hot] = sweep.hot_probability[hot_at[is_hot]]
        weight = setting.discount * sweep.gamma[classes[several]] * p[word_of[several]]
        tables = tables.copy()
        tables[several] = draw_tables(count[several], weight, uniform(keys[several], k), setting.discount, log_s)
        customers = np.add.reduceat(tables, first)
        root = draw_tables(customers, np.full(len(words), setting.root_discount * sweep.root_gamma * setting.base), uniform(words, 1000 + k), setting.root_discount, log_s1)
        yield tables, customers, root


def _emit_sums(setting: Setting, sweeps: list[Sweep], first: bool):
    """Rows (kind, key, n) of the sums after the last sweep, one set a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables_of, customers_of = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        totals = np.zeros(8, np.int64)
        hot: dict[int, np.ndarray] = {}
        for batch in batches:
            for data in batch["data"].to_pylist():
                keys, count = _unpack_counts(data)
                for tables, customers, root in replay(keys, count, setting, sweeps):
                    pass
                classes = (keys & _LOW).astype(np.int64)
                tables_of += np.bincount(classes, tables, CLASSES).astype(np.int64)
                words, entries, _ = split_keys(keys)
                is_hot, at = setting.dealing.find_hot(words)
                totals[C1] += customers[~is_hot].sum()
                totals[T1] += root[~is_hot].sum()
                if first:
                    customers_of += np.bincount(classes, count, CLASSES).astype(np.int64)
                    totals[N_TOKENS] += count.sum()
                    totals[N_WORDS] += (~is_hot).sum()
                    totals[ONCE] += (count == 1).sum()
                    totals[TWICE] += (count == 2).sum()
                    totals[ONCE1] += (entries == 1).sum()
                    totals[TWICE1] += (entries == 2).sum()
                sums = np.add.reduceat(count, np.concatenate(([0], np.cumsum(entries, dtype=np.int64)))[:-1])
                for k in np.flatnonzero(is_hot).tolist():
                    hot[int(at[k])] = hot.get(int(at[k]), 0) + np.array([customers[k], sums[k]])
        kinds, names, values = [], [], []
        for kind, vector in ((TABLES, tables_of), (CUSTOMERS, customers_of), (TOTAL, totals)):
            some = np.flatnonzero(vector)
            kinds.append(np.full(len(some), kind))
            names.append(some)
            values.append(vector[some])
        if hot:
            some = np.array(sorted(hot))
            kinds.append(np.full(2 * len(some), HOT))
            names.append(np.concatenate((2 * some, 2 * some + 1)))
            values.append(np.concatenate([[hot[k][c] for k in some.tolist()] for c in (0, 1)]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (kinds, names, values)], ["kind", "key", "n"])

    return run


@dataclass(frozen=True)
class Model:
    """Counts in buckets (a table) and the small shared numbers of each kept sweep."""

    counts: DataFrame
    setting: Setting
    sweeps: list[Sweep]  # as seen by each sweep
    after: list[Sweep]  # the shared numbers after each sweep; gamma holds the tables of each class
    context_customers: np.ndarray
    hot_counts: np.ndarray
    n_tokens: int
    burn_in: int


def learn(rows: DataFrame, sweeps: int = 4, burn_in: int = 1, seed: int = 5) -> Model:
    """Count all tokens of ``rows`` (text, learned) whose ``learned`` is true, and sample the seating."""
    dealing = deal(rows)
    counts = rows.filter("learned").select("text").mapInArrow(_emit_counts(dealing), "bucket int, data binary")
    counts = settle(counts.groupBy("bucket").applyInArrow(_merge_counts, "bucket int, data binary"))
    setting = Setting(dealing)

    def sums(setting: Setting, seen: list[Sweep], first: bool) -> dict[int, dict[int, int]]:
        out: dict[int, dict[int, int]] = {k: {} for k in range(4)}
        found = counts.select("data").mapInArrow(_emit_sums(setting, seen, first), "kind long, key long, n long")
        for r in found.groupBy("kind", "key").agg(F.sum("n").alias("n")).toLocalIterator():  # 2 * CLASSES and twice the hot words at most
            out[r["kind"]][r["key"]] = r["n"]
        return out

    vector = lambda found, size: np.array([found.get(k, 0) for k in range(size)], np.float64)
    now = sums(setting, [], True)
    totals, hot = now[TOTAL], len(dealing.hot)
    share = lambda once, twice: min(0.95, max(0.05, once / max(1, once + 2 * twice)))
    discount, root_discount = share(totals.get(ONCE, 0), totals.get(TWICE, 0)), share(totals.get(ONCE1, 0), totals.get(TWICE1, 0))
    setting = Setting(dealing, discount, root_discount, n_words=totals.get(N_WORDS, 0) + sum(now[HOT].get(2 * k + 1, 0) > 0 for k in range(hot)))
    rng = np.random.default_rng(seed)
    log_s1 = stirling(root_discount)
    hot_tables = (vector(now[HOT], 2 * hot)[::2] > 0).astype(np.int64)
    seen: list[Sweep] = []
    after: list[Sweep] = []
    for k in range(sweeps + 1):
        tables, hot_customers = vector(now[TABLES], CLASSES), vector(now[HOT], 2 * hot)[::2]
        if k:
            weight = np.full(hot, root_discount * seen[-1].root_gamma * setting.base)
            hot_tables = np.where(hot_customers > 0, draw_tables(hot_customers.astype(np.int64), weight, uniform(dealing.hot, 2000 + k), root_discount, log_s1), 0)
        customers, root = now[TOTAL].get(C1, 0) + hot_customers.sum(), now[TOTAL].get(T1, 0) + hot_tables.sum()
        state = Sweep(tables, 0.0, float(customers), float(root), np.zeros(hot))
        state = Sweep(tables, 0.0, float(customers), float(root), setting.probability(hot_customers, hot_tables, state))
        if k:
            after.append(state)
        else:
            context_customers, hot_counts = vector(now[CUSTOMERS], CLASSES), vector(now[HOT], 2 * hot)[1::2]
        if k < sweeps:
            gamma, root_gamma = rng.gamma(setting.strength / discount + tables), rng.gamma(setting.root_strength / root_discount + root)
            seen.append(Sweep(gamma, float(root_gamma), state.customers, state.tables, state.hot_probability))
            now = sums(setting, seen, False)
    return Model(counts, setting, seen, after, context_customers, hot_counts, totals.get(N_TOKENS, 0), burn_in)


# --- scoring -----------------------------------------------------------------


def _emit_tokens(dealing: Dealing, id_type: pa.DataType):
    """For each block of documents a row per bucket, and one with its documents (bucket below 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owners, word, context, per_doc in _blocks(batches, False):
            ids = pa.concat_arrays([b["id"].combine_chunks() if isinstance(b["id"], pa.ChunkedArray) else b["id"] for b in owners])
            held = pa.concat_arrays([b["held_out"] for b in owners])
            sink = pa.BufferOutputStream()
            head = pa.RecordBatch.from_arrays([ids, held, pa.array(per_doc.astype(np.int64))], ["id", "held_out", "n_tokens"])
            with pa.ipc.new_stream(sink, head.schema) as writer:
                writer.write_batch(head)
            header = sink.getvalue().to_pybytes()
            # The block's name follows from its contents, so a task that runs again gives the same.
            block = hash_bytes(header + word.tobytes())
            doc = np.repeat(np.arange(len(per_doc)), per_doc).astype(np.uint64)
            bucket = dealing(word, context)
            order = np.argsort(bucket.astype(np.uint16) if dealing.buckets < 65536 else bucket, kind="stable")
            bucket, word, context, doc = bucket[order], word[order], context[order], doc[order]
            cuts = np.append(run_starts(bucket), len(bucket))
            names, rows = [-1 - block % dealing.buckets], [header]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                distinct, rank = np.unique(word[a:b], return_inverse=True)
                # Word rank, class and document in one number: 31, 16 and 16 bits.
                own = np.sort((rank.astype(np.uint64) << np.uint64(32)) | (context[a:b] << np.uint64(16)) | doc[a:b])
                rank = (own >> np.uint64(32)).astype(np.int64)
                names.append(int(bucket[a]))
                rows.append(pack_arrays(distinct, np.bincount(rank, minlength=len(distinct)).astype(np.uint32), (own >> np.uint64(16)).astype(np.uint16), own.astype(np.uint16)))
                if sum(map(len, rows)) > 8 << 20:
                    yield _token_rows(names, block, rows)
                    names, rows = [], []
            if rows:
                yield _token_rows(names, block, rows)

    return run


def hash_bytes(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _token_rows(names: list[int], block: int, rows: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([block] * len(names), pa.int64()), pa.array(rows, pa.binary())], ["bucket", "block", "data"])


def _score_bucket(setting: Setting, sweeps: list[Sweep], after: list[Sweep], customers_of: np.ndarray, hot_counts: np.ndarray, n_tokens: int, burn_in: int) -> Callable:
    kept = range(burn_in, len(after))
    back = [(setting.strength + setting.discount * after[s].gamma) / (setting.strength + customers_of) for s in kept]
    fresh = [setting.probability(0.0, 0.0, after[s]) for s in kept]

    def run(key: tuple, tokens: pa.Table, counts: pa.Table) -> pa.Table:
        blocks, rows, kind = tokens["block"].to_pylist(), tokens["data"].to_pylist(), []
        out: list[bytes] = []
        if key[0].as_py() is not None and key[0].as_py() < 0:  # the documents of blocks pass
            return pa.table({"block": pa.array(blocks, pa.int64()), "head": pa.array([True] * len(rows)), "data": pa.array(rows, pa.binary())})
        keys, count = _unpack_counts(counts["data"][0].as_py()) if counts.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        words, entries, classes = split_keys(keys)
        total = np.add.reduceat(count, np.concatenate(([0], np.cumsum(entries, dtype=np.int64)))[:-1]) if len(words) else np.zeros(0, np.int64)
        is_hot, at = setting.dealing.find_hot(words)
        total[is_hot] = hot_counts[at[is_hot]]
        own = np.zeros(len(keys))
        parent = []
        if len(words):
            for s, (tables, customers, root) in enumerate(replay(keys, count, setting, sweeps), -1):
                if s in kept:
                    own += (count - setting.discount * tables) / (setting.strength + customers_of[classes]) / len(kept)
                    p = setting.probability(customers, root, after[s])
                    p[is_hot] = after[s].hot_probability[at[is_hot]]
                    parent.append(p)
        scale = n_tokens + 0.1 * (setting.n_words + 1)
        for data in rows:
            distinct, size, cls, doc = unpack_arrays(data, np.uint64, np.uint32, np.uint16, np.uint16)
            hot, hot_at = setting.dealing.find_hot(distinct)
            where = np.searchsorted(words, distinct)
            there = np.zeros(len(distinct), bool)
            inside = where < len(words)
            there[inside] = words[where[inside]] == distinct[inside]
            c = np.zeros(len(distinct), np.float64)
            c[there] = total[where[there]]
            if hot.any():  # a share of a hot word may hold none of its training tokens
                c[hot] = hot_counts[hot_at[hot]]
            rank = np.repeat(np.arange(len(distinct)), size)
            p = np.zeros(len(doc))
            for s in range(len(kept)):
                q = np.full(len(distinct), fresh[s])
                if len(words):
                    q[there] = parent[s][where[there]]
                if hot.any():
                    q[hot] = after[kept[s]].hot_probability[hot_at[hot]]
                p += q[rank] * back[s][cls] / len(kept)
            if len(keys):
                mine = (distinct[rank] << _WORD_BITS) | cls
                k = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                hit = keys[k] == mine
                p[hit] += own[k[hit]]
            n = int(doc.max()) + 1
            base = np.log10((c + 0.1) / scale)
            sums = [np.bincount(doc, x, n) for x in (np.log10(p), base[rank], (c > 0)[rank])]
            some = np.flatnonzero(np.bincount(doc, minlength=n))
            out.append(pack_arrays(some.astype(np.uint16), sums[0][some], sums[1][some], sums[2][some].astype(np.uint32)))
        return pa.table({"block": pa.array(blocks, pa.int64()), "head": pa.array([False] * len(out), pa.bool_()), "data": pa.array(out, pa.binary())})

    return run


def _finish(n_tokens: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        heads = [pa.ipc.open_stream(x).read_all() for x, h in zip(table["data"].to_pylist(), table["head"].to_pylist(), strict=True) if h]
        head = heads[0]
        n = head.num_rows
        score, base, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        parts = sorted(x for x, h in zip(table["data"].to_pylist(), table["head"].to_pylist(), strict=True) if not h)
        for data in parts:  # in one order, so that sums of floats come out alike
            doc, s, b, k = unpack_arrays(data, np.uint16, np.float64, np.float64, np.uint32)
            score[doc] += s
            base[doc] += b
            known[doc] += k
        # Blocks with the same contents have the same name, and all their parts came as often.
        score, base, known = score / len(heads), base / len(heads), known // len(heads)
        whole = pa.table({"doc_id": head["id"], "held_out": head["held_out"], "n_tokens": head["n_tokens"], "n_known": pa.array(known), "train_tokens": pa.array(np.full(n, n_tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(score)})
        return pa.concat_tables([whole] * len(heads))

    return run


def score_texts(df: DataFrame, learned: Column, id_col: str = "doc_id", text_col: str = "text", sweeps: int = 4, burn_in: int = 1) -> DataFrame:
    """Learn from the rows with ``learned`` and score all whole texts.

    Per row: doc_id, held_out (not learned from), n_tokens, n_known,
    train_tokens, base_score and score (log10 probabilities).  Texts are
    lower-cased (A-Z), split at ASCII white space and closed by an end token;
    a null text counts as empty and has the end token alone.  Rows that repeat
    an id, or have none, are scored like others.  Without rows to learn from,
    every token is unknown.  An empty table gives no rows; other columns are
    ignored.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(learned, F.lit(False)).alias("learned"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = learn(rows, sweeps, burn_in)
    kind = rows.schema["id"].dataType.simpleString()
    tokens = rows.select("id", (~F.col("learned")).alias("held_out"), "text").mapInArrow(_emit_tokens(model.setting.dealing, None), "bucket int, block long, data binary")
    scored = tokens.groupBy("bucket").cogroup(model.counts.groupBy("bucket")).applyInArrow(
        _score_bucket(model.setting, model.sweeps, model.after, model.context_customers, model.hot_counts, model.n_tokens, model.burn_in), "block long, head boolean, data binary"
    )
    fields = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return scored.groupBy("block").applyInArrow(_finish(model.n_tokens), fields)
