"""Katz backoff: Good-Turing discounts, exactly normalised backoff weights, scores of whole texts.

Documents are packed into blocks of about a million tokens. A block asks for what its own texts hold, once
per distinct n-gram: it sends its sorted 64-bit n-gram hashes with their training
counts to the part of the model that covers their hash range, and gets back, in
the same order and so without the hashes, the corpus counts. What one part or
block has to hold is bounded by design, and an n-gram that fills a third of the corpus
is one entry a block. One block is named the owner of each n-gram; owners
add up, per context, how many continuations have each count, in integers. From
these sums the context's part gets the backoff weight, one order after the other:

    P(w)     = d(c(w)) c(w) / N, scaled so that unknown words keep the rest
    P(w | h) = d(c(hw)) c(hw) / c(h)  if hw was seen, else  a(h) P(w | h')
    a(h)     = (1 - sum of P(w | h) over seen w) / (1 - sum of P(w | h') over seen w)

h' is h without its first word; texts begin with start marks. d(r) is the Good-Turing
discount of counts up to K, from counts of counts smoothed by log-linear regression (Gale and Sampson 1995),
so it lies between zero and one at any size of the corpus. A context whose counts
are all above K would keep nothing for the rest; its divisor is then c(h) + 1.
The counts and weights are written as tables partitioned by kind, order and one of
RANGES hash ranges. Two distinct n-grams would have to share a 64-bit hash to be confused.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch, quoted

K = 5
COUNTS = 64
FLATTEST = -1.1
RANGES = 8
BLOCK_TOKENS = 1 << 20
PART_ENTRIES = 1 << 20
END, START = b" end", b" start"  # no word holds a space
_BLOCKS = "block long, ids array<long>, held array<boolean>, sizes array<long>, tokens binary, words binary, n_tokens long, n_words long"
_ASKED = "level int, part int, block long, entries long, keys binary, counts binary"
_TOLD = "kind string, level int, span int, part int, block long, keys binary, counts binary, own binary, hist array<long>, total long, types long"
_SUMS = "part int, block long, keys binary, sums binary, lower binary, need binary"
_WEIGHTS = "kind string, level int, span int, part int, block long, keys binary, divisor binary, alpha binary"
_SCORES = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def pack(a: np.ndarray) -> bytes:
    """Bytes of equal place stand together, so the high zeros of small numbers vanish."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def unpack(b: bytes, kind=np.int64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, len(raw) // np.dtype(kind).itemsize).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of an ordered pair of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the hash ranges of the parts begin and end in sorted keys."""
    inner = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, inner), [len(keys)]))


class Block:
    """Texts as places in a sorted list of word hashes, and their distinct n-grams by hash.

    Of each order k: keys[k] sorted, at[k] each token's n-gram. From order two on also context[k] and lower[k],
    of each n-gram its place in contexts[k] (sorted keys, of all that stand before a token) and its n-gram without the first word in keys[k - 1].
    """

    def __init__(self, row, order: int):
        self.ids, self.held, self.sizes = row["ids"], np.array(row["held"], bool), np.array(row["sizes"], np.int64)
        tokens = unpack(row["tokens"], np.uint32).astype(np.int64)
        words = unpack_sorted(row["words"])
        self.order, self.train = order, np.repeat(~self.held, self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.keys, self.at, self.contexts, self.context, self.lower, self.shorter = {1: words}, {1: tokens}, {}, {}, {}, {}
        mark = word = np.uint64(xxhash.xxh3_64_intdigest(START))
        stood = None  # each token's place in the contexts of the order before
        for k in range(2, order + 1):
            before = np.concatenate(([0], self.at[k - 1][:-1]))
            before[self.starts] = len(self.keys[k - 1])
            pairs, at = np.unique(before << 32 | tokens, return_inverse=True)
            every = np.append(self.keys[k - 1], mark)
            keys = mix(every[pairs >> 32], words[pairs & 0xFFFFFFFF])
            sort = np.argsort(keys, kind="stable")
            place = np.empty(len(sort), np.int64)
            place[sort] = np.arange(len(sort))
            self.keys[k], self.at[k] = keys[sort], place[at]
            self.contexts[k], self.context[k] = np.unique(every[pairs[sort] >> 32], return_inverse=True)
            self.lower[k] = np.empty(len(keys), np.int64)
            self.lower[k][self.at[k]] = self.at[k - 1]
            stands = self.context[k][self.at[k]]
            if stood is not None:
                #: of each context the one without its first word
                self.shorter[k] = np.empty(len(self.contexts[k]), np.int64)
                self.shorter[k][stands] = stood
            stood, mark = stands, mix(np.array([mark]), np.array([word]))[0]

    def counts(self, k: int) -> np.ndarray:
        """How often training texts of this block have each n-gram."""
        return np.bincount(self.at[k][self.train], minlength=len(self.keys[k]))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Columns id, held, text to blocks."""
    task, made = TaskContext.get().partitionId(), 0
    vocabulary: defaultdict = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    ids, held, sizes, tokens = [], [], [], []

    def flush() -> pd.DataFrame:
        digest = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))
        words, place = np.unique(digest, return_inverse=True)
        flat = place[np.concatenate(tokens)].astype(np.uint32)
        out = pd.DataFrame([[task << 24 | made, list(ids), list(held), list(sizes), pack(flat), pack_sorted(words), len(flat), len(words)]], columns=["block", "ids", "held", "sizes", "tokens", "words", "n_tokens", "n_words"])
        for x in (vocabulary, ids, held, sizes, tokens):
            x.clear()
        return out

    total = 0
    for batch in batches:
        for i, h, text in zip(*(batch.column(c) for c in range(3))):
            words = (text.as_py() or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
            words.append(END)
            tokens.append(np.fromiter(map(vocabulary.__getitem__, words), np.uint32, len(words)))
            ids.append(i.as_py())
            held.append(h.as_py())
            sizes.append(len(words))
            total += len(words)
            if total >= BLOCK_TOKENS:
                yield flush()
                made, total = made + 1, 0
    if ids:
        yield flush()


def _packed_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("tokens", pa.binary()), ("words", pa.binary()), ("n_tokens", pa.int64()), ("n_words", pa.int64())])
    for frame in _packed(batches):
        yield pa.RecordBatch.from_pylist(frame.to_dict("records"), kinds)


def _asked(parts: list[int]):
    """Each block's distinct n-grams with their training counts, cut by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            block = Block(row, len(parts))
            for level, n_parts in enumerate(parts, 1):
                keys, n = block.keys[level], block.counts(level)
                edges = cuts(keys, n_parts)
                rows = [(level, p, row["block"], int(b - a), pack_sorted(keys[a:b]), pack(n[a:b])) for p, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
                names = ["level", "part", "block", "entries", "keys", "counts"]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def _told(parts: list[int]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """One hash range: corpus counts for every block that asked, the model's part, and how many n-grams have each count."""
        rows = rows.sort_values("block")
        keys, counts = [unpack_sorted(b) for b in rows["keys"]], [unpack(b) for b in rows["counts"]]
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate(counts)
        total = np.bincount(at, weights=n, minlength=len(found)).astype(np.int64)
        owner = np.zeros(len(at), bool)
        trained = np.flatnonzero(n)
        owner[trained[np.unique(at[trained], return_index=True)[1]]] = True
        level, part = int(rows["level"].iloc[0]), int(rows["part"].iloc[0])
        span = part * RANGES // parts[level - 1]
        out, a = [], 0
        for block, held in zip(rows["block"], keys):
            b = a + len(held)
            out.append(("reply", level, span, part, block, None, pack(total[at[a:b]]), np.packbits(owner[a:b]).tobytes(), None, None, None))
            a = b
        seen = total > 0
        hist = np.bincount(np.minimum(total[seen], COUNTS + 1), minlength=COUNTS + 2)[1 : COUNTS + 1]
        out.append(("model", level, span, part, None, pack_sorted(found[seen]), pack(total[seen]), None, list(map(int, hist)), int(total.sum()), int(seen.sum())))
        return pd.DataFrame(out, columns=["kind", "level", "span", "part", "block", "keys", "counts", "own", "hist", "total", "types"]).astype({"block": "Int64", "total": "Int64", "types": "Int64"})

    return run


def slope(n: list[int]) -> float:
    """The exponent b of n(r) = a r ** b over counts of counts n(1), n(2) ...: each is spread over the gap to its neighbours that aren't zero, then log n is fitted by least squares. FLATTEST at most, as r n(r) has to fall for Good-Turing; -2 (Zipf's law) where fewer than two counts occur."""
    r = np.array([i for i, x in enumerate(n, 1) if x], float)
    if len(r) < 2:
        return -2.0
    before, after = np.concatenate(([0.0], r[:-1])), np.append(r[1:], 2 * r[-1] - r[-2])
    z = np.array([x for x in n if x], float) / ((after - before) / 2)
    return min(FLATTEST, float(np.polyfit(np.log(r), np.log(z), 1)[0]))


def discounts(n: list[int]) -> list[float]:
    """d(1) to d(K) from the counts of counts: Katz's, of the smoothed Good-Turing counts r* = (r + 1) n(r + 1) / n(r)."""
    b = slope(n)
    rest = (K + 1) ** (b + 1)  # (K + 1) n(K + 1) / n(1)
    return [(((r + 1) / r) ** (b + 1) - rest) / (1 - rest) for r in range(1, K + 1)]


class Levels:
    """What all parts share: totals, the discounts of each order and the unigram distribution."""

    def __init__(self, stats: dict[int, tuple[list[int], int, int]], order: int):
        every = {k: stats.get(k, ([0] * COUNTS, 0, 0)) for k in range(1, order + 1)}
        n1, self.tokens, self.types = every[1]
        self.d = {k: np.array(discounts(n)) for k, (n, _, _) in every.items()}
        kept = self.tokens - sum((1 - d) * r * n for r, (d, n) in enumerate(zip(self.d[1], n1), 1))
        rest = 1 - kept / self.tokens if self.tokens else 1.0
        self.unknown = min(1.0, max(rest, 0.5 / (self.tokens + 1)))
        self.scale = (1 - self.unknown) / kept if kept else 0.0

    def mass(self, counts: np.ndarray, k: int) -> np.ndarray:
        """d(r) r."""
        return np.concatenate(([0.0], self.d[k], [1.0]))[np.minimum(counts, K + 1)] * counts

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.mass(counts, 1) * self.scale, self.unknown)

    def context(self, sums: np.ndarray, k: int, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Divisor and backoff weight from sums, a row a context: continuations by count 1..K, the sum of the larger counts, and the same of their counts without the first word; lower is the divisor of the shorter context."""
        r = np.arange(1, K + 1)
        seen = sums[:, :K] @ r + sums[:, K]
        kept = sums[:, :K] @ (r * self.d[k]) + sums[:, K]
        less = sums[:, K + 1 : 2 * K + 1] @ (r * self.d[k - 1]) + sums[:, 2 * K + 1]
        less = less * self.scale if k == 2 else less / np.maximum(lower, 1)
        divisor = seen + ((kept >= seen) & (seen > 0))
        with np.errstate(invalid="ignore", divide="ignore"):
            alpha = np.where(seen > 0, (1 - kept / divisor) / np.maximum(1 - less, self.unknown if k == 2 else 1e-12), 1.0)
        return divisor.astype(np.int64), alpha


def _counts(block: Block, replies: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Corpus counts of the block's n-grams of order k, and which of them it owns."""
    own = replies[(replies["level"] == k) & replies["counts"].notna()].sort_values("part")
    counts = [unpack(b) for b in own["counts"]]
    bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(c)) for b, c in zip(own["own"], counts)]
    assert sum(map(len, counts)) == len(block.keys[k])
    return np.concatenate(counts), np.concatenate(bits).astype(bool)


def _weights(block: Block, replies: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Divisor and backoff weight of the block's contexts of order k; the weight is one where it isn't needed."""
    own = replies[(replies["level"] == k) & replies["alpha"].notna()].sort_values("part")
    divisor = np.concatenate([unpack(d) for d in own["divisor"]])
    sizes = [len(unpack(d)) for d in own["divisor"]]
    need = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(own["keys"], sizes)]).astype(bool)
    alpha = np.ones(len(divisor))
    alpha[need] = np.concatenate([unpack(a, np.float64) for a in own["alpha"]])
    assert len(divisor) == len(block.contexts[k])
    return divisor, alpha


def _summed(parts: int, k: int):
    """Per context that the block holds: sums over the continuations it owns."""

    def run(blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        block = Block(blocks.iloc[0], k)
        (less, _), (n, own) = (_counts(block, replies, j) for j in (k - 1, k))
        keys = block.contexts[k]
        sums = np.zeros((len(keys), 2 * K + 2), np.int64)
        context = block.context[k][own]
        for first, c in ((0, n[own]), (K + 1, less[block.lower[k][own]])):
            for r in range(1, K + 1):
                sums[:, first + r - 1] = np.bincount(context[c == r], minlength=len(keys))
            sums[:, first + K] = np.bincount(context[c > K], weights=c[c > K], minlength=len(keys)).astype(np.int64)
        need = np.zeros(len(keys), bool)
        need[block.context[k][n == 0]] = True
        lower = _weights(block, replies, k - 1)[0][block.shorter[k]] if k > 2 else np.zeros(len(keys), np.int64)
        edges = cuts(keys, parts)
        rows = [(p, blocks["block"].iloc[0], pack_sorted(keys[a:b]), pack(sums[a:b].T.reshape(-1)), pack(lower[a:b]), np.packbits(need[a:b]).tobytes()) for p, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
        return pd.DataFrame(rows, columns=["part", "block", "keys", "sums", "lower", "need"])

    return run


def _weighed(levels: Levels, parts: int, k: int):
    """One hash range of contexts: divisor and weight of each, and for every block those it asked for."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        keys = [unpack_sorted(b) for b in rows["keys"]]
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums, lower = np.zeros((len(found), 2 * K + 2), np.int64), np.zeros(len(found), np.int64)
        a = 0
        for held, packed, low in zip(keys, rows["sums"], rows["lower"]):
            own = at[a : a + len(held)]
            sums[own] += unpack(packed).reshape(2 * K + 2, -1).T
            lower[own] = unpack(low)
            a += len(held)
        divisor, alpha = levels.context(sums, k, lower)
        out, a, part = [], 0, int(rows["part"].iloc[0])
        span = part * RANGES // parts
        for block, held, need in zip(rows["block"], keys, rows["need"]):
            own = at[a : a + len(held)]
            asked = np.unpackbits(np.frombuffer(need, np.uint8), count=len(held)).astype(bool)
            out.append(("reply", k, span, part, block, need, pack(divisor[own]), pack(alpha[own[asked]])))
            a += len(held)
        seen = divisor > 0
        out.append(("model", k, span, part, None, pack_sorted(found[seen]), pack(divisor[seen]), pack(alpha[seen])))
        return pd.DataFrame(out, columns=["kind", "level", "span", "part", "block", "keys", "divisor", "alpha"]).astype({"block": "Int64"})

    return run


def _scored(levels: Levels, order: int):
    def run(blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        block = Block(blocks.iloc[0], order)
        c1, _ = _counts(block, replies, 1)
        high = np.log10(levels.unigram(c1))
        for k in range(2, order + 1):
            n, _ = _counts(block, replies, k)
            divisor, alpha = _weights(block, replies, k)
            context = block.context[k]
            with np.errstate(divide="ignore", invalid="ignore"):
                high = np.where(n > 0, np.log10(levels.mass(n, k) / divisor[context]), np.log10(alpha[context]) + high[block.lower[k]])
        tokens = block.at[1]
        base = np.log10((c1 + 0.5) / (levels.tokens + 0.5 * (levels.types + 1)))
        add = lambda x: np.add.reduceat(x, block.starts)
        return pd.DataFrame({
            "id": pd.array([None if x is None or x != x else int(x) for x in block.ids], "Int64"), "held_out": block.held, "n_tokens": block.sizes,
            "n_known": add((c1[tokens] > 0).astype(np.int64)), "base_score": add(base[tokens]), "score": add(high[block.at[order]]),
        })

    return run


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1, order: int = 2) -> DataFrame:
    """Scores of every text under a model of n-grams up to order of the texts that aren't held out: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The id is a whole number. A text is held out if crc32 of its id as text leaves held_fold modulo
    folds; a null id counts as empty text. A null or empty text is one end token. With no
    training text every token is unknown and has probability one. Repeated rows
    are counted and scored each. Columns of docs other than id and text aren't
    carried along.
    """
    scratch = Scratch(docs.sparkSession, "katz")
    key = F.col(quoted(id_col))
    held = (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == held_fold).alias("held")
    blocks = scratch.keep(docs.select(key.cast("long").alias("id"), held, F.col(quoted(text_col)).alias("text")).mapInArrow(_packed_arrow, _BLOCKS), texts=True)
    size = blocks.agg(F.sum("n_words").alias("words"), F.sum("n_tokens").alias("tokens")).first()
    parts = [int((n or 0) // PART_ENTRIES + 1) for n in (size.words, *[size.tokens] * (order - 1))]
    packed = blocks.select("block", "ids", "held", "sizes", "tokens", "words")
    asked = packed.mapInArrow(_asked(parts), _ASKED)
    told = scratch.write(asked.groupBy("level", "part").applyInPandas(_told(parts), _TOLD), "kind", "level", "span")
    del asked
    scratch.release()
    read = docs.sparkSession.read
    model = read.schema(_TOLD).parquet(told).where("kind = 'model'")
    rows = model.groupBy("level").agg(*[F.sum(F.get("hist", F.lit(i))) for i in range(COUNTS)], F.sum("total"), F.sum("types")).collect()
    levels = Levels({r[0]: (list(r[1 : COUNTS + 1]), r[COUNTS + 1], r[COUNTS + 2]) for r in rows}, order)
    replies = read.schema(_TOLD).parquet(told).where("kind = 'reply'").select("level", "part", "block", "keys", "counts", "own", *(F.lit(None).cast("binary").alias(c) for c in ("divisor", "alpha")))
    for k in range(2, order + 1):
        needed = replies.where(F.col("level").between(k - 1, k))
        sums = packed.groupBy("block").cogroup(needed.groupBy("block")).applyInPandas(_summed(parts[max(0, k - 2)], k), _SUMS)
        weights = scratch.write(sums.groupBy("part").applyInPandas(_weighed(levels, parts[max(0, k - 2)], k), _WEIGHTS), "kind", "level", "span")
        del sums
        scratch.release()
        told_weights = read.schema(_WEIGHTS).parquet(weights).where("kind = 'reply'").select("level", "part", "block", "keys", "divisor", "alpha")
        replies = replies.unionByName(told_weights, allowMissingColumns=True)
    scores = packed.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(_scored(levels, order), _SCORES)
    return scores.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(levels.tokens).cast("long").alias("train_tokens"), "base_score", "score")
