"""Language-model scores from an n-gram trie in Elias-Fano levels.

The model is a bigram with Dirichlet smoothing towards the add-one unigram:
p(w | v) = (c(v w) + mu * p1(w)) / (c(v) + mu), so an unseen pair backs off to
mu / (c(v) + mu) * p1(w). It grows with the corpus, so no machine holds all of it:

1. Texts become blocks of word codes; the distinct words of each block go to word shards (as
   many as the bytes of all texts ask for), which number them and return their training counts to the blocks.
2. Each block sends its distinct known pairs, with their training counts and the places of
   their tokens, to pair shards (by a hash of the pair, so no frequent word makes a hot one).
3. A pair shard sums the counts, builds its trie in a memory-mapped file - contexts, pointers
   and successors as Elias-Fano sequences, log probabilities in 16 bits - looks up every pair
   that the blocks sent and returns sums by document.

Arrays travel packed and compressed, one row for a block and shard.
"""

from __future__ import annotations

import math
import os
import tempfile
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.shared import gather, map_arrays, pack_arrays, partitions, read_arrays, slices, store, words

MU = 30.0
BLOCK_BYTES = 12 << 20
WORD_SHARD_BYTES = 64 << 20  # a word shard is dealt the words of about so many bytes of text
SHARD_TOKENS = 2_000_000     # a pair shard is dealt about so many tokens' pairs
FOLDS, HELD = 7, 2
STEP = 4096                  # quantisation: log10 probabilities in steps of 1/4096, down to -16
START = 0                    # the context at the start of a text


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * STEP), 0, 65535).astype(np.uint16)


def pack(**arrays: np.ndarray) -> bytes:
    """Compressed arrays; the bytes of equal weight stand together."""
    image = pack_arrays({f"{k}:{a.dtype.str}": np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T for k, a in arrays.items()})
    return len(image).to_bytes(8, "little") + pa.compress(image, "zstd", asbytes=True)


def unpack(raw: bytes) -> dict[str, np.ndarray]:
    size = int.from_bytes(raw[:8], "little")
    arrays = read_arrays(np.frombuffer(pa.decompress(raw[8:], size, "zstd"), np.uint8))
    return {name.split(":")[0]: np.ascontiguousarray(a.T).reshape(-1).view(name.split(":")[1]) for name, a in arrays.items()}


class EliasFano:
    """A monotone sequence of n values below u: about 2 + log2(u / n) bits each. The low bits are
    packed; the high bits are unary, a one for each value and a zero for each step. Both stay
    packed when queried: samples of the ones and zeros before every ``SAMPLE`` words (an eighth
    of the high bits) lead to the words that hold the i-th one or zero."""

    SAMPLE = 8               # 64-bit words of high bits from one sample to the next
    QUERIES = 1 << 15        # looked up in one step

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.width = (int(x) for x in arrays[f"{name}.size"])
        self.low, self.ones, self.zeros = (arrays[f"{name}.{k}"] for k in ("low", "ones", "zeros"))
        self.high = arrays[f"{name}.high"].reshape(-1, self.SAMPLE)
        self.steps = self.high.size * 64 - self.n

    @classmethod
    def build(cls, values: np.ndarray, name: str) -> dict[str, np.ndarray]:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = max(0, int(math.log2(max(top // max(n, 1), 1))))
        span = 64 * cls.SAMPLE
        bits = np.zeros(-(-(n + (top >> width) + 2) // span) * span, np.uint8)   # the step after the last value is there too
        bits[(values >> width) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.cumsum(np.bitwise_count(high).reshape(-1, cls.SAMPLE).sum(axis=1, dtype=np.int64))
        ones = np.concatenate(([0], ones[:-1]))
        kind = np.uint32 if len(bits) < 1 << 32 else np.uint64
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width:
            at = np.arange(n) * width
            own = (values & ((1 << width) - 1)).astype(np.uint64)
            shift = (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, at >> 6, own << shift)
            over = (at & 63) + width > 64
            np.bitwise_or.at(low, (at[over] >> 6) + 1, own[over] >> (np.uint64(64) - shift[over]))
        return {f"{name}.size": np.array([n, width]), f"{name}.low": low, f"{name}.high": high,
                f"{name}.ones": ones.astype(kind), f"{name}.zeros": (np.arange(len(ones)) * span - ones).astype(kind)}

    def select(self, i: np.ndarray, one: bool = True) -> np.ndarray:
        """Places of the i-th ones (or zeros) among the high bits."""
        samples = self.ones if one else self.zeros
        out = np.empty(len(i), np.int64)
        for at in range(0, len(i), self.QUERIES):
            part = i[at:at + self.QUERIES]
            group = np.searchsorted(samples, part.astype(samples.dtype), "right") - 1
            left = part - samples[group].astype(np.int64)
            near = self.high[group] if one else ~self.high[group]
            upto = np.cumsum(np.bitwise_count(near), axis=1, dtype=np.int64)
            k = (upto <= left[:, None]).sum(axis=1)
            row = np.arange(len(part))
            left -= np.where(k > 0, upto[row, k - 1], 0)
            word, place = near[row, k], group * (64 * self.SAMPLE) + k * 64
            for half in (32, 16, 8, 4, 2, 1):
                below = np.bitwise_count(word & np.uint64((1 << half) - 1))
                up = left >= below
                left -= np.where(up, below, 0)
                word = np.where(up, word >> np.uint64(half), word)
                place += np.where(up, half, 0)
            out[at:at + self.QUERIES] = place
        return out

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        at = i * self.width
        shift = (at & 63).astype(np.uint64)
        first = self.low[at >> 6] >> shift
        second = np.where(shift > 0, self.low[(at >> 6) + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((first | second) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.select(i) - i) << self.width | self.lows(i)

    def search(self, values: np.ndarray, start=None, end=None) -> np.ndarray:
        """Index of the first element not less than each value (within [start, end), if given): the
        zeros around its step bound a bucket, a bisection over the packed low bits gives the place."""
        bucket = np.minimum(values >> self.width, self.steps - 1)
        lo, hi = np.zeros(len(values), np.int64), self.select(bucket, one=False) - bucket
        later = np.flatnonzero(bucket)
        lo[later] = self.select(bucket[later] - 1, one=False) - (bucket[later] - 1)
        if start is not None:
            lo, hi = np.clip(lo, start, end), np.clip(hi, start, end)
        low = values & ((1 << self.width) - 1)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            less = self.lows(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        return lo


def build_trie(context: np.ndarray, word: np.ndarray, prob: np.ndarray, backoff: np.ndarray) -> bytes:
    """File image of the trie of sorted (context, word) pairs with quantised log probabilities.
    ``backoff``: per pair, of its context. Successors are stored relative to their context: each
    context goes on from the last value of the one before, which keeps the level monotone."""
    first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(context) else np.zeros(0, np.int64)
    pointers = np.concatenate((first, [len(context)])).astype(np.int64)
    last = word[pointers[1:] - 1].astype(np.int64) if len(first) else np.zeros(0, np.int64)
    base = np.cumsum(last) - last
    return pack_arrays(EliasFano.build(context[first].astype(np.int64), "context") | EliasFano.build(pointers, "pointer")
                       | EliasFano.build(word + np.repeat(base, np.diff(pointers)), "successor")
                       | {"prob": prob, "backoff": backoff[first]})


class Trie:
    """Lookups in a mapped trie file."""

    def __init__(self, path: str):
        arrays = map_arrays(path)
        self.context, self.pointer, self.successor = (EliasFano(arrays, n) for n in ("context", "pointer", "successor"))
        self.prob, self.backoff = arrays["prob"], arrays["backoff"]

    def look_up(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, quantised probability where found, quantised backoff where the context is known)."""
        found, prob, back = np.zeros(len(word), bool), np.zeros(len(word), np.uint16), np.zeros(len(word), np.uint16)
        known = np.zeros(len(word), bool)
        if not self.context.n:
            return found, prob, back
        at = np.minimum(self.context.search(context), self.context.n - 1)
        known = self.context.get(at) == context
        back[known] = self.backoff[at[known]]
        rows = np.flatnonzero(known)
        at = at[rows]
        start, end = self.pointer.get(at), self.pointer.get(at + 1)
        base = np.where(start > 0, self.successor.get(np.maximum(start - 1, 0)), 0)
        target = base + word[rows]
        place = self.successor.search(target, start, end)
        inside = place < end
        hit = inside.copy()
        hit[inside] = self.successor.get(place[inside]) == target[inside]
        found[rows[hit]] = True
        prob[rows[hit]] = self.prob[place[hit]]
        return found, prob, back


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def to_blocks(docs: DataFrame, word_shards: int) -> DataFrame:
    """Rows (block, shard, payload, doc_ids): shard -1 holds a block's tokens (codes of its distinct
    words, one end a document), the others its words of that shard with their training counts."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def blocked(batches):
        made = 0
        for batch in batches:
            for part in slices(batch, limit=BLOCK_BYTES):
                block = (TaskContext.get().partitionId() << 32) + made
                made += 1
                codes, bounds, distinct = words(part.column("text"))
                ids = part.column("doc_id").to_pylist()
                held = np.array([zlib.crc32(("" if i is None else str(i)).encode()) % FOLDS == HELD for i in ids], bool)
                codes = np.insert(codes, bounds[1:], len(distinct))
                bounds = bounds + np.arange(len(bounds))
                text = [*(w.encode() for w in distinct.to_pylist()), b""]
                shard = np.fromiter(map(xxhash.xxh64_intdigest, text, repeat(7)), np.uint64, len(text)) % np.uint64(word_shards)
                order = np.argsort(shard, kind="stable")
                code_of = np.empty(len(order), np.int64)
                code_of[order] = np.arange(len(order))
                codes, shard = code_of[codes], shard[order].astype(np.int64)
                times = np.bincount(codes[np.repeat(~held, np.diff(bounds))], minlength=len(order))
                rows = [(block, -1, pack(codes=codes.astype(np.uint32), sizes=np.diff(bounds).astype(np.uint32), held=held), ids)]
                cuts = np.searchsorted(shard, np.arange(word_shards + 1))
                for s in np.unique(shard).tolist():
                    own = [text[i] for i in order[cuts[s]:cuts[s + 1]].tolist()]
                    rows.append((block, s, pack(text=np.frombuffer(b"".join(own), np.uint8), size=np.fromiter(map(len, own), np.uint32, len(own)),
                                                times=times[cuts[s]:cuts[s + 1]].astype(np.uint32), first=np.array([cuts[s]], np.uint32)), None))
                yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                    (pa.int64(), pa.int64(), pa.binary(), pa.list_(part.column("doc_id").type)))], names=["block", "shard", "payload", "doc_ids"])

    return docs.select("doc_id", "text").mapInArrow(blocked, f"block bigint, shard bigint, payload binary, doc_ids array<{id_type}>")


def number_words(blocks: DataFrame, word_shards: int) -> DataFrame:
    """Rows (block, payload, distinct, tokens): ids and training counts of a block's words of a shard;
    the shard's distinct training words and training tokens stand on one row."""

    def numbered(table):
        parts = [unpack(p) for p in table.column("payload").to_pylist()]
        shard = table.column("shard")[0].as_py()
        sizes = np.concatenate([p["size"] for p in parts])
        whole = pa.Array.from_buffers(pa.large_binary(), len(sizes), [
            None, pa.py_buffer(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))), pa.py_buffer(np.concatenate([p["text"] for p in parts]))])
        coded = whole.dictionary_encode()
        code = coded.indices.to_numpy()
        times = np.bincount(code, np.concatenate([p["times"] for p in parts]), len(coded.dictionary)).astype(np.int64)
        if len(coded.dictionary) * word_shards + shard >= 1 << 32:
            raise OverflowError("word ids pass 32 bits: two of them make a pair's key")
        ends = np.cumsum([0, *(len(p["size"]) for p in parts)])
        payloads = [pack(first=p["first"], id=(1 + code[a:b].astype(np.int64) * word_shards + shard).astype(np.uint32), times=times[code[a:b]])
                    for p, a, b in zip(parts, ends[:-1], ends[1:], strict=True)]
        zeros = [0] * (len(parts) - 1)
        return pa.table({"block": table.column("block"), "payload": pa.array(payloads, pa.binary()),
                         "distinct": pa.array([int((times > 0).sum()), *zeros], pa.int64()), "tokens": pa.array([int(times.sum()), *zeros], pa.int64())})

    return (blocks.where("shard >= 0").select("block", "shard", "payload").groupBy("shard")
            .applyInArrow(numbered, "block bigint, payload binary, distinct bigint, tokens bigint"))


def score(docs: DataFrame, mu: float = MU) -> DataFrame:
    """Per document: doc_id, held_out (its fold took no part in the training), n_tokens, n_known,
    train_tokens, base_score (add-one unigram) and score (the trie), as log10 probabilities.

    Null and empty texts hold the end token alone; a null doc_id hashes as the empty text. With
    no training document every word is unknown. Repeated rows give repeated results. Other
    columns are not read.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    word_shards = max(1, partitions(spark), -(-size // WORD_SHARD_BYTES))
    blocks = store(to_blocks(docs, word_shards), "blocks")
    numbers = store(number_words(blocks, word_shards), "numbers")
    totals = numbers.agg(F.sum("distinct").alias("v"), F.sum("tokens").alias("n")).first()
    v, n = totals["v"] or 0, totals["n"] or 0
    sizes = blocks.where("shard = -1").agg(F.count("*").alias("blocks"), F.sum(F.length("payload")).alias("bytes")).first()
    tokens_about = (sizes["bytes"] or 0) // 2            # packed codes take about two bytes a token
    pair_shards = max(1, math.ceil(tokens_about / SHARD_TOKENS))
    unigram = n + v + 1
    id_type = docs.schema["doc_id"].dataType.simpleString()
    wide = f"block bigint, shard bigint, payload binary, doc_ids array<{id_type}>"

    def split(left, right):
        if not left.num_rows:
            return left.select(["block"]).append_column("shard", pa.array([], pa.int64())).append_column("payload", pa.array([], pa.binary())).append_column(
                "doc_ids", left.column("doc_ids"))
        block, ids = left.column("block")[0].as_py(), left.column("doc_ids")
        own = unpack(left.column("payload")[0].as_py())
        parts = [unpack(p) for p in right.column("payload").to_pylist()]
        parts.sort(key=lambda p: int(p["first"][0]))
        word_id = np.concatenate([p["id"] for p in parts]).astype(np.int64)
        times = np.concatenate([p["times"] for p in parts])
        codes, lengths, held = own["codes"], own["sizes"].astype(np.int64), own["held"]
        starts = np.cumsum(lengths) - lengths
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        w, c = word_id[codes], times[codes]
        before, c_before = np.roll(w, 1), np.roll(c, 1)
        # The start of a text was seen as often as its end, the word without letters.
        before[starts], c_before[starts] = START, c[starts + lengths - 1]
        single = np.log10((c + 1) / unigram)
        known = (c > 0) & (c_before > 0)
        alone = ~known
        local = np.bincount(doc[alone], np.rint(-(np.log10(mu / (c_before[alone] + mu)) + single[alone]) * STEP) / -STEP, len(lengths)).astype(float)
        payload = pack(held=held, tokens=lengths.astype(np.uint32), known=np.bincount(doc[c > 0], minlength=len(lengths)).astype(np.uint32),
                       base=np.add.reduceat(single, starts), score=local)
        rows = [(block, block % pair_shards, payload, ids[0].as_py())]
        key = before[known].astype(np.uint64) << np.uint64(32) | w[known].astype(np.uint64)
        order = np.argsort(key, kind="stable")
        key, place = key[order], doc[known][order]
        first = _runs(key)
        runs = np.diff(np.concatenate((first, [len(key)])))
        seen = np.add.reduceat((~held)[place].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        c_word, c_context = c[known][order][first], c_before[known][order][first]
        key = key[first]
        shard = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(pair_shards)
        by = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[by], np.arange(pair_shards + 1).astype(np.uint64))
        for s in np.unique(shard).astype(np.int64).tolist():
            at = by[cuts[s]:cuts[s + 1]]
            rows.append((block, s, pack(step=np.diff(key[at], prepend=np.uint64(0)), word=c_word[at].astype(np.uint32), context=c_context[at].astype(np.uint32),
                                        seen=seen[at].astype(np.uint32), runs=runs[at].astype(np.uint32), place=gather(first[at], runs[at], place)), None))
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), ids.type))],
                        names=["block", "shard", "payload", "doc_ids"])

    def looked_up(table):
        out, sent = [], []
        for block, payload, ids in zip(*(table.column(k).to_pylist() for k in ("block", "payload", "doc_ids")), strict=True):
            if ids is not None:
                out.append((block, payload, ids))
                continue
            got = unpack(payload)
            got["key"] = np.cumsum(got.pop("step"), dtype=np.uint64)
            sent.append((block, got))
        if sent:
            key = np.concatenate([g["key"] for _, g in sent])
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = _runs(key)
            total = np.add.reduceat(np.concatenate([g["seen"] for _, g in sent])[order].astype(np.int64), first)
            word, context = (np.concatenate([g[k] for _, g in sent])[order][first].astype(np.float64) for k in ("word", "context"))
            key, learnt = key[first], total > 0
            prob = quantise(np.log10((total + mu * (word + 1) / unigram) / (context + mu)))
            image = build_trie((key >> np.uint64(32)).astype(np.int64)[learnt], (key & np.uint64(0xFFFFFFFF)).astype(np.int64)[learnt],
                               prob[learnt], quantise(np.log10(mu / (context + mu)))[learnt])
            handle, path = tempfile.mkstemp(suffix=".trie")          # this task's own scratch
            try:
                with os.fdopen(handle, "wb") as f:
                    f.write(image)
                trie = Trie(path)
                for block, g in sent:
                    v_id, w_id = (g["key"] >> np.uint64(32)).astype(np.int64), (g["key"] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                    found, hit, _ = trie.look_up(v_id, w_id)
                    backed = np.rint(-(np.log10(mu / (g["context"] + mu)) + np.log10((g["word"] + 1.0) / unigram)) * STEP)
                    each = np.repeat(np.where(found, hit, backed) / -STEP, g["runs"])
                    docs_here, at = np.unique(g["place"], return_inverse=True)
                    out.append((block, pack(doc=docs_here.astype(np.uint32), sum=np.bincount(at, each).astype(np.float32)), None))
                del trie
            finally:
                os.unlink(path)
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.binary(), table.column("doc_ids").type))],
                        names=["block", "payload", "doc_ids"])

    def finished(table):
        facts, ids, sums = None, [], []
        for payload, own in zip(table.column("payload").to_pylist(), table.column("doc_ids").to_pylist(), strict=True):
            if own is None:
                sums.append(unpack(payload))
            else:
                facts, ids = unpack(payload), own
        score = facts["score"].copy()
        for s in sums:
            score[s["doc"]] += s["sum"]
        size = len(ids)
        return pa.table([pa.array(ids, table.column("doc_ids").type.value_type), pa.array(facts["held"]), pa.array(facts["tokens"].astype(np.int64)),
                         pa.array(facts["known"].astype(np.int64)), pa.array(np.full(size, n, np.int64)), pa.array(facts["base"]), pa.array(score)],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    tokens = blocks.where("shard = -1").select("block", "payload", "doc_ids")
    pairs = tokens.groupBy("block").cogroup(numbers.select("block", "payload").groupBy("block")).applyInArrow(split, wide)
    sums = pairs.groupBy("shard").applyInArrow(looked_up, f"block bigint, payload binary, doc_ids array<{id_type}>")
    return sums.groupBy("block").applyInArrow(
        finished, f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
