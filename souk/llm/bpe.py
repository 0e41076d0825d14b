"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The most frequent words of the corpus are compiled, with their ids, into a minimal acyclic
automaton (shared suffixes). Each edge carries how many words precede its branch, so the path
of a word adds up to its rank, which addresses its ids. The arrays travel as one memory-mapped
file. Words outside the lexicon are merged exactly by rank, many at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.shared import gather, map_arrays, pack_arrays, ship, shipped, slices, store, words

LEXICON_WORDS = 30_000
SLICE = 8 << 20
LONG = 48                # bytes; longer words are merged one by one with a heap
NONE = np.int32(2**31 - 1)
# White space as the vocabulary's pattern means it (Unicode White_Space).
BLANK = "\t-\r \x85\xa0  -     　"
PIECE = regex.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{BLANK}\p{{L}}\p{{N}}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [rest.get(b, chr(b)) for b in range(256)]


def read_vocabulary(path: str) -> dict[str, np.ndarray]:
    """Arrays of a vocabulary file with word ends: first ids of bytes, merges, token texts, specials."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    vocab, end = data["model"]["vocab"], data["model"]["end_of_word_suffix"]
    letters = byte_letters()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
    keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], np.int32)
    order = np.argsort(keys, kind="stable")
    specials = {t["content"]: t["id"] for t in data["added_tokens"]}
    texts = [""] * (1 + max([*vocab.values(), *specials.values()]))
    for text, i in [*vocab.items(), *specials.items()]:
        texts[i] = text
    raw = [t.encode() for t in texts]
    return {"byte": np.array([vocab[c] for c in letters], np.int32),
            "byte_end": np.array([vocab[c + end] for c in letters], np.int32),
            "pair": keys[order], "rank": order.astype(np.int32), "made": made,
            "token_bytes": np.frombuffer(b"".join(raw), np.uint8),
            "token_at": np.cumsum([0, *map(len, raw)]).astype(np.int64),
            "special_id": np.array(list(specials.values()), np.int32),
            "specials": np.frombuffer("\n".join(specials).encode(), np.uint8)}


class Merger:
    """Exact merges of words given as byte strings."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.byte, self.byte_end = np.array(arrays["byte"]), np.array(arrays["byte_end"])
        self.pair, self.rank, self.made = np.array(arrays["pair"]), np.array(arrays["rank"]), np.array(arrays["made"])

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (a >= 0) & (b >= 0), self.rank[at], NONE)

    def first_ids(self, word: bytes) -> np.ndarray:
        ids = self.byte[np.frombuffer(word, np.uint8)]
        ids[-1] = self.byte_end[word[-1]]
        return ids

    def one(self, word: bytes) -> list[int]:
        """A heap of (rank, place) over a linked list; stale entries are skipped."""
        ids = self.first_ids(word).tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        first = self.ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        current = dict(enumerate(first))
        heap = [(r, i) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)

        def rated(i):
            j = after[i] if i >= 0 else len(ids)
            if i < 0 or j >= len(ids):
                current[i] = NONE
                return
            current[i] = int(self.ranks(np.array([ids[i]], np.int32), np.array([ids[j]], np.int32))[0])
            if current[i] != NONE:
                heapq.heappush(heap, (current[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or current.get(i) != r:
                continue
            j = after[i]
            ids[i], ids[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            current[j] = NONE
            rated(before[i])
            rated(i)
        return [x for x in ids if x >= 0]

    def many(self, words: list[bytes]) -> list[np.ndarray]:
        """All words, in step: each round merges the lowest-ranked (leftmost) pair of every word."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        short = [i for i in order if 0 < len(words[i]) <= LONG]
        for i in order[::-1]:
            if len(words[i]) <= LONG:
                break
            out[i] = np.array(self.one(words[i]), np.int32)
        for at in range(0, len(short), 8192):
            part = short[at:at + 8192]
            width = len(words[part[-1]])
            ids = np.full((len(part), width + 1), -1, np.int32)
            for n, i in enumerate(part):
                ids[n, :len(words[i])] = self.first_ids(words[i])
            ranks = np.full((len(part), width + 1), NONE)
            ranks[:, :width] = self.ranks(ids[:, :-1], ids[:, 1:])
            cols, live = np.arange(width), np.arange(len(part))
            while True:
                place = ranks[live].argmin(axis=1)
                best = ranks[live, place]
                live, place, best = live[best != NONE], place[best != NONE], best[best != NONE]
                if not len(live):
                    break
                shift = cols + (cols > place[:, None])
                ids[live, :width] = np.take_along_axis(ids[live], shift, axis=1)
                ranks[live, :width] = np.take_along_axis(ranks[live], cols + (cols >= place[:, None]), axis=1)
                ids[live, place] = self.made[best]
                ranks[live, place] = self.ranks(ids[live, place], ids[live, place + 1])
                left = place > 0
                ranks[live[left], place[left] - 1] = self.ranks(ids[live[left], place[left] - 1], ids[live[left], place[left]])
            for n, i in enumerate(part):
                out[i] = ids[n][ids[n] >= 0]
        return out


def compile_lexicon(entries: dict[bytes, np.ndarray]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of the words, as sorted edges (state * 256 + byte) with target and
    the number of words passed by; plus the ids of the words in order."""
    ordered = sorted(entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple, int]] = []

    def state(lo: int, hi: int, depth: int) -> int:
        final = len(ordered[lo]) == depth
        at, edges = lo + final, []
        while at < hi:
            label, end = ordered[at][depth], at + 1
            while end < hi and ordered[end][depth] == label:
                end += 1
            edges.append((label, state(at, end, depth + 1)))
            at = end
        key = (final, tuple(edges))
        if key not in register:
            register[key] = len(states)
            states.append((final, key[1], final + sum(states[t][2] for _, t in edges)))
        return register[key]

    root = state(0, len(ordered), 0) if ordered else -1
    keys, targets, passed = [], [], []
    for s, (final, edges, _) in enumerate(states):
        skip = int(final)
        for label, t in edges:
            keys.append(s * 256 + label)
            targets.append(t)
            passed.append(skip)
            skip += states[t][2]
    sizes = [len(entries[w]) for w in ordered]
    return {"edge": np.array(keys, np.int64), "target": np.array(targets, np.int32), "passed": np.array(passed, np.int32),
            "final": np.array([s[0] for s in states], bool), "root": np.array([root], np.int32),
            "out_at": np.cumsum([0, *sizes]).astype(np.int64),
            "out": np.concatenate([entries[w] for w in ordered]).astype(np.int32) if ordered else np.zeros(0, np.int32)}


def look_up(lexicon: dict[str, np.ndarray], texts: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rank of each word (a span of ``texts``) in the lexicon, -1 if it is not there: all words walk
    the automaton in step."""
    rank = np.full(len(starts), -1, np.int64)
    if not len(lexicon["edge"]):
        return rank
    live = np.arange(len(starts))
    state, total = np.full(len(starts), lexicon["root"][0], np.int64), np.zeros(len(starts), np.int64)
    step = 0
    while len(live):
        done = sizes[live] == step
        ended = live[done]
        rank[ended] = np.where(lexicon["final"][state[ended]], total[ended], -1)
        live = live[~done]
        key = state[live] * 256 + texts[starts[live] + step]
        at = np.minimum(np.searchsorted(lexicon["edge"], key), len(lexicon["edge"]) - 1)
        there = lexicon["edge"][at] == key
        live, at = live[there], at[there]
        state[live] = lexicon["target"][at]
        total[live] += lexicon["passed"][at]
        step += 1
    return rank


def pieces(distinct: list[str], specials: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of the vocabulary's pattern in each blank-free string: (distinct words, codes, bounds).
    A special token's text is a word of its own, marked by a leading line break."""
    found: dict[str, int] = {}
    codes: list[int] = []
    cuts = re.split("(" + "|".join(map(re.escape, specials)) + ")", "\n".join(distinct)) if specials else ["\n".join(distinct)]
    for n, part in enumerate(cuts):
        if n % 2:
            codes.append(found.setdefault("\n" + part, len(found)))
            continue
        text = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
        codes.extend([-1 if w == "\n" else found.setdefault(w, len(found)) for w in PIECE.findall(text.lower())])
    flat = np.array(codes, np.int64)
    breaks = np.flatnonzero(flat < 0)
    bounds = np.concatenate(([0], breaks - np.arange(len(breaks)), [len(flat) - len(breaks)]))
    return list(found), flat[flat >= 0], bounds


def frequent_words(docs: DataFrame, specials: list[str], n: int) -> list[str]:
    """The most frequent words of up to LONG bytes of all texts, at most ``n``: those whose count reaches
    the lowest sixteenth of an octave down to which there are no more, and of the next step those of the
    lowest hashes. The driver sees histograms of the counts and of that step's hashes and these words,
    however many tasks counted them."""

    def counted(batches):
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                codes, _, distinct = words(part.column("text"), lower=False)
                if not len(distinct):
                    continue
                times = np.bincount(codes, minlength=len(distinct))
                found, of, bounds = pieces(distinct.to_pylist(), specials)
                total = np.bincount(of, np.repeat(times, np.diff(bounds)), len(found)).astype(np.int64)
                yield pa.record_batch([pa.array(found, pa.string()), pa.array(total)], names=["word", "n"])

    counts = store(docs.select("text").mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
                   .where(f"n > 0 AND NOT startswith(word, '\n') AND octet_length(word) <= {LONG}"), "words")
    step = F.floor(F.log2("n") * 16)
    least, over, held, most = None, None, 0, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        if held + r["words"] > n:
            over, most = r["step"], r["words"]
            break
        held += r["words"]
        least = r["step"]
    picked = F.lit(False) if least is None else step >= least
    if over is not None and held < n:
        # The room left is about 64 of the bins, so the last bin that fits leaves little of it empty.
        hashed = F.pmod(F.xxhash64("word"), F.lit(1 << 32))
        width = max(1, (1 << 32) * (n - held) // (64 * most))
        bins = counts.where((step == over) & (hashed < 128 * width)).groupBy(F.floor(hashed / width).alias("bin")).agg(F.count("*").alias("words"))
        end = 128
        for r in bins.orderBy("bin").collect():
            held += r["words"]
            if held > n:
                end = r["bin"]
                break
        picked = picked | ((step == over) & (hashed < end * width))
    return [r["word"] for r in counts.where(picked).collect()]


def build(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS) -> str:
    """Compile vocabulary and lexicon into one shipped file; returns its name."""
    arrays = read_vocabulary(path)
    specials = [s for s in bytes(arrays["specials"]).decode().split("\n") if s]
    top = [w.encode() for w in frequent_words(docs, specials, lexicon_words)]
    ids = Merger(arrays).many(top)
    return ship(docs.sparkSession, "lexicon", pack_arrays(arrays | compile_lexicon(dict(zip(top, ids, strict=True)))))


class Encoder:
    """Encoding of Arrow text columns by a mapped model file."""

    def __init__(self, path: str):
        self.model = map_arrays(path)
        self.merger = Merger(self.model)
        names = [s for s in bytes(self.model["specials"]).decode().split("\n") if s]
        self.specials = dict(zip(names, self.model["special_id"].tolist(), strict=True))
        spaced = [bytes(self.model["token_bytes"][a:b]) + b" " for a, b in zip(self.model["token_at"][:-1], self.model["token_at"][1:], strict=True)]
        self.tokens = pa.array(spaced, pa.large_binary())

    def word_ids(self, found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, sizes, ids) of the ids of each word."""
        raw = [w.encode() for w in found]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(sizes) - sizes
        rank = look_up(self.model, np.frombuffer(b"".join(raw), np.uint8), starts, sizes)
        known = rank >= 0
        at = np.zeros(len(raw), np.int64)
        size = np.zeros(len(raw), np.int64)
        at[known] = self.model["out_at"][rank[known]]
        size[known] = self.model["out_at"][rank[known] + 1] - at[known]
        values, end = [np.asarray(self.model["out"])], len(self.model["out"])
        new = np.flatnonzero(~known)
        special = [i for i in new.tolist() if raw[i][:1] == b"\n"]
        merged = self.merger.many([raw[i] if raw[i][:1] != b"\n" else b"" for i in new.tolist()])
        for i in special:
            merged[int(np.searchsorted(new, i))] = np.array([self.specials[found[i][1:]]], np.int32)
        if merged:
            size[new] = np.fromiter(map(len, merged), np.int64, len(merged))
            at[new] = end + np.cumsum(size[new]) - size[new]
            values.append(np.concatenate(merged))
        return at, size, np.concatenate(values)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): row i of the column has ``ids[bounds[i]:bounds[i+1]]``."""
        codes, bounds, distinct = words(column, lower=False)
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        found, of, spans = pieces(distinct.to_pylist(), list(self.specials))
        at, size, values = self.word_ids(found)
        flat = gather(at[of], size[of], values)                       # ids of the distinct strings
        ends = np.concatenate(([0], np.cumsum(size[of])))[spans]
        ids = gather(ends[:-1][codes], np.diff(ends)[codes], flat).astype(np.uint32)
        return ids, np.concatenate(([0], np.cumsum(np.diff(ends)[codes])))[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Texts of the id runs: the token texts, joined by blanks."""
        taken = self.tokens.take(pa.array(ids.astype(np.int64)))
        at = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset:taken.offset + len(taken) + 1][bounds] if len(ids) else bounds * 0
        text = taken.buffers()[2]
        view = memoryview(text) if text is not None else memoryview(b"")
        return [bytes(view[a:max(a, b - 1)]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(shipped(name))


def encode(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS, with_ids: bool = True, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256 (of the ids as little-endian
    32-bit integers, of the decoded text in UTF-8), and, if asked for, ids and decoded.

    Null and empty texts have no ids and decode to the empty text. Repeated rows give repeated
    results. Other columns are not read. ``path``: a BPE vocabulary file with word ends.
    """
    model = build(docs, path, lexicon_words)

    def encoded(batches):
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                own = encoder(model)
                ids, bounds = own.encode(part.column("text"))
                texts = own.decode(ids, bounds)
                raw, at = memoryview(ids.tobytes()), (4 * bounds).tolist()
                columns = [part.column("doc_id"), pa.array(np.diff(bounds)),
                           pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string()),
                           pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))))
                if with_text:
                    columns.append(pa.array([t.decode() for t in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    own = docs.select("doc_id", "text")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["decoded"] * with_text]
    schema = own.select("doc_id", F.lit(0).cast("bigint").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256"),
                        *[F.array(F.lit(0)).alias("ids")] * with_ids, *[F.lit("").alias("decoded")] * with_text).schema
    return own.mapInArrow(encoded, schema)
