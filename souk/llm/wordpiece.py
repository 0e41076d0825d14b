"""Token counts by a linear longest-match automaton.

The vocabulary is a trie of byte pieces. A state's failure link is where matching goes on after
the greedy pieces that its text must give off, and ``popped`` is how many those are, so a word's
number of greedy longest-match pieces comes from one pass over its bytes, without any piece.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.bpe import byte_letters
from souk.llm.shared import map_arrays, pack_arrays, ship, shipped, slices, words


def read_pieces(path: str) -> list[bytes]:
    """The byte pieces of a byte-level vocabulary file (special tokens left out)."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"] for t in data["added_tokens"]}
    value = {c: b for b, c in enumerate(byte_letters())}
    return [bytes(value[c] for c in t) for t in data["model"]["vocab"] if t not in special]


def compile_automaton(vocabulary: list[bytes]) -> dict[str, np.ndarray]:
    """Sorted edges (state * 256 + byte), failure links (-1: none) and popped counts; state 0 is the root."""
    children: list[dict[int, int]] = [{}]
    parent, label, whole = [-1], [0], [False]
    for piece in vocabulary:
        s = 0
        for b in piece:
            if b not in children[s]:
                children[s][b] = len(children)
                children.append({})
                parent.append(s)
                label.append(b)
                whole.append(False)
            s = children[s][b]
        whole[s] = bool(piece)
    fail, popped = [-1] * len(children), [0] * len(children)
    level = [0]
    while level:
        level = [t for s in level for t in children[s].values()]
        for t in level:
            if whole[t]:
                fail[t], popped[t] = 0, 1
                continue
            z, n = fail[parent[t]], popped[parent[t]]
            while z >= 0 and label[t] not in children[z]:
                n += popped[z]
                z = fail[z]
            if z >= 0:
                fail[t], popped[t] = children[z][label[t]], n
    edges = sorted((s * 256 + b, t) for s, c in enumerate(children) for b, t in c.items())
    return {"edge": np.array([e for e, _ in edges], np.int64), "target": np.array([t for _, t in edges], np.int32),
            "fail": np.array(fail, np.int32), "popped": np.array(popped, np.int32)}


def count_pieces(model: dict[str, np.ndarray], texts: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Pieces of each word (a span of bytes); a word that cannot be cut into pieces counts as one."""
    edge, target, fail, popped = (model[k] for k in ("edge", "target", "fail", "popped"))
    if not len(edge):
        return np.ones(len(starts), np.int64)        # an empty vocabulary cuts no word
    state, total, broken = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), np.zeros(len(starts), bool)
    live, step = np.flatnonzero(sizes > 0), 0
    while len(live):
        todo = live
        byte = texts[starts[todo] + step].astype(np.int64)
        while len(todo):
            key = state[todo] * 256 + byte
            at = np.minimum(np.searchsorted(edge, key), len(edge) - 1)
            there = edge[at] == key
            state[todo[there]] = target[at[there]]
            todo, byte = todo[~there], byte[~there]
            total[todo] += popped[state[todo]]
            state[todo] = fail[state[todo]]
            lost = state[todo] < 0
            broken[todo[lost]] = True
            todo, byte = todo[~lost], byte[~lost]
        step += 1
        live = live[(sizes[live] > step) & ~broken[live]]
    rest = np.flatnonzero((state > 0) & ~broken)
    while len(rest):
        total[rest] += popped[state[rest]]
        state[rest] = fail[state[rest]]
        broken[rest[state[rest] < 0]] = True
        rest = rest[state[rest] > 0]
    return np.where(broken, 1, total)


@lru_cache(maxsize=2)
def automaton(name: str) -> dict[str, np.ndarray]:
    return {k: np.asarray(v) for k, v in map_arrays(shipped(name)).items()}


def count_tokens(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Per document: doc_id, n_words and n_tokens, the greedy longest-match pieces of all its words,
    each read with one blank before it. Null and empty texts: 0 and 0. Repeated rows give repeated
    results. Other columns are not read. The vocabulary is bounded and travels as one mapped file."""
    model = ship(docs.sparkSession, "pieces", pack_arrays(compile_automaton(vocabulary)))

    def counted(batches):
        for batch in batches:
            for part in slices(batch):
                codes, bounds, distinct = words(part.column("text"), lower=False)
                raw = [b" " + w.encode() for w in distinct.to_pylist()]
                sizes = np.fromiter(map(len, raw), np.int64, len(raw))
                each = count_pieces(automaton(model), np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes)
                total = np.concatenate(([0], np.cumsum(each[codes])))[bounds]
                yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(np.diff(total).astype(np.int64))],
                                      names=["doc_id", "n_words", "n_tokens"])

    own = docs.select("doc_id", "text")
    schema = own.select("doc_id").withColumns({"n_words": F.lit(0).cast("bigint"), "n_tokens": F.lit(0).cast("bigint")}).schema
    return own.mapInArrow(counted, schema)
