"""Conversation structure repair: a grammar-compressed min-plus program over role and fault sequences.

Every row of a conversation is one of nine symbols (its role's initial, whether it must go, whether
it is truncated). Editing a sequence into ``(s?(ua)+)?`` is a shortest path through the four states of
that pattern, so a symbol is a 4 x 4 min-plus matrix whose cells carry a cost and the edits that reach
it. Re-Pair finds the pairs of symbols that occur most often in all conversations; each rule's matrix
is the product of its two parts, made once, bottom-up, and used wherever the pair occurs.

Conversations are not gathered by a key that may be hot: rows are sorted by ranges of (conv_id, turn,
...), which split a long conversation, and cut into pieces of bounded size. Only conversations that
lie in several pieces meet again, piece by piece in order, through four running states; this is also
what the digest of the whole repaired conversation needs, which can only be taken in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.shared import partitions, store

BLANKS = " \t\n\x0b\f\r"
PIECE_ROWS, PIECE_BYTES = 1024, 1 << 18
RULES, ROUNDS, RULE_ROWS, LEAST_SHARE = 256, 12, 256, 1e-4
MEMO = 1 << 16                   # sequences whose repair a task remembers
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: States: nothing yet, after s, after u, after a. Roles that each state accepts, with the next state.
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
CLOSE = [(0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, "")]     # to the end of the pattern
FIRST_RULE = 0xE000              # rules are named by private code points


# --- the algebra: a cell is (cost, edits), a matrix 4 x 4 of cells or None -----------------------

def inserted(state: int) -> int:
    """The state after one inserted row: user, or assistant after user."""
    return 3 if state == 2 else 2


def symbol_matrix(symbol: str) -> list[list[tuple[int, str] | None]]:
    """Inserts before the row, then its own edit. ``D`` must go; upper case is truncated."""
    out: list[list] = [[None] * 4 for _ in range(4)]

    def offer(i, j, cell):
        if out[i][j] is None or cell < out[i][j]:
            out[i][j] = cell

    extra = symbol.isupper()
    for i in range(4):
        at = i
        for inserts in range(3):
            cost, edits = INSERT * inserts, "I" * inserts
            offer(i, at, (cost + DELETE, edits + "D"))
            if symbol != "D":
                for role, to in NEXT[at].items():
                    if role == symbol.lower():
                        offer(i, to, (cost + KEEP + extra, edits + "K"))
                    if role != "s":
                        offer(i, to, (cost + REROLE + extra, edits + "R"))
            at = inserted(at)
    return out


def product(a: list, b: list) -> list:
    """Min-plus product; equal costs go to the ASCII-least edits. Edits of the same rows end in a row's
    own edit, so none is the beginning of another and the least of the parts gives the least whole."""
    out = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for k in range(4):
            found = [(a[i][j][0] + b[j][k][0], a[i][j][1] + b[j][k][1]) for j in range(4) if a[i][j] and b[j][k]]
            out[i][k] = min(found, default=None)
    return out


def matrices(rules: list[str]) -> dict[str, list]:
    """A matrix per symbol and per rule (a pair of earlier names), bottom-up."""
    out = {s: symbol_matrix(s) for s in "DsuaxSUAX"}
    for n, (left, right) in enumerate(rules):
        out[chr(FIRST_RULE + n)] = product(out[left], out[right])
    return out


def compress(rules: list[str], text: str) -> str:
    for n, pair in enumerate(rules):
        text = text.replace(pair, chr(FIRST_RULE + n))
    return text


def advance(vector: list, matrix: list) -> list:
    """One more name. A state is (cost, rank of its edits among the states', rope of its edits, origin):
    ranks decide ties, so no rope is ever read; a rope is (rope before, edits) and shares its past."""
    best: list = [None] * 4
    for i, v in enumerate(vector):
        if v is not None:
            for j, cell in enumerate(matrix[i]):
                if cell is not None:
                    key = (v[0] + cell[0], v[1], cell[1])
                    if best[j] is None or key < best[j][0]:
                        best[j] = (key, v)
    ranks = {k: n for n, k in enumerate(sorted({b[0][1:] for b in best if b}))}
    return [b and (b[0][0], ranks[b[0][1:]], (b[1][2], b[0][2]), b[1][3]) for b in best]


def edits_of(rope: tuple | None) -> str:
    parts = []
    while rope:
        rope, edits = rope
        parts.append(edits)
    return "".join(reversed(parts))


def replay(edits: str, symbols: str, roles: list[str], texts: list[str], state: int) -> list[str]:
    """The repaired rows, as ``role:text``. The edits alone tell the states and so the roles."""
    lines, row, kept = [], 0, 0
    for e in edits:
        if e == "I":
            lines.append("assistant:" if state == 2 else "user:")
            state = inserted(state)
            continue
        symbol, row = symbols[row], row + 1
        if symbol == "D":
            continue
        role, text, kept = roles[kept], texts[kept], kept + 1
        if e == "K":
            state = NEXT[state][symbol.lower()]
            lines.append(f"{role}:{text}")
        elif e == "R":
            lines.append(("assistant:" if state == 2 else "user:") + text)
            state = inserted(state)
    return lines


class Running:
    """A conversation taken piece by piece: four states, each with the digest of its rows so far."""

    def __init__(self, conv_id):
        self.conv_id, self.vector = conv_id, [(0, 0, None, None), None, None, None]
        self.digests = [(hashlib.sha256(), False)] + [None] * 3
        self.edits = [[], None, None, None]
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.least = self.most = self.initial = None
        self.whole = True       # no piece has been passed on

    def count(self, piece: dict) -> None:
        for k in self.counts:
            self.counts[k] += piece[k]
        if self.initial and piece["first_initial"]:
            self.counts["illegal"] += illegal(self.initial, piece["first_initial"])
        if piece["turns"]:
            self.counts["turns"] -= piece["first_turn"] == self.most
            self.least, self.most = piece["first_turn"] if self.least is None else self.least, piece["last_turn"]
        self.initial = piece["last_initial"] or self.initial

    def _after(self, state: int, edits: str, piece: dict):
        digest, some = self.digests[state]
        lines = replay(edits, piece["symbols"], piece["roles"], piece["texts"], state)
        digest = digest.copy()
        if lines:
            digest.update((("\n" if some else "") + "\n".join(lines)).encode("utf-8", "surrogatepass"))
        return digest, some or bool(lines)

    def walk(self, piece: dict, rules: list[str], table: dict) -> None:
        vector = [v and (v[0], v[1], None, i) for i, v in enumerate(self.vector)]
        for name in compress(rules, piece["symbols"]):
            vector = advance(vector, table[name])
        self.vector = vector

    def pass_on(self, piece: dict) -> None:
        """After ``walk``: keep what each state has, for the next piece."""
        digests, edits = [None] * 4, [None] * 4
        for j, v in enumerate(self.vector):
            if v is not None:
                own = edits_of(v[2])
                digests[j], edits[j] = self._after(v[3], own, piece), self.edits[v[3]] + [own]
        self.digests, self.edits, self.whole = digests, edits, False

    def close(self, piece: dict) -> dict:
        """After the last piece: the cheapest end."""
        cost, _, j = min((v[0] + CLOSE[j][0], v[1], j) for j, v in enumerate(self.vector) if v is not None)
        v = self.vector[j]
        return self.result(piece, cost, v[3], edits_of(v[2]) + CLOSE[j][1])

    def result(self, piece: dict, cost: int, state: int, own: str) -> dict:
        digest, _ = self._after(state, own, piece)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.counts["turns"]
        return {"conv_id": self.conv_id, "gaps": gaps, **{k: self.counts[k] for k in ("blank", "duplicate", "truncated", "illegal")},
                "cost": cost, "audit": "".join(self.edits[state]) + own, "repaired_sha256": digest.hexdigest()}


def illegal(before: str, after: str) -> bool:
    return before + after not in ("su", "ua", "au")


# --- rows ---------------------------------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, alive, role, text, n): the damaged rows, equal ones counted. A conversation with
    dropped rows also has one row that is not alive. Null role and text, and a null in the hashed key,
    are one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), fate.alias("fate"))
    alive = F.col("fate") != 0
    return (rows.select(
        "conv_id", F.when(alive, F.col("turn")).alias("turn"), alive.alias("alive"),
        F.when(~alive, "").when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(~alive | (F.col("fate") == 1), "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(~alive, 0).when(F.col("fate") == 3, 2).otherwise(1).cast("long").alias("copies"))
        .groupBy("conv_id", "turn", "alive", "role", "text").agg(F.sum("copies").alias("n")))


def intact(conversations: DataFrame) -> DataFrame:
    """The rows of ``damage`` for conversations taken as they are."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return (conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.lit(True).alias("alive"), spaced("role").alias("role"), spaced("text").alias("text"))
            .groupBy("conv_id", "turn", "alive", "role", "text").agg(F.count("*").alias("n")))


def with_symbols(rows: DataFrame) -> DataFrame:
    """Adds initial, symbol and the faults (blank, duplicate, truncated) of each row's n copies.

    A row is a duplicate if its role and text came at an earlier turn, which one aggregate per
    (conversation, role, text) tells; only texts found at several turns are joined back.
    """
    told = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.octet_length("role").cast("string"), "role", "text")
    keyed = rows.withColumn("key", F.sha2(told, 256))
    first = (keyed.where("alive").groupBy(F.col("key").alias("of")).agg(F.min("turn").alias("first_turn"), F.bool_or(F.col("turn").isNull()).alias("untimed"), F.count("*").alias("times"))
             .where("times > 1").drop("times"))
    later: Column = F.coalesce(F.col("turn").isNotNull() & (F.col("untimed") | (F.col("turn") > F.col("first_turn"))), F.lit(False))
    trimmed = F.rtrim("text", F.lit(BLANKS))
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("x")
    blank, cut = trimmed == "", ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")
    n = F.col("n")
    return (keyed.join(first, F.col("key") == F.col("of"), "left").withColumns({"initial": initial, "is_blank": blank, "cut": cut, "later": later})
            .select("conv_id", "turn", "alive", "role", "text", "n", "initial",
                    F.when(F.col("is_blank") | F.col("later"), "D").when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial")).alias("symbol"),
                    F.when(F.col("is_blank"), n).otherwise(0).alias("blank"),
                    F.when(F.col("is_blank"), 0).when(F.col("later"), n).otherwise(n - 1).alias("duplicate"),
                    (~F.col("is_blank") & ~F.col("later") & F.col("cut")).cast("long").alias("truncated")))


def conv_type_of(rows: DataFrame) -> str:
    return f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, "


PIECE = ("part int, no long, edge boolean, symbols string, roles array<string>, texts array<string>, first_initial string, last_initial string, "
         "first_turn long, last_turn long, turns long, illegal long, blank long, duplicate long, truncated long")


def pieces(rows: DataFrame) -> DataFrame:
    """Conversations in order, cut into pieces of bounded size; ``edge`` marks those of conversations
    that may lie in several (the first and last of a range, and long ones)."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("alive"), F.col("role"), F.col("text")]
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    schema = conv_type_of(rows) + PIECE
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"part": pa.int32(), "edge": pa.bool_(), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()),
             **dict.fromkeys(("symbols", "first_initial", "last_initial"), pa.string())}

    def cut(batches):
        part, done, size = TaskContext.get().partitionId(), [], 0
        conv_type = None
        piece, weight, number, split, begun = None, 0, 0, False, False

        def flush(edge):
            nonlocal piece, number
            piece |= {"part": part, "no": number, "edge": edge, "symbols": "".join(piece["symbols"])}
            done.append(piece)
            piece, number = None, number + 1

        def fresh(conv_id):
            return {"conv_id": conv_id, "symbols": [], "roles": [], "texts": [], **dict.fromkeys(("first_initial", "last_initial", "first_turn", "last_turn")),
                    **dict.fromkeys(("turns", "illegal", "blank", "duplicate", "truncated"), 0)}

        def batch_of():
            nonlocal done, size
            out = pa.record_batch([pa.array([p[n] for p in done], conv_type if n == "conv_id" else types.get(n, pa.int64())) for n in names], names=names)
            done, size = [], 0
            return out

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for conv_id, turn, alive, role, text, n, initial, symbol, blank, duplicate, truncated in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if piece is not None and piece["conv_id"] != conv_id:
                    flush(split or not begun)
                    split, begun = False, True
                if piece is None:
                    piece, weight = fresh(conv_id), 0
                if not alive:
                    continue
                while n:
                    if weight >= PIECE_BYTES or len(piece["symbols"]) >= PIECE_ROWS:
                        split = True
                        flush(True)
                        piece, weight = fresh(conv_id), 0
                    take = min(n, PIECE_ROWS - len(piece["symbols"]))
                    if piece["last_initial"]:
                        piece["illegal"] += illegal(piece["last_initial"], initial)
                    piece["illegal"] += (take - 1) * illegal(initial, initial)
                    piece["first_initial"], piece["last_initial"] = piece["first_initial"] or initial, initial
                    piece["symbols"].append(symbol)
                    piece["symbols"].extend("D" * (take - 1))
                    if symbol != "D":
                        piece["roles"].append(role)
                        piece["texts"].append(text)
                        weight, size = weight + len(text) + len(role), size + len(text)
                    if turn is not None and turn != piece["last_turn"]:
                        piece["first_turn"] = turn if piece["first_turn"] is None else piece["first_turn"]
                        piece["last_turn"], piece["turns"] = turn, piece["turns"] + 1
                    piece["blank"], piece["duplicate"], piece["truncated"] = piece["blank"] + blank, piece["duplicate"] + duplicate, piece["truncated"] + truncated
                    n, symbol, blank, duplicate, truncated = n - take, "D", 0, 0, 0
                if len(done) >= 1000 or size > 8 << 20:
                    yield batch_of()
        if piece is not None:
            flush(True)
        if done:
            yield batch_of()

    columns = ["conv_id", "turn", "alive", "role", "text", "n", "initial", "symbol", "blank", "duplicate", "truncated"]
    return ranged.select(*columns).mapInArrow(cut, schema)


# --- the grammar --------------------------------------------------------------------------------

def pair_counts(sequences: DataFrame, rules: list[str]) -> DataFrame:
    """(pair, n): how often names stand side by side in all sequences under the rules so far."""
    def counted(batches):
        for batch in batches:
            text = compress(rules, "\n".join(batch.column(0).to_pylist()))
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
            weight = batch.column(1).to_numpy()[np.cumsum(codes == 10)]
            inside = (codes[:-1] != 10) & (codes[1:] != 10)
            pairs, at = np.unique((codes[:-1] << 32 | codes[1:])[inside], return_inverse=True)
            n = np.bincount(at, weight[:-1][inside], len(pairs)).astype(np.int64)
            yield pa.record_batch([pa.array([chr(p >> 32) + chr(p & 0xFFFFFFFF) for p in pairs.tolist()], pa.string()), pa.array(n)], names=["pair", "n"])

    return sequences.mapInArrow(counted, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def grammar(sequences: DataFrame, most: int = RULES, rounds: int = ROUNDS) -> list[str]:
    """Re-Pair over ``sequences`` (symbols, n: how often each occurs): the rules, as pairs of names.

    Pairs are counted over all sequences, in Spark; a round takes the most frequent ones that share
    no name, which do not touch each other's counts. Rules are bounded in number and length, so the
    model is bounded; a shorter grammar changes the time, never a result. Each round's counts are at
    most the square of the names and the driver takes the first few.
    """
    rules: list[str] = []
    rows: dict[str, int] = dict.fromkeys("DsuaxSUAX", 1)
    total = None
    for _ in range(rounds):
        top = pair_counts(sequences, rules).orderBy(F.col("n").desc(), "pair").limit(2 * most).collect()
        if total is None:
            total = sum(r["n"] for r in top)
        used: set[str] = set()
        found = False
        for r in top:
            left, right = r["pair"]
            if r["n"] < max(2, LEAST_SHARE * total) or len(rules) >= most:
                break
            if used & {left, right} or rows[left] + rows[right] > RULE_ROWS:
                continue
            used |= {left, right}
            rows[chr(FIRST_RULE + len(rules))] = rows[left] + rows[right]
            rules.append(left + right)
            found = True
        if not found:
            break
    return rules


# --- the operator -------------------------------------------------------------------------------

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def finished(cut: DataFrame, rules: list[str]) -> DataFrame:
    """The repair of each conversation whose pieces lie in order inside one partition."""
    schema = conv_type_of(cut) + RESULT
    names = [x.split()[0] for x in schema.split(", ")]

    def ends(batches):
        table, memo = matrices(rules), {}

        def end(state, piece):
            state.count(piece)
            if state.whole and piece["symbols"] in memo:
                cost, audit = memo[piece["symbols"]]
                return state.result(piece, cost, 0, audit)
            state.walk(piece, rules, table)
            out = state.close(piece)
            if state.whole:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[piece["symbols"]] = (out["cost"], out["audit"])
            return out

        def results(rows: Iterator[dict]):
            state, held = None, None
            for piece in rows:
                if state is not None and state.conv_id == piece["conv_id"]:
                    state.count(held)
                    state.walk(held, rules, table)
                    state.pass_on(held)
                else:
                    if state is not None:
                        yield end(state, held)
                    state = Running(piece["conv_id"])
                held = piece
            if state is not None:
                yield end(state, held)

        conv_type = None

        def rows():
            nonlocal conv_type
            for batch in batches:
                conv_type = batch.schema.field("conv_id").type
                for i in range(0, batch.num_rows, 64):
                    yield from batch.slice(i, 64).to_pylist()

        def batch_of(done):
            types = [conv_type] + [pa.int64()] * 6 + [pa.string()] * 2
            return pa.record_batch([pa.array([d[n] for d in done], t) for n, t in zip(names, types, strict=True)], names=names)

        done = []
        for r in results(rows()):
            done.append(r)
            if len(done) >= 5000:
                yield batch_of(done)
                done = []
        if done:
            yield batch_of(done)

    return cut.mapInArrow(ends, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """Faults, cheapest repair and digest of each conversation in rows (conv_id, turn, alive, role, text, n)."""
    spark = rows.sparkSession
    cut = store(pieces(with_symbols(store(rows, "turns"))), "pieces")
    rules = grammar(store(cut.groupBy("symbols").agg(F.count("*").alias("n")), "sequences"))
    split = cut.where("edge").repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "part", "no")
    return finished(cut.where("NOT edge"), rules).unionByName(finished(split, rules))


def repair(conversations: DataFrame) -> DataFrame:
    """The conversations as they are; see ``damaged_and_repaired`` for rows and columns."""
    return repaired(intact(conversations))


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """Per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 after damage.

    Null conv_ids are one conversation. Null role and text are one space (such a role is never kept,
    nor any whose first letter is not s, u or a; an empty role counts the same). Rows of one turn come
    in the order of role, then text. A repeated row is a duplicate. A conversation that lost all its
    rows has zeros, an empty audit and the digest of an empty string; an empty table gives no rows.
    Texts are taken whole. Only conv_id, turn, role and text are read.
    """
    return repaired(damage(conversations))
