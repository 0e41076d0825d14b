"""Personal data by weak supervision.

The base patterns give spans that always stay. Wider patterns give candidates; regex, range,
gazetteer, context and boundary labelers vote on every candidate and base span (1, 0, or -1).
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler
is; its posteriors train a logistic span classifier, which decides which candidates are added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.shared import slices, store

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The same spans in linear time: possessive repeats from the head of a run, and an e-mail address
#: from its @, whose local part ``matches`` finds.
SCAN = BASE | {
    "email": re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++"),
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
WIDER = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\bat\b) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\bdot\b) ?[A-Za-z0-9-]++)+"),
    "ip": re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9.])[0-9]{4}([./–]|\x20{2})[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])"),
    "phone": re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![\w-])"),
}
#: Texts without any of these have neither base spans nor candidates.
HINT = r"[0-9]|@|\(dot\)|\[dot\]|\bdot\b|[A-Fa-f]:[A-Fa-f]"
DOMAINS = frozenset("com org net edu gov io info biz de fr es it uk eu us ca au nl ch at".split())
COUNTRIES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
             "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91")
NETWORKS = ("2", "3", "fc", "fd", "fe8", "fe9", "fea", "feb", "ff")      # first digits of assigned IPv6 networks
ISSUERS = ("4", "50", "51", "52", "53", "54", "55", "56", "57", "58", "2", "34", "37", "35", "6")
CUES = {"email": re.compile(r"mail|contact|write|reach|escrib|schreib|contacte", re.I), "ip": re.compile(r"\bip\b|host|server|address|addr|client", re.I),
        "card": re.compile(r"card|visa|master|credit|payment|karte|tarjeta|carte", re.I), "phone": re.compile(r"phone|call|tel|fax|mobile|dial|ruf|llam|appel", re.I)}
AGAINST = re.compile(r"version|isbn|order|invoice|serial|sku|release|build|chapter|section|\bno\.", re.I)
WINDOW = 40             # code points before and after a span that its labelers see
LABELERS = ("regex", "range", "gazetteer", "context", "boundary")
FEATURES = 24
TRAIN_SPANS = 20_000     # at most so many spans train the classifier


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: str, text: str) -> bool:
    """The check that a match of a base pattern must pass."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in text.split(".")))
    digits = _digits(text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def told(kind: str, left: str, right: str) -> int:
    """The context labeler: 1 if the nearest telling word before the span, or else the first after it, is
    one of the kind's cues, -1 if it speaks against all kinds, 0 if there is none."""
    last = [max((m.end() for m in words.finditer(left)), default=-1) for words in (CUES[kind], AGAINST)]
    if max(last) >= 0:
        return 1 if last[0] >= last[1] else -1
    first = [m.start() if (m := words.search(right)) else len(right) for words in (CUES[kind], AGAINST)]
    return 0 if min(first) == len(right) else 1 if first[0] <= first[1] else -1


def votes(kind: str, text: str, left: str, right: str, base: int) -> list[int]:
    """The labelers' votes on a span. base: 1 a base span, -1 a base match that fails its check, 0 other."""
    digits = _digits(text)
    if kind == "email":
        labels = re.split(r"@|\.| ?(?:\(at\)|\[at\]|\bat\b|\(dot\)|\[dot\]|\bdot\b) ?", text)
        ranged, known = all(0 < len(x) <= 63 for x in labels) and labels[-1].isalpha(), labels[-1].lower() in DOMAINS
    elif kind == "ip":
        if ":" in text:         # eight pairs of digits are a hardware address or a key's digest
            groups = text.lower().split(":")
            ranged, known = any(len(g) > 2 for g in groups), len(groups[0]) == 4 and groups[0].startswith(NETWORKS)
        else:
            ranged, known = valid(kind, text), not text.startswith(("0.", "255."))
    elif kind == "card":
        ranged, known = 13 <= len(digits) <= 19 and luhn(digits), digits.startswith(ISSUERS)
    else:
        ranged, known = 10 <= len(digits) <= 13, digits.startswith(COUNTRIES) if text.startswith("+") else digits[:1] in "23456789"
    context = told(kind, left, right)
    joined = left[-1:].isalnum() or right[:1].isalnum() or left[-1:] in "-_/=\"'" and left != "" or right[:1] in "_/\"'" and right != ""
    return [base, 1 if ranged else -1, 1 if known else -1, context, -1 if joined else 1]


def features(kind: str, text: str, left: str, right: str, given: list[int]) -> list[float]:
    """What the span classifier sees: the kind, the span's shape, its neighbours, and the votes."""
    n = max(len(text), 1)
    shape = [1.0, *[float(kind == k) for k in KINDS], len(text) / 32, len(_digits(text)) / n, sum(c.isalpha() for c in text) / n,
             text.count(" ") / n, text.count(".") / n, text.count("-") / n, text.count(":") / n, float(text[:1] == "+"), float("@" in text),
             float(left[-1:].isspace() or left == ""), float(right[:1].isspace() or right == ""), float(right[:1] in ".,;!?" and right != ""),
             float(left[-1:].isdigit() or right[:1].isdigit()), float("=" in left[-6:])]
    return shape + [float(v) for v in given]


def matches(kind: str, text: str):
    """(start, end) of the base pattern's matches: leftmost, not overlapping."""
    if kind != "email":
        yield from (m.span() for m in SCAN[kind].finditer(text))
        return
    last, at = 0, text.find("@")
    while at >= 0:
        start, m = at, SCAN[kind].match(text, at)
        while m and start > last and text[start - 1] in LOCAL:
            start -= 1
        if m and start < at:
            last = m.end()
            yield start, last
        at = text.find("@", at + 1)


def apart(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[bool]:
    """Whether each of ``spans`` overlaps none of ``taken``."""
    starts = sorted(taken)
    reach = list(accumulate((b for _, b in starts), max))
    heads = [a for a, _ in starts]
    return [not (i := bisect_left(heads, b)) or reach[i - 1] <= a for a, b in spans]


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple]]:
    """(base spans, judged spans) of a text: (kind, start, end), and (kind, start, end, base, votes, features).
    Judged are base spans, base matches that fail, and wider matches apart from all base spans."""
    spans, judged = [], []
    for k, kind in enumerate(KINDS):
        for a, b in matches(kind, text):
            good = valid(kind, text[a:b])
            if good:
                spans.append((k, a, b))
            elif kind == "card" and len(_digits(text[a:b])) < 13 or kind == "phone" and len(_digits(text[a:b])) < 9:
                continue            # too short to be taken for one
            judged.append((k, a, b, 1 if good else -1))
    wider = [(k, *m.span(), 0) for k, kind in enumerate(KINDS) for m in WIDER[kind].finditer(text)]
    free = apart([s[1:3] for s in wider], [(a, b) for _, a, b in spans])
    judged += [s for s, alone in zip(wider, free, strict=True) if alone]
    out = []
    for k, a, b, base in judged:
        left, right = text[max(0, a - WINDOW):a], text[b:b + WINDOW]
        given = votes(KINDS[k], text[a:b], left, right, base)
        out.append((k, a, b, base, "".join("-0+"[v + 1] for v in given), features(KINDS[k], text[a:b], left, right, given)))
    return spans, out


SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
JUDGED = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.int32()), ("votes", pa.string()),
                    ("x", pa.list_(pa.float64()))])


def with_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns base and judged (arrays of spans)."""
    schema = docs.withColumns({
        "base": F.expr("CAST(array() AS array<struct<kind:int,start:bigint,end:bigint>>)"),
        "judged": F.expr("CAST(array() AS array<struct<kind:int,start:bigint,end:bigint,base:int,votes:string,x:array<double>>>)")}).schema

    def found(batches):
        for batch in batches:
            for part in slices(batch):
                text = pc.fill_null(part.column("text"), "")
                hinted = pc.match_substring_regex(text, HINT).to_numpy(zero_copy_only=False)
                base, judged = [[] for _ in hinted], [[] for _ in hinted]
                for i in np.flatnonzero(hinted).tolist():
                    base[i], judged[i] = find(text[i].as_py())
                yield pa.record_batch([*part.columns, pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in b] for b in base], pa.list_(SPAN)),
                                       pa.array([[dict(zip(("kind", "start", "end", "base", "votes", "x"), s, strict=True)) for s in j] for j in judged], pa.list_(JUDGED))],
                                      names=schema.names)

    return docs.mapInArrow(found, schema)


def expectation_maximisation(patterns: dict[tuple[int, str], int], rounds: int = 50):
    """(prior by kind, P(vote | class) by labeler, posterior by pattern). The classes start from the
    majority of votes; every estimate is smoothed by one observation."""
    keys = sorted(patterns)
    counts = np.array([patterns[k] for k in keys], float)
    kind = np.array([k for k, _ in keys], int)
    vote = np.array([["-0+".index(c) for c in v] for _, v in keys], int).reshape(len(keys), -1)
    posterior = 1 / (1 + np.exp(-1.5 * (vote - 1).sum(axis=1)))
    for _ in range(rounds):
        mass = np.stack([counts * (1 - posterior), counts * posterior])
        prior = np.array([[1 + m[kind == k].sum() for k in range(len(KINDS))] for m in mass])
        prior /= prior.sum(axis=0)
        given = np.array([[[1 + m[vote[:, j] == v].sum() for v in range(3)] for j in range(vote.shape[1])] for m in mass])
        given /= given.sum(axis=2, keepdims=True)
        logs = np.log(prior[:, kind]) + sum(np.log(given[:, j, :])[:, vote[:, j]] for j in range(vote.shape[1]))
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -30, 30)))
    return prior, given, dict(zip(keys, posterior.tolist(), strict=True))


def train_classifier(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Logistic regression on soft labels; ``weight`` is how often each row stands."""
    weight = np.ones(len(y)) if weight is None else weight
    w, speed = np.zeros(x.shape[1]), np.ones(x.shape[1]) * 1e-3
    for _ in range(rounds):
        g = x.T @ (weight * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y)) / weight.sum() + decay * w
        speed += g * g
        w -= rate * g / np.sqrt(speed)
    return w


def fit(candidates: DataFrame, train_spans: int = TRAIN_SPANS) -> np.ndarray | None:
    """The classifier's weights. EM sees the counts of every vote pattern in the corpus (at most
    kinds x 3**labelers rows); the classifier fits on about nine tenths of ``train_spans`` spans: those
    whose hash (of doc_id, the spans of its text and the place) falls under that share. Equal spans of
    repeated rows share a hash, so they are one row with a weight, and reruns agree. None without any span."""
    own_id = "doc_id" if "doc_id" in candidates.columns else "doc.doc_id"
    spans = candidates.select(F.explode("judged").alias("s"), F.xxhash64(own_id, "judged").alias("row"))
    patterns = {(r["kind"], r["votes"]): r["n"] for r in spans.groupBy("s.kind", "s.votes").agg(F.count("*").alias("n")).collect()}
    if not patterns:
        return None
    posterior = expectation_maximisation(patterns)[2]
    share = min(1.0, 0.9 * train_spans / sum(patterns.values()))
    place = F.pmod(F.xxhash64("row", "s.start", "s.kind"), F.lit(1 << 32))
    same = [F.col("s.kind").alias("kind"), F.col("s.votes").alias("votes"), F.col("s.x").alias("x")]
    picked = spans.where(place < int(share * (1 << 32))).select("row", "s.start", *same).groupBy("row", "start", "kind", "votes", "x").agg(F.count("*").alias("n")).collect()
    picked.sort(key=lambda r: (r["kind"], r["votes"], r["x"], r["n"]))
    if not picked:
        return None
    return train_classifier(np.array([r["x"] for r in picked]), np.array([posterior[r["kind"], r["votes"]] for r in picked]), np.array([float(r["n"]) for r in picked]))


def chosen(base: list[dict], judged: list[dict], weights: np.ndarray | None) -> list[tuple[int, int, int]]:
    """Base spans and the accepted candidates that touch none before them, by kind and start."""
    spans = [(s["kind"], s["start"], s["end"]) for s in base]
    if weights is not None:
        judged = [s for s in judged if s["base"] != 1 and float(np.dot(weights, s["x"])) >= 0]
        free = apart([(s["start"], s["end"]) for s in judged], [(a, b) for _, a, b in spans])
        last = 0
        for s in sorted((s for s, alone in zip(judged, free, strict=True) if alone), key=lambda s: (s["start"], s["end"])):
            if s["start"] >= last:
                spans.append((s["kind"], s["start"], s["end"]))
                last = s["end"]
    return sorted(spans)


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each run of overlapping spans becomes the name of its first kind in square brackets."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the number of base spans of each kind, base_sha256, and spans (base and
    added, kind:start:end in code points). Null and empty texts have none; repeated rows give
    repeated results; an empty table gives an empty result. Other columns are not read."""
    found = store(with_candidates(docs.select("doc_id", "text")).drop("text"), "spans")
    weights = docs.sparkSession.sparkContext.broadcast(fit(found))

    def decided(batches):
        for batch in batches:
            base, judged = batch.column("base").to_pylist(), batch.column("judged").to_pylist()
            own = [sorted((s["kind"], s["start"], s["end"]) for s in b) for b in base]
            yield pa.record_batch([
                batch.column("doc_id"), *[pa.array([sum(s[0] == k for s in b) for b in own], pa.int64()) for k in range(len(KINDS))],
                pa.array([hashlib.sha256(spans_text(b).encode()).hexdigest() for b in own], pa.string()),
                pa.array([spans_text(chosen(b, j, weights.value)) for b, j in zip(base, judged, strict=True)], pa.string())], names=names)

    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
    schema = found.select("doc_id", *[F.lit(0).cast("bigint").alias(n) for n in names[1:5]], *[F.lit("").alias(n) for n in names[5:]]).schema
    return found.mapInArrow(decided, schema)


def redacted_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in text replaced by its kind in brackets (n_chars follows, where
    there is such a column); a null text stays null."""
    found = store(with_candidates(docs.select(F.struct("*").alias("doc"), F.col("text").alias("text"))), "spans")
    weights = docs.sparkSession.sparkContext.broadcast(fit(found))

    def replaced(batches):
        for batch in batches:
            for part in slices(batch):
                text, base, judged = (part.column(c).to_pylist() for c in ("text", "base", "judged"))
                clean = [redact(t, chosen(b, j, weights.value)) if j or b else t for t, b, j in zip(text, base, judged, strict=True)]
                yield pa.record_batch([part.column("doc"), pa.array(clean, pa.string())], names=["doc", "clean"])

    rows = found.mapInArrow(replaced, found.select("doc", F.col("text").alias("clean")).schema)
    new = {"text": F.col("clean")} | ({"n_chars": F.when(F.col("clean").isNull(), F.col("doc.n_chars")).otherwise(F.length("clean"))
                                       .cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
