"""Source divergence, WARC round trip and conversation repair: brute force, broken input, edge rows."""

import collections
import gzip
import hashlib
import io
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from souk.llm import divergence, queries, repair, warc

DOCS = "doc_id long, text string, lang string, source string, n long, term string, p long, rank int"
TURNS = "conv_id long, turn long, role string, text string, alive string, n long"


# --- source divergence ---------------------------------------------------------------------------

def _audit(rows, least, top):
    docs = collections.defaultdict(lambda: collections.defaultdict(int))
    counts, groups = collections.defaultdict(collections.Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[A-Za-z\u0080-\U0010ffff]+", text)]
        counts[lang, source].update(terms)
        for t in set(terms):
            docs[lang][t] += 1
    kept = {g[0]: [t for t, n in docs[g[0]].items() if n >= least] for g in groups}
    prices = {}
    for key in groups | {(g[0], None) for g in groups}:
        own = counts[key] if key[1] is not None else sum((counts[g] for g in groups if g[0] == key[0]), collections.Counter())
        terms = kept[key[0]]
        total = sum(own[t] for t in terms) + 5 * len(terms)
        prices[key] = {t: 1 + 10 ** 9 * (own[t] + 5) // total for t in terms}
    out = set()
    for lang, source in groups:
        p = prices[lang, source]
        pairs = [(sum(abs(p[t] - prices[g][t]) for t in p), g[1]) for g in groups if g[0] == lang and g[1] != source]
        terms = [(p[t] - prices[lang, None][t], t) for t in p if counts[lang, source][t] and p[t] > prices[lang, None][t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, source, part, item, value, n + 1) for n, (value, item) in enumerate(found[:most])}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_brute_force(spark, monkeypatch, small):
    if small:        # many tiles, many blocks of sources, narrow products
        monkeypatch.setattr(divergence, "TILE_TERMS", 3)
        monkeypatch.setattr(divergence, "BLOCK_SOURCES", 2)
        monkeypatch.setattr(divergence, "COLUMNS", 8)
    rng = random.Random(4)
    vocabulary = ["Ünder", "a", "B", "b", "naïve", "x1y", "dot.dot", "x\x85y", "é é", "same"] + [f"{c}w" for c in "abcdefghijklmnopqrstuvw"]
    rows = [(rng.choice([None, "", " ".join(rng.choices(vocabulary, k=rng.randint(1, 30)))] + [" ".join(rng.choices(vocabulary[:9], k=40))]),
             rng.choice(["en", "de", None, "", "fr"]), rng.choice([None, "", "s1", "s2", "ß", "big", "big", "big"])) for _ in range(400)]
    rows += [("only", "xx", "alone"), (None, "yy", "a"), ("", "yy", "b")]
    frame = spark.createDataFrame([(i, t, la, s, 1, "clash", 2, 3) for i, (t, la, s) in enumerate(rows)], DOCS).repartition(4)
    got = [tuple(r) for r in divergence.audit(frame, least=10, top=7).collect()]
    assert len(got) == len(set(got)) and set(got) == _audit(rows, 10, 7)
    assert ("yy", "a", "pair", "b", 0, 1) in got


def test_audit_of_nothing_and_of_one_long_text(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []
    rows = [("word " * 200_000 + "x" * 300_000, "en", "a"), ("word other", "en", "b")]
    frame = spark.createDataFrame([(i, t, la, s, 1, "c", 2, 3) for i, (t, la, s) in enumerate(rows)], DOCS)
    assert {tuple(r) for r in divergence.audit(frame, least=1).collect()} == _audit(rows, 1, 50)


def test_joint_prices_of_one_block_are_exact():
    rng = np.random.default_rng(2)
    counts = rng.poisson(3, (200, 5)) * rng.integers(0, 1000, (200, 1))
    price = lambda c: 10 ** 9 * (c + 5) // 12_345
    term, source = (x.ravel() for x in np.meshgrid(np.arange(200), np.arange(5), indexing="ij"))
    there = counts.ravel() > 0
    rows = (np.r_[source[there], np.arange(5)], np.r_[term[there], [-1] * 5], np.r_[counts.ravel()[there], [0] * 5])
    got = divergence.joint_prices(rows[0], list("abcde"), np.zeros(5, int), rows[1], rows[2], price(rows[2]), True)
    assert {(a, b): v for a, b, v in got} == {("abcde"[i], "abcde"[j]): int(np.abs(price(counts[:, i]) - price(counts[:, j])).sum()) for i in range(5) for j in range(i + 1, 5)}


# --- WARC ----------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, payload string, archive string"
BIG = "<p>é" * 400
ODD = [(1, "http://a b/\n", "x"), (2, None, None), (3, "u", BIG), (9, "u", BIG), (4, "v", BIG), (None, "n", BIG), (9, "u", BIG), (5, "", ""), (None, None, None),
       (6, "w", "y" * 1000), (7, "w", "y" * 1000), (8, "w", "y" * 999), (10, "w", "y" * 999), (11, "é", "\r\n\r\n" * 300), (12, "l", "long " * 400_000), (None, "z", "q" * 2000), (None, "z", "q" * 2000)]


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES).repartition(3)


def test_archives_give_back_odd_pages(spark):
    frame = _pages(spark, ODD)
    rows = [(i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), h or "") for i, _, h in ODD]
    most = collections.defaultdict(lambda: None)
    for i, size, _, h in rows:
        if i is not None and size >= 1000:
            most[h] = max(i, most[h] or 0)
    want = [(i, n, d, *(("response", None) if most[h] is None or i == most[h] else ("revisit", most[h]))) for i, n, d, h in rows]
    assert sorted(map(tuple, warc.round_trip(frame).collect()), key=repr) == sorted(want, key=repr)
    assert warc.round_trip(frame.limit(0)).collect() == []


def test_archives_are_plain_gzip_of_one_member_a_record(spark):
    frame = _pages(spark, [(i, f"http://x/{i}", f"<p>{i}</p>" * 200) for i in range(50)])
    manifest = warc.write_archives(frame.coalesce(1), archive_bytes=2000)
    files = manifest.collect()
    assert len(files) > 3 and sum(f.records for f in files) == 50
    for f in files:
        raw = open(f.archive.removeprefix("file://"), "rb").read()
        assert len(raw) == f.bytes
        text = gzip.decompress(raw)
        records = list(warc.read_records(io.BytesIO(raw)))
        assert text.count(b"WARC/1.1\r\n") == len(records) == f.records + 1
        for a, b in zip(records, records[1:] + [{"offset": len(raw)}], strict=True):     # each member stands alone
            assert gzip.decompress(raw[a["offset"]:b["offset"]]).startswith(b"WARC/1.1\r\n")
    payloads = {r.target_uri: r.payload for r in warc.read_archives(manifest, with_payload=True).collect()}
    assert payloads == {f"http://x/{i}": (f"<p>{i}</p>" * 200).encode() for i in range(50)}


class Dripping(io.BytesIO):
    """A stream that gives a few bytes at a time."""

    def read(self, n=-1):
        return super().read(min(n, 7) if n >= 0 else 7)


def test_reader_inflates_piece_by_piece_and_names_what_is_broken():
    good = [warc.page_record(i, "u", b"body %d " % i * 500, None, False, 6) for i in range(3)]
    assert [r["payload_bytes"] for r in warc.read_records(Dripping(b"".join(good)))] == [3500] * 3
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_records(io.BytesIO(b"".join(good)[:-9])))
    with pytest.raises(zlib.error):
        list(warc.read_records(io.BytesIO(good[0] + b"no gzip here")))
    plain = gzip.decompress(good[1])
    swapped = gzip.compress(plain.replace(b"body 1", b"body 7", 1))
    assert [r["problem"] for r in warc.read_records(io.BytesIO(good[0] + swapped))] == [None, "block digest"]
    said = re.sub(rb"WARC-Payload-Digest: sha1:\w+", b"WARC-Payload-Digest: sha1:" + b"0" * 40, plain)
    assert [r["problem"] for r in warc.read_records(io.BytesIO(gzip.compress(said)))] == ["payload digest"]
    for wrong in (b"Content-Length: 9\r\n\r\nHTTP", b"Content-Length: 99999\r\n\r\nHTTP"):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(gzip.compress(re.sub(rb"Content-Length: \d+\r\n\r\nHTTP", wrong, plain)))))


def test_a_broken_archive_fails_the_job_or_is_named(spark, tmp_path):
    good = warc.page_record(1, "u", b"x" * 5000, None, False, 6)
    (tmp_path / "a.warc.gz").write_bytes(good + good[:-20])
    manifest = spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "archive string")
    rows = warc.read_archives(manifest, strict=False).collect()
    assert [(r.payload_bytes, r.problem) for r in rows] == [(5000, None), (None, "the archive ends inside a record")]
    with pytest.raises(Exception, match="ends inside"):
        warc.read_archives(manifest).collect()


def test_a_revisit_without_its_response_has_no_payload(spark):
    records = warc.read_archives(warc.write_archives(_pages(spark, ODD)))
    lost = warc.resolved(records.where("record_type = 'revisit'"))
    assert lost.count() > 0 and lost.where("payload_bytes IS NOT NULL OR payload_digest IS NOT NULL").count() == 0


# --- conversations -------------------------------------------------------------------------------

def _damaged(rows):
    out = collections.defaultdict(list)
    for c, t, r, x in rows:
        r, x = (" " if r is None else r), (" " if x is None else x)
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x
        out[c] += [] if fate == 0 else [(t, "user" if fate == 4 else r, x)] * (2 if fate == 3 else 1)
    return out


def _repair(rows):
    """Faults and the cheapest repair, from the last row to the first, with whole strings."""
    rows = sorted(rows, key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
    turns = [t for t, _, _ in rows if t is not None]
    seen, faults = set(), []
    for _, r, x in rows:
        ends = re.findall(r"[^\x20\x09-\x0D]", x)
        faults.append("b" if not ends else "d" if (r, x) in seen else "t" if ends[-1] not in ".!?" else "")
        seen.add((r, x))
    accepts = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    best = [{} for _ in range(len(rows) + 1)]
    for i in range(len(rows), -1, -1):
        for _ in range(3):
            for state, steps in accepts.items():
                found = [best[i][state]] if state in best[i] else []
                found += [(0, "")] if i == len(rows) and state in (0, 3) else []
                found += [(best[i][to][0] + 2, "I" + best[i][to][1]) for role, to in steps.items() if role != "s" and to in best[i]]
                if i < len(rows):
                    after, extra = best[i + 1], faults[i] == "t"
                    found += [(after[state][0] + 3, "D" + after[state][1])] if state in after else []
                    if faults[i] not in ("b", "d"):
                        found += [(after[to][0] + extra, "K" + after[to][1]) for role, to in steps.items() if to in after and rows[i][1][:1] == role]
                        found += [(after[to][0] + 2 + extra, "R" + after[to][1]) for role, to in steps.items() if to in after and role != "s"]
                if found:
                    best[i][state] = min(found)
    cost, audit = best[0][0]
    state, i, lines = 0, 0, []
    for e in audit:
        given = "assistant" if state == 2 else "user"
        if e != "I":
            (_, r, x), i = rows[i], i + 1
        if e == "D":
            continue
        lines.append(f"{r}:{x}" if e == "K" else given + ":" + (x if e == "R" else ""))
        state = accepts[state][r[:1] if e == "K" else given[0]]
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    n = collections.Counter(faults)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["b"], n["d"], n["t"],
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _held(frame, got, damage=True):
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    want = {c: _repair(v) for c, v in _damaged(rows).items()}
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want


def test_registered_repair_equals_brute_force(spark, sf):
    _held(spark.read.parquet(f"{sf}/conversations.parquet"), queries.QUERIES["op13_conversation_repair"](spark, sf).collect())


@pytest.mark.parametrize("piece", [1024, 3])
def test_repair_of_odd_rows_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE_ROWS", piece)
    rng = random.Random(piece)
    rows = [(rng.choice([1, 2, 3, None, *range(4, 30)]), rng.choice([None, *range(12)]), rng.choice([None, "user", "assistant", "system", "tool", "", "u", "assistant", "user"]),
             rng.choice([None, "", "a.", "b", "c?", " \n", "d! \t", "é", "e.\x85", "f.\x0b\f\r"]), "clash", 5) for _ in range(600)]
    rows += [(77, 0, "user", "gone.", "x", 1), (78, 3, "user", "l" * 600_000, "x", 1), (78, 4, "assistant", "m " * 300_000, "x", 1)]
    _held(frame := spark.createDataFrame(rows, TURNS).repartition(5), repair.damaged_and_repaired(frame).collect())
    assert repair.damaged_and_repaired(frame.limit(0)).collect() == []


def test_a_hot_conversation_and_a_hot_row_are_split(spark):
    rng = random.Random(8)
    rows = [(1, i, rng.choice(["user", "assistant"]), f"t{rng.randint(0, 9999)}" + rng.choice(".?x"), "", 0) for i in range(5000)]
    rows += [(2, 5, "user", "same.", "", 0)] * 4000 + [(3 + i, 0, "user", "common first turn.", "", 0) for i in range(2000)]
    frame = spark.createDataFrame(rows, TURNS).repartition(7)
    cut = repair.pieces(repair.with_symbols(repair.damage(frame)))
    assert max(len(r.symbols) for r in cut.select("symbols").collect()) <= repair.PIECE_ROWS
    assert cut.where("conv_id = 1").select("part").distinct().count() > 1
    _held(frame, repair.damaged_and_repaired(frame).collect())


def test_grammar_and_its_matrices_change_no_result():
    rng = random.Random(3)
    rules = ["ua", chr(repair.FIRST_RULE) * 2, "D" + chr(repair.FIRST_RULE), "su", "xD"]
    table = repair.matrices(rules)
    for _ in range(300):
        text = "".join(rng.choices("DsuaxSUAXuaua", k=rng.randint(0, 14)))
        ends = []
        for names in (text, repair.compress(rules, text)):
            state = repair.Running(1)
            piece = {"symbols": text, "roles": ["user"] * 20, "texts": ["t"] * 20}
            vector = [(0, 0, None, 0), None, None, None]
            for name in names:
                vector = repair.advance(vector, table[name])
            state.vector = vector
            out = state.close(piece)
            ends.append((out["cost"], out["audit"], out["repaired_sha256"]))
        assert ends[0] == ends[1]


def test_re_pair_finds_the_frequent_pairs(spark):
    rules = repair.grammar(spark.createDataFrame([("suauaua", 50), ("uaua", 50), ("Dx", 1)], "symbols string, n long"))
    assert rules[0] in ("ua", "au") and len(repair.compress(rules, "suauaua")) < 4
    assert repair.grammar(spark.createDataFrame([], "symbols string, n long")) == []


def test_queries_of_new_operators_have_sql_or_brute_force():
    assert {"op11_source_divergence", "op12_warc_round_trip"} <= set(queries.SQL)
    assert duckdb.sql("SELECT sha1('a')").fetchall()[0][0] == hashlib.sha1(b"a").hexdigest()
