"""Conversation repair and prefix trie against their SQL and against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tabloom.llm import conversation_repair as cr
from tabloom.llm import ordered
from tabloom.llm import prefix_trie as pt

ROWS = "conv_id long, turn long, role string, text string"


def made(seed):
    """Conversations with nulls, repeated rows, equal turns, copies, odd roles, a long one and a hot first turn."""
    rng = random.Random(seed)
    texts = ["Hi.", "Why?", "No end", "", "  \t", None, "é!", "x" * 3000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "ulysses"]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([t, t, t, t, None, t + 3]), rng.choice(roles if c % 3 else roles[:2]), rng.choice(texts[:3] if c % 2 else texts)))
    first = [(0, "user", "Same."), (1, "assistant", "Start.")]
    for c in range(100, 140):
        rows += [(c, *x) for x in first] + [(c, k, ("user", "assistant")[k % 2], f"{c % 4} {k}.") for k in range(2, 4 + c % 3)]
    rows += [(500, k, rng.choice(["user", "assistant", "system"]), f"turn {k % 900}.") for k in range(2600)]
    rows += [(501, k, "tool", f"turn {k}.") for k in range(1500)]  # two prefixes of equal cost for all its length
    rows += [(None, 0, "user", "No id."), (None, None, None, None)] + rows[:5]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module", params=[1, 2])
def folder(spark, request, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("conv"))
    rows = made(request.param)
    spark.createDataFrame([(*r, "clash", 1) for r in rows], ROWS + ", cost string, at int").repartition(7).write.parquet(f"{path}/conversations.parquet")
    return path, rows


def in_duckdb(path, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


@pytest.mark.parametrize("module, query", [(cr, cr.op11_conversation_repair), (pt, pt.op12_prefix_trie)])
def test_against_sql(spark, folder, module, query):
    path, rows = folder
    if module is pt:  # its SQL compares all pairs of nodes
        path += "/short"
        spark.createDataFrame([r for r in rows if r[0] not in (500, 501)], ROWS).write.mode("overwrite").parquet(f"{path}/conversations.parquet")
    names, want = in_duckdb(path, module.ORACLE)
    got = query(spark, path)
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def cheapest(codes):
    """(cost, audit) over all edits, written out for short conversations."""
    best = None
    for edits in itertools.product(cr.TOKENS, repeat=len(codes)):
        for tail in ("", "I", "II"):
            out, cost, ok = [], 0, True
            for code, name in zip(codes, edits, strict=True):
                role, fault = code & 3, code >> 2
                cost += 3 * name.count("I")
                out += [None] * name.count("I")
                if name[-1] == "D":
                    cost += 4
                    continue
                ok &= fault < cr.BLANK
                cost += 3 * (fault == cr.TRUNCATED) + 3 * (name[-1] == "R")
                out.append("uas?"[role] if name[-1] == "K" else None)
            cost += 3 * len(tail)
            out += [None] * len(tail)
            body = out[1:] if out and out[0] == "s" else out
            fits = len(body) % 2 == 0 and all(x in (None, "ua"[k % 2]) for k, x in enumerate(body)) and (body or not out)
            if ok and fits:
                best = min(best or (cost + 1, ""), (cost, "".join(edits) + tail))
    return best


def test_cheapest_edits():
    rng = random.Random(5)
    for _ in range(60):
        codes = [rng.choice([0, 0, 1, 1, 2, 3]) + 4 * rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(rng.randint(1, 3))]
        whole, parts = cr.Joiner(), cr.Joiner()
        whole.add(0, codes, cr.solve(codes, [cr.START]))
        for k, code in enumerate(codes):
            parts.add(k, [code], cr.solve([code], range(4)))
        for joiner in (whole, parts):
            cost, tokens, tail = joiner.finish()
            assert (cost, "".join(map(cr.spelled, tokens)) + tail) == cheapest(codes), codes
    assert cr.Joiner().finish() == (0, [], "")


def test_prefix_comparison_survives_collisions(monkeypatch):
    rng = random.Random(9)
    for prime in (cr.Paths._PRIME, 3, 1):  # with 1 every hash is equal
        monkeypatch.setattr(cr.Paths, "_PRIME", prime)
        paths, nodes = cr.Paths(), [[0]]
        for _ in range(9):
            nodes.append([paths.extend(p, bytes([rng.randint(1, 3)])) for p in nodes[-1] for _ in range(2)][:40])
        for level in nodes:
            for a, b in itertools.product(level[:12], repeat=2):
                x, y = (b"".join(paths.tokens(n)) for n in (a, b))
                assert paths.compare(a, b) == (x > y) - (x < y)


def test_repaired_rows(spark, folder):
    path, _ = folder
    turns, chosen = cr.audit(cr.damage(spark.read.parquet(f"{path}/conversations.parquet")))
    by = defaultdict(list)
    for r in cr.repaired_rows(turns, chosen).collect():
        by[r.conv_id].append((r.at, r.place, r.role, r.text))
    digests = {r[0]: r[1] for r in cr.repaired_digests(turns, chosen).collect()}
    for conv, want in digests.items():
        lines = [f"{role}:{text}" for *_, role, text in sorted(by[conv], key=lambda x: x[1])]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == want
        initials = "".join(x[0] for x in lines)
        assert initials.removeprefix("s").replace("ua", "") == "" and initials != "s"


def test_numbers_have_no_gaps(spark):
    rows = spark.range(5000).selectExpr("id % 3 AS k", "id AS v").repartition(6)
    got = [tuple(r) for r in ordered.placed(rows, ["k", "v"], "t").orderBy("at").collect()]
    assert [r[:2] for r in got] == sorted(r[:2] for r in got)
    blocks = defaultdict(list)
    for *_, at in got:
        blocks[at >> ordered.BLOCK_BITS].append(at)
    assert all(v == list(range(v[0], v[0] + len(v))) for v in blocks.values())


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(r or '')}:{r or ''}{x or ''}".encode()).hexdigest(), r or "", x or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    heads = lambda c: zlib.crc32(str(c).encode()) % 9
    members, ends, above, kids, size, number = {0: []}, defaultdict(list), {0: None}, defaultdict(set), {0: 0}, {}
    depth = {0: 0}
    for c in sorted(own):
        node = 0
        members[0].append(c)
        for turn in own.get(c - c % 5, [])[: heads(c)] + own[c][heads(c):]:
            new = number.setdefault((node, turn), len(above))
            if new == len(above):
                above[new], depth[new], size[new], members[new] = node, depth[node] + 1, len(turn[1].encode()), []
                kids[node].add(new)
            members[new].append(c)
            node = new
        ends[node].append(c)
    leaves, saved = {}, {}
    for n in sorted(above, key=lambda n: -depth[n]):
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = (len(members[n]) - 1) * size[n] + sum(saved[k] for k in kids[n])
    digest = lambda n: hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()
    return [(members[n][0], depth[n], None if p is None else members[p][0], len(members[n]), len(kids[n]), leaves[n], saved[n], digest(n)) for n, p in above.items()]


def test_trie_against_brute_force(spark, folder, monkeypatch):
    path, rows = folder
    assert sorted(map(tuple, pt.op12_prefix_trie(spark, path).collect()), key=repr) == sorted(brute_trie(rows), key=repr)


def test_trie_of_copies(spark, tmp_path, monkeypatch):
    """A third of all conversations are one long one; small shards share most of their nodes."""
    monkeypatch.setattr(pt, "SHARD_TURNS", 50)
    rows = [(5 * c, t, "user", f"t{t}") for c in range(300) for t in range(70)]
    rows += [(5 * c, t, "user", f"t{t if t < 64 + c % 7 else -c}") for c in range(1000, 1100) for t in range(75)]
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(map(tuple, pt.op12_prefix_trie(spark, str(tmp_path)).collect()), key=repr) == sorted(brute_trie(rows), key=repr)


def test_double_array():
    rng = np.random.default_rng(3)
    for _ in range(40):
        seqs = sorted({tuple(rng.integers(1, 9, rng.integers(1, 7)).tolist()) for _ in range(60)})
        rows = np.zeros((len(seqs), 7), np.int64)
        for k, s in enumerate(seqs):
            rows[k, : len(s)] = s
        trie = pt.DoubleArray(rows)
        known = {s[:k] for s in seqs for k in range(len(s) + 1)}
        seen = {}
        for s in [*seqs, *(tuple(rng.integers(1, 9, 4).tolist()) for _ in range(50))]:
            state = np.zeros(1, np.int64)
            for k, x in enumerate(s, 1):
                state = trie.step(state, np.array([x]))
                assert (state[0] >= 0) == (s[:k] in known)
                if state[0] < 0:
                    break
                assert seen.setdefault(int(state[0]), s[:k]) == s[:k]  # no place is used twice


@pytest.mark.parametrize("query", [cr.op11_conversation_repair, pt.op12_prefix_trie])
def test_empty(spark, tmp_path, query):
    spark.createDataFrame([], ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert query(spark, str(tmp_path)).collect() == []
