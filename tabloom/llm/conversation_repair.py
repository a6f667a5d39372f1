"""Conversation structure repair by a persistent audit DP.

A conversation shall read ``(s?(ua)+)?`` in the initials of its roles.  Rows
are kept, given another role or deleted, and empty user or assistant rows
are inserted; the cheapest edits win, ties the ASCII-least audit (K, R, D, I
in order).  Four states tell what may follow: nothing yet, after the system
row, after an assistant row, after a user row.  For each state the DP keeps
the cost and the last node of its edit prefix; prefixes are linked nodes
that share their beginnings and carry binary-lifting ancestors and rolling
hashes.  Two prefixes of equal cost are compared at their first difference,
found by a longest-common-prefix search over the hashes; the common part is
verified, so a collision changes nothing.

A node's token is a row's edits: the rows inserted before it and its own
edit.  No token is the beginning of another (each ends with K, R or D), so
prefixes over the same rows compare as their tokens do, and every prefix
over i rows has i tokens.

At scale: rows are numbered in (conversation, turn) order and cut into runs
of at most 1024.  Every run is solved on its own for each state it may be
entered in; the runs of a conversation are then joined by the same DP whose
tokens are whole runs, streamed in order.  Texts aren't part of it: they
are read once more, in order, when the edits are applied, and no
conversation is held in memory.  A digest of a whole conversation is one
sequential stream; only its state is kept.

Defined results: a null role or text is one space; a null conversation id
is a conversation of its own; null turns come first; rows of equal turn
are ordered by the md5 of role and text; an empty text is blank; a
conversation without rows has zeros, an empty audit and the empty string's
digest; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import CRC32, table, written
from tabloom.llm.ordered import BLOCK_BITS, block, placed

SPACES = " \t\n\x0b\x0c\r"
#: What is wrong with a row, in the order in which the first one counts.
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
USER, ASSISTANT, SYSTEM, OTHER = range(4)
#: Edit prices.
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 3, 4, 3, 3
START, AFTER_SYSTEM, AFTER_ASSISTANT, AFTER_USER = range(4)
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}

#: A row's possible edits in ASCII order; their places + 1 are the token bytes.
TOKENS = ["D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R"]
#: Rows to insert at the end of a conversation, by state.
TAILS = {START: "", AFTER_SYSTEM: "II", AFTER_ASSISTANT: "", AFTER_USER: "I"}


def expected(state: int) -> int:
    """The role that an inserted or changed row gets."""
    return ASSISTANT if state == AFTER_USER else USER


def follow(state: int, role: int) -> int | None:
    """State after a row of ``role``; None where it may not stand."""
    if role == SYSTEM:
        return AFTER_SYSTEM if state == START else None
    if role != expected(state):
        return None
    return AFTER_USER if role == USER else AFTER_ASSISTANT


def _steps(code: int) -> list[list[tuple[int, int, bytes]]]:
    """For each state: (state after, price, token) of a row's edits, the best for each state after."""
    role, fault = code & 3, code >> 2
    out = []
    for state in range(4):
        best: dict[int, tuple[int, bytes]] = {}
        for k, name in enumerate(TOKENS):
            now, price = state, INSERT * name.count("I")
            for _ in range(name.count("I")):
                now = follow(now, expected(now))
            if name[-1] == "D":
                price += DELETE
            elif fault in (BLANK, DUPLICATE):
                continue
            else:
                now = follow(now, role if name[-1] == "K" else expected(now))
                price += REROLE * (name[-1] == "R") + LEFT_TRUNCATED * (fault == TRUNCATED)
                if now is None:
                    continue
            best[now] = min(best.get(now, (price, b"\xff")), (price, bytes([k + 1])))
        out.append([(to, *x) for to, x in best.items()])
    return out


STEPS = [_steps(code) for code in range(16)]


class Paths:
    """Edit prefixes as linked nodes; node 0 is the empty one."""

    _BASE, _PRIME = 1_000_003, (1 << 61) - 1

    def __init__(self) -> None:
        self.token: list[bytes] = [b""]
        self.hash = [0]
        self.up: list[list[int]] = [[]]  # the ancestors 1, 2, 4, ... nodes above

    def extend(self, parent: int, token: bytes) -> int:
        node = len(self.token)
        self.token.append(token)
        self.hash.append((self.hash[parent] * self._BASE + int.from_bytes(token, "big") + 1) % self._PRIME)
        own, above, k = [parent], parent, 0
        while k < len(self.up[above]):
            above = self.up[above][k]
            own.append(above)
            k += 1
        self.up.append(own)
        return node

    def compare(self, a: int, b: int) -> int:
        """-1, 0 or 1 as the prefix of ``a`` is less than, equal to or more than that of ``b``, both of equal depth."""
        if a == b:
            return 0
        up, hashes = self.up, self.hash
        x, y = a, b
        if hashes[x] == hashes[y]:
            return self._walk(x, y)
        for k in reversed(range(len(up[x]))):
            if k < len(up[x]) and hashes[up[x][k]] != hashes[up[y][k]]:
                x, y = up[x][k], up[y][k]
        if found := self._walk(up[x][0], up[y][0]):  # equal hashes of different prefixes
            return found
        return -1 if self.token[x] < self.token[y] else 1

    def _walk(self, x: int, y: int) -> int:
        """Compare two prefixes node by node up to the one they share."""
        found = 0
        while x != y:
            p, q = self.token[x], self.token[y]
            if p != q:
                found = -1 if p < q else 1
            x, y = self.up[x][0], self.up[y][0]
        return found

    def tokens(self, node: int) -> list[bytes]:
        out = []
        while node:
            out.append(self.token[node])
            node = self.up[node][0]
        return out[::-1]


Live = dict[int, tuple[int, int]]


def advance(paths: Paths, live: Live, steps: Iterable[tuple[int, int, int, bytes]]) -> Live:
    """The best prefix for each state after one row or run; ``steps`` are (state, state after, price, token)."""
    new: dict[int, tuple[int, int, bytes]] = {}
    for state, to, price, token in steps:
        if state not in live:
            continue
        cost, node = live[state]
        cost += price
        old = new.get(to)
        if old is None or cost < old[0] or (cost == old[0] and (paths.compare(node, old[1]) or (-1 if token < old[2] else 1)) < 0):
            new[to] = (cost, node, token)
    return {s: (c, paths.extend(n, t)) for s, (c, n, t) in new.items()}


_ROW_STEPS = [[(s, *step) for s in range(4) for step in STEPS[code][s]] for code in range(16)]


def solve(codes: Iterable[int], entries: Iterable[int]) -> list[tuple[int, int, int, bytes]]:
    """(state before, state after, cost, tokens) of a run of rows."""
    out = []
    for entry in entries:
        paths, live = Paths(), {entry: (0, 0)}
        for code in codes:
            live = advance(paths, live, _ROW_STEPS[code])
        out += [(entry, to, cost, b"".join(paths.tokens(node))) for to, (cost, node) in live.items()]
    return out


class Joiner:
    """Joins the runs of one conversation, given in order."""

    def __init__(self) -> None:
        self.paths, self.live = Paths(), {START: (0, 0)}
        self.blocks: list[int] = []
        self.faults = [0, 0, 0, 0]
        self.illegal, self.last = 0, None

    def add(self, number: int, codes: list[int], ways: list[tuple[int, int, int, bytes]]) -> None:
        self.blocks.append(number)
        self.live = advance(self.paths, self.live, ways)
        for code in codes:
            role = code & 3
            self.faults[code >> 2] += 1
            self.illegal += self.last is not None and (self.last, role) not in LEGAL
            self.last = role

    def finish(self) -> tuple[int, list[bytes], str]:
        """Cost, tokens of each run, rows to insert at the end."""
        best = None
        for state, (cost, node) in self.live.items():
            cost += INSERT * len(TAILS[state])
            if best is None or cost < best[0] or (cost == best[0] and self.paths.compare(node, best[1]) < 0):
                best = (cost, node, TAILS[state])
        return best[0], self.paths.tokens(best[1]), best[2]


def spelled(tokens: bytes) -> str:
    return "".join([TOKENS[t - 1] for t in tokens])


def role_class(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "u", USER).when(first == "a", ASSISTANT).when(first == "s", SYSTEM).otherwise(OTHER)


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) without nulls in role and text, numbered by conversation and turn (``at``)."""
    clean = rows.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    marked = clean.withColumn("mark", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    return placed(marked, ["conv_id", "turn", "mark"], "turns")


def coded_runs(turns: DataFrame) -> DataFrame:
    """(conv_id, run, start, codes): role and fault of each row, in runs of at most 1024 rows."""
    first = turns.groupBy("conv_id", "mark").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    body = F.rtrim("text", F.lit(SPACES))
    seen = turns.select(
        "conv_id", "at", role_class(F.col("role")).alias("role"), (body == "").alias("blank"),
        (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut"),
    ).join(first, "at", "left")  # one row for each ``at``: no frequent key
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(SOUND)
    coded = seen.select("conv_id", block().alias("run"), F.struct("at", (F.col("role") + 4 * fault).alias("code")).alias("row"))
    runs = coded.groupBy("conv_id", "run").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return runs.select("conv_id", "run", F.col("rows")[0]["at"].alias("start"), F.col("rows")["code"].alias("codes"))


_WAYS = "array<struct<before: int, after: int, cost: long, tokens: binary>>"


def solved_runs(runs: DataFrame) -> DataFrame:
    """``runs`` with ``ways``: the best edits for each state before and after.

    Only a run at the first place of a block can continue a conversation;
    any other one is its beginning.
    """
    kind = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("tokens", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ways = [
                [dict(zip(("before", "after", "cost", "tokens"), w, strict=True)) for w in solve(codes, (START,) if start % (1 << BLOCK_BITS) else range(4))]
                for start, codes in zip(batch.column("start").to_pylist(), batch.column("codes").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ways, kind)], names=[*batch.schema.names, "ways"])

    return runs.mapInArrow(run, runs.withColumn("ways", F.lit(None).cast(_WAYS)).schema)


_CHOICE = "conv_id long, run long, tokens binary, tail string, cost long, illegal long, truncated long, blank long, duplicate long, audit string"


def choices(solved: DataFrame) -> DataFrame:
    """The chosen edits: ``tokens`` for each run; each conversation's last run also has its ``tail`` and totals."""
    kind = pa.schema([
        ("conv_id", pa.int64()), ("run", pa.int64()), ("tokens", pa.binary()), ("tail", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()),
        ("truncated", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("audit", pa.string()),
    ])

    def ended(conv, joiner: Joiner) -> list[tuple]:
        cost, tokens, tail = joiner.finish()
        f = joiner.faults
        rows = [(conv, n, t, *[None] * 7) for n, t in zip(joiner.blocks, tokens, strict=True)]
        audit = "".join(map(spelled, tokens)) + tail
        rows[-1] = (*rows[-1][:3], tail, cost, joiner.illegal, f[TRUNCATED], f[BLANK], f[DUPLICATE], audit)
        return rows

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, joiner, out = None, None, []
        for batch in batches:
            for c, n, codes, ways in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "run", "codes", "ways")), strict=True):
                if joiner is None or c != conv:
                    if joiner is not None:
                        out += ended(conv, joiner)
                    conv, joiner = c, Joiner()
                joiner.add(n, codes, [tuple(w.values()) for w in ways])
                if len(out) > 2000:
                    yield table_of(out)
                    out = []
        if joiner is not None:
            out += ended(conv, joiner)
        if out:
            yield table_of(out)

    ordered = solved.select("conv_id", "run", "codes", "ways").repartition("conv_id").sortWithinPartitions("conv_id", "run")
    return ordered.mapInArrow(run, _CHOICE)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, at, role, text) of repaired rows in order; (conv_id, None, None, None) ends a conversation.

    Takes the rows of conversations in order, each run after the row of its edits.
    """
    names = ("user", "assistant")
    conv, open_, state, tail, edits = None, False, START, "", iter(())
    at = 0

    def end():
        nonlocal state
        for _ in tail:
            yield conv, at, names[expected(state)], ""
            state = follow(state, expected(state))
        yield conv, None, None, None

    for batch in batches:
        cols = [batch.column(x).to_pylist() for x in ("conv_id", "at", "role", "text", "tokens", "tail")]
        for c, place, role, text, tokens, more in zip(*cols, strict=True):
            if not open_ or c != conv:
                if open_:
                    yield from end()
                conv, open_, state, tail = c, True, START, ""
            if tokens is not None:
                edits, tail = iter(tokens), more or ""
                continue
            at = place
            name = TOKENS[next(edits) - 1]
            for _ in name[:-1]:
                yield conv, at, names[expected(state)], ""
                state = follow(state, expected(state))
            if name[-1] == "D":
                continue
            if name[-1] == "R":
                role = names[expected(state)]
                state = follow(state, expected(state))
            else:
                state = follow(state, {"u": USER, "a": ASSISTANT, "s": SYSTEM}[role[0]])
            yield conv, at, role, text
    if open_:
        yield from end()


def _edit_stream(turns: DataFrame, chosen: DataFrame) -> DataFrame:
    rows = turns.select("conv_id", "at", F.lit(1).alias("kind"), "role", "text", F.lit(None).cast("binary").alias("tokens"), F.lit(None).cast("string").alias("tail"))
    none = F.lit(None).cast("string")
    edits = chosen.select("conv_id", F.shiftleft("run", BLOCK_BITS).alias("at"), F.lit(0).alias("kind"), none.alias("role"), none.alias("text"), "tokens", "tail")
    return rows.unionByName(edits).repartition("conv_id").sortWithinPartitions("conv_id", "at", "kind")


def repaired_rows(turns: DataFrame, chosen: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, at, place, role, text), ``place`` telling apart rows inserted at the same ``at``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, size = [], 0, 0

        def packed():
            cols = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["conv_id", "at", "place", "role", "text"])

        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for conv, at, role, text in _applied(batches):
            if at is None:
                place = 0
                continue
            out.append((conv, at, place, role, text))
            place, size = place + 1, size + len(text)
            if size > 1 << 20 or len(out) >= 4000:
                yield packed()
                out, size = [], 0
        if out:
            yield packed()

    return _edit_stream(turns, chosen).mapInArrow(run, "conv_id long, at long, place long, role string, text string")


def repaired_digests(turns: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the repaired ``role:text`` lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, sha, first = [], hashlib.sha256(), True

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([s for _, s in done])], names=["conv_id", "repaired_sha256"])

        for conv, at, role, text in _applied(batches):
            if at is None:
                done.append((conv, sha.hexdigest()))
                sha, first = hashlib.sha256(), True
                if len(done) >= 4000:
                    yield packed()
                    done = []
                continue
            sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        if done:
            yield packed()

    return _edit_stream(turns, chosen).mapInArrow(run, "conv_id long, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` with faults planted by the crc32 of ``conv_id:turn`` modulo 20 (nulls are one space)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    r = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    harmed = rows.select(
        "conv_id", "turn", F.when(r == 4, "user").otherwise(text("role")).alias("role"),
        F.when(r == 1, "").when(r == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"),
        F.when(r == 0, 0).when(r == 3, 2).otherwise(1).alias("copies"),
    )
    return harmed.where("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def audit(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns and the chosen edits of ``rows`` (conv_id, turn, role, text)."""
    turns = in_order(rows)
    return turns, written(choices(solved_runs(coded_runs(turns))), "edits")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns, chosen = audit(damage(given))
    gaps = turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    )
    totals = ["blank", "duplicate", "truncated", "illegal", "cost"]
    last = chosen.where(F.col("tail").isNotNull()).select("conv_id", *totals, "audit")
    out = given.select("conv_id").distinct()
    for part in (gaps, last, repaired_digests(turns, chosen)):
        own = part.withColumnRenamed("conv_id", "_id")
        out = out.join(own, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    return out.select(
        "conv_id", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ["gaps", *totals]),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


ORACLE = f"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
), hit AS (SELECT *, {CRC32.format('name')} % 20 AS r FROM given
), harmed AS (
  SELECT conv_id, turn, CASE WHEN r = 4 THEN 'user' ELSE role END AS role,
         CASE r WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE r WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit
), lined AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), copy) AS i FROM harmed
), judged AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
         min(i) OVER (PARTITION BY conv_id, role, text) < i AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM lined
), turns AS (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN again THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM judged
), inserts(state, n, landed, lines) AS (
  VALUES (0, 0, 0, []::VARCHAR[]), (1, 0, 1, []), (2, 0, 2, []), (3, 0, 3, []), (0, 1, 3, ['user:']), (1, 1, 3, ['user:']), (2, 1, 3, ['user:']),
         (3, 1, 2, ['assistant:']), (0, 2, 2, ['user:', 'assistant:']), (1, 2, 2, ['user:', 'assistant:']), (2, 2, 2, ['user:', 'assistant:']),
         (3, 2, 3, ['assistant:', 'user:'])
), stands(state, letter, name, next) AS (
  VALUES (0, 'u', 'user', 3), (1, 'u', 'user', 3), (2, 'u', 'user', 3), (3, 'a', 'assistant', 2), (0, 's', 'system', 1)
), dp(conv_id, i, state, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} FROM turns
  UNION ALL
  SELECT d.conv_id, t.i, e.state, min({{'cost': d.best.cost + 3 * s.n + e.price, 'audit': d.best.audit || repeat('I', s.n) || e.act,
                                      'lines': d.best.lines || s.lines || e.line}})
  FROM dp d JOIN turns t ON t.conv_id IS NOT DISTINCT FROM d.conv_id AND t.i = d.i + 1 JOIN inserts s ON s.state = d.state
  CROSS JOIN LATERAL (
    SELECT s.landed AS state, 4 AS price, 'D' AS act, []::VARCHAR[] AS line
    UNION ALL
    SELECT p.next, CASE t.fault WHEN 't' THEN 3 ELSE 0 END, 'K', [t.role || ':' || t.text] FROM stands p
    WHERE p.state = s.landed AND p.letter = t.initial AND t.fault IN ('', 't')
    UNION ALL
    SELECT p.next, 3 + CASE t.fault WHEN 't' THEN 3 ELSE 0 END, 'R', [p.name || ':' || t.text] FROM stands p
    WHERE p.state = s.landed AND p.letter <> 's' AND t.fault IN ('', 't')
  ) e
  GROUP BY d.conv_id, t.i, e.state
), sizes AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id
), ends AS (
  SELECT d.conv_id, min({{'cost': d.best.cost + 3 * s.n, 'audit': d.best.audit || repeat('I', s.n), 'lines': d.best.lines || s.lines}}) AS best
  FROM dp d JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM d.conv_id AND z.n = d.i JOIN inserts s ON s.state = d.state
  WHERE s.landed = 2 OR (s.landed = 0 AND s.n = 0) GROUP BY d.conv_id
)
SELECT o.conv_id, coalesce(z.gaps, 0)::BIGINT AS gaps, coalesce(z.blank, 0)::BIGINT AS blank, coalesce(z.duplicate, 0)::BIGINT AS duplicate,
       coalesce(z.truncated, 0)::BIGINT AS truncated, coalesce(z.illegal, 0)::BIGINT AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost,
       coalesce(e.best.audit, '') AS audit, sha256(coalesce(array_to_string(e.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
