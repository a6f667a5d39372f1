"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark texts (questions and answers alike) and documents are normalised
the same way: A-Z lower-cased, words are runs of digits, a-z and all
non-ASCII characters, joined by single spaces.  Every window of 13
consecutive item words (a shorter item is one window as a whole) is one
pattern; a document's normalised text is scanned once and every match is
mapped to the words it covers and, for the spans, to code points of the
original text.

The patterns are sent to the tasks; their size is checked, and a benchmark
over ``BROADCAST_BYTES`` is scanned in blocks of items, each block one
chained pass whose result is written to the shared folder before the next.
No document is shuffled.

Defined results: a null or empty text has no words, no hits and is not
contaminated; items without words give no window; repeated documents are
judged alike and all returned; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import BROADCAST_BYTES, table, with_python_columns, written

WINDOW = 13
#: A document is contaminated from one hit word in this many (and one hit).
MIN_SHARE = 20

#: Bytes of UTF-8 text: A-Z to a-z, digits, letters and all non-ASCII bytes kept, the rest a space.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def normalised(text: str) -> str:
    """Words between single spaces (also at both ends), one character per UTF-8 byte; '' without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()
    return " " + b" ".join(words).decode("latin-1") + " " if words else ""


def windows(text: str, size: int = WINDOW) -> set[str]:
    """The normalised windows of a benchmark text."""
    words = normalised(text).split(" ")[1:-1]
    if not words:
        return set()
    return {" " + " ".join(words[i: i + size]) + " " for i in range(max(1, len(words) - size + 1))}


def automaton(items: list[tuple[str, str]], size: int = WINDOW):
    """Aho-Corasick automaton of all windows; a pattern's value is (words, item ids); None without patterns."""
    import ahocorasick

    owners: dict[str, set[str]] = {}
    for item, text in items:
        for w in windows(text, size):
            owners.setdefault(w, set()).add(item)
    if not owners:
        return None
    found = ahocorasick.Automaton()
    for w, own in owners.items():
        found.add_word(w, (w.count(" ") - 1, sorted(own)))
    found.make_automaton()
    return found


def scan(norm: str, found) -> tuple[list[list[int]], set[str]]:
    """Hit word intervals [first, past last) in order, merged, and the items that hit."""
    spans: list[list[int]] = []
    items: set[str] = set()
    at = word = 0  # words counted up to character ``at``
    for end, (n, own) in found.iter(norm):
        # ``end`` never falls, so words are counted once over the text
        word += norm.count(" ", at, end)
        at = end
        last = word
        first = last - n
        items.update(own)
        while spans and spans[-1][1] >= first:
            first = min(first, spans.pop()[0])
        spans.append([first, last])
    return spans, items


def char_spans(text: str, spans: list[list[int]]) -> list[list[int]]:
    """Word intervals as [start, end) code points of the original text."""
    if not spans:
        return []
    ends = [(m.start(), m.end()) for m in _WORD.finditer(text.translate(_LOWER))]
    return [[ends[a][0], ends[b - 1][1]] for a, b in spans]


def _merge(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted([*map(list, a), *b]):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _scanner(items: list[tuple[str, str]], size: int):
    def make():
        found = automaton(items, size)

        def look(texts, old_words, old_items):
            n_words, words, chars, hits = [], [], [], []
            for text, old, old_own in zip(texts, old_words, old_items, strict=True):
                norm = normalised(text) if text else ""
                spans, own = scan(norm, found) if norm and found is not None else ([], set())
                if old:
                    spans = _merge(old, spans)
                n_words.append(max(0, norm.count(" ") - 1))
                words.append(spans)
                chars.append(char_spans(text, spans) if spans else [])
                hits.append(sorted(own.union(old_own)))
            return n_words, words, chars, hits

        return look

    return make


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", size: int = WINDOW, block_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` with _n_words, _hit_words (word intervals), _hit_spans (code point intervals of the text) and _hit_items."""
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(item_text_col).alias("t")
    ).where(F.col("t").isNotNull())
    total = items.agg(F.sum(F.octet_length("t") + F.octet_length("i")).alias("b")).first()["b"] or 0
    n_blocks = max(1, -(-int(total) // block_bytes))
    kinds = {"_n_words": "long", "_hit_words": "array<array<int>>", "_hit_spans": "array<array<int>>", "_hit_items": "array<string>"}
    out = docs.withColumns({"_hit_words": F.array().cast("array<array<int>>"), "_hit_items": F.array().cast("array<string>")})
    for k in range(n_blocks):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == k) if n_blocks > 1 else items
        block = sorted((r["i"], r["t"]) for r in own.collect())
        out = with_python_columns(out, [text_col, "_hit_words", "_hit_items"], kinds, _scanner(block, size))
        if k + 1 < n_blocks:
            out = written(out, "decontaminate")
    return out


def hit_words() -> Column:
    """Number of hit words of a row of ``find_contamination``."""
    return F.aggregate("_hit_words", F.lit(0).cast("long"), lambda a, s: a + F.element_at(s, 2) - F.element_at(s, 1))


def is_contaminated() -> Column:
    return (hit_words() > 0) & (MIN_SHARE * hit_words() >= F.col("_n_words"))


def contaminated(found: DataFrame) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256 and contaminated."""
    return found.withColumns({
        "n_words": F.col("_n_words"),
        "n_hit": hit_words(),
        "n_items": F.size("_hit_items").cast("long"),
        "items_sha256": F.sha2(F.array_join("_hit_items", ",").cast("binary"), 256),
        "contaminated": is_contaminated(),
    })


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return contaminated(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def brute_force(text: str | None, items: list[tuple[str, str]]) -> tuple[int, int, int, str, bool]:
    """The query's row by comparing every document position with every window (tests only)."""
    def words(t):
        return _WORD.findall((t or "").translate(_LOWER))

    own = words(text)
    hit, ids = set(), set()
    for item, t in items:
        iw = words(t)
        if not iw:
            continue
        for i in range(max(1, len(iw) - WINDOW + 1)):
            w = iw[i: i + WINDOW]
            for j in range(len(own) - len(w) + 1):
                if own[j: j + len(w)] == w:
                    hit.update(range(j, j + len(w)))
                    ids.add(str(item))
    digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    return len(own), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(own)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT item, unnest(list_transform(range(1, greatest(1, len(w) - 12) + 1), lambda i: array_to_string(w[i:i+12], ' '))) AS k,
         least(13, len(w)) AS n FROM b WHERE len(w) > 0
), pos AS (
  SELECT d.doc_id, n.n, unnest(range(1, len(w) - n.n + 2)) AS p,
         unnest(list_transform(range(1, len(w) - n.n + 2), lambda i: array_to_string(w[i:i+n.n-1], ' '))) AS k
  FROM d, (SELECT DISTINCT n FROM win) n WHERE len(w) >= n.n
), hits AS (
  SELECT pos.doc_id, pos.p, pos.n, win.item FROM pos JOIN win ON win.k = pos.k AND win.n = pos.n
), covered AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
