"""Token counts by heap-and-linked-list byte-pair merging.

The vocabulary file (tokenizers' JSON format) supplies the merge ranks;
text handling follows it: special strings are single tokens, the rest is
NFC-normalised, lower-cased and cut into pieces by the file's pattern.  A
piece's symbols are its UTF-8 bytes, the last one with the end-of-word
mark.  A heap gives the lowest-rank adjacent pair (leftmost first), a
linked list joins it; the number of tokens is the number of symbols less
the number of merges, so no identifiers are made.

Each task keeps the counts of the pieces it has met in a bounded table;
documents are neither shuffled nor cut.

Defined results: a null or empty text has no bytes and no tokens;
repeated rows are counted alike and all returned.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import kept_in_worker, release_memory, table, with_python_columns

LIMIT = 2048
#: Entries a task keeps of piece counts before it starts afresh.
CACHE = 600_000

#: Control characters that str.split takes for white space and the pattern doesn't.
_ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


def byte_symbols() -> list[str]:
    """The character standing for each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class PieceCounter:
    """Counts the tokens of texts for one vocabulary file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        symbols: dict[str, int] = {}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        number = lambda s: symbols.setdefault(s, len(symbols))
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[number(a), number(b)] = (rank, number(a + b))
        chars = byte_symbols()
        self.inner = [number(c) for c in chars]
        self.final = [number(c + self.suffix) for c in chars]
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.find = regex.compile(splits[0]["pattern"]["Regex"]).findall
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.words: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Tokens of one piece: symbols minus merges."""
        data = piece.encode("utf-8", "surrogatepass")
        n = len(data)
        if n < 2:
            return n
        pairs, sym = self.pairs, [self.inner[b] for b in data]
        sym[-1] = self.final[data[-1]]
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            if m := pairs.get((sym[i], sym[i + 1])):
                heap.append((m[0], i, m[1], sym[i], sym[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j < 0 or sym[j] != b:  # one of the two has been merged meanwhile
                continue
            sym[i], sym[j] = new, -1
            k = nxt[i] = nxt[j]
            merges += 1
            if k >= 0:
                prev[k] = i
                if m := pairs.get((new, sym[k])):
                    heapq.heappush(heap, (m[0], i, m[1], new, sym[k]))
            h = prev[i]
            if h >= 0 and (m := pairs.get((sym[h], new))):
                heapq.heappush(heap, (m[0], h, m[1], sym[h], new))
        return n - merges

    def _chunk(self, chunk: str) -> int:
        total = 0
        for piece in self.find(chunk):
            got = self.words.get(piece)
            if got is None:
                got = self.merged(piece)
                if len(piece) <= 64:
                    self.words[piece] = got
            total += got
        return total

    def _plain(self, text: str) -> int:
        if text.isascii():
            text = text.lower()
        elif max(text) < "ɐ":
            text = unicodedata.normalize("NFC", text).lower()
        else:
            text = self.normalizer.normalize_str(text)
        if any(c in text for c in _ODD_SPACE):
            return self._chunk(text)
        words = self.words
        total = 0
        for chunk in text.split():  # no piece holds white space
            got = words.get(chunk)
            if got is None:
                got = self._chunk(chunk)
                if len(chunk) <= 64:
                    words[chunk] = got
            total += got
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self.words) > CACHE:
            self.words.clear()
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return len(self.special.findall(text)) + sum(map(self._plain, self.special.split(text)))


_COUNTERS: dict[str, PieceCounter] = kept_in_worker()


def _counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def _release() -> None:
    release_memory(_COUNTERS)


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """``docs`` without its text and with the token count of it.

    ``vocabulary`` is the path of a vocabulary file that every executor has.
    """
    def make():
        counter = _counter(vocabulary)
        return lambda texts: [[counter.count(t) for t in texts]]

    return with_python_columns(docs, [text_col], {out_col: "long"}, make, drop=(text_col,), release=_release)


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    )
    counted = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
