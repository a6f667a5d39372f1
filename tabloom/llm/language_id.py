"""Language identification by multilingual mixture inference.

Learning: byte-trigram counts per language over the training rows, added
up by Spark; the model is one smoothed log-probability table of
``buckets`` x languages, whose size doesn't depend on the data.

Prediction: every word of a document has a likelihood under each language
(its trigrams, with the word ends).  The document is a mixture:
expectation-maximisation estimates each language's share of the words, and
the set of languages is chosen by penalised likelihood: starting from all
languages, the one with the smallest share is left out as long as the
log-likelihood, less ``penalty`` x log(words) for each language, does not
fall.  The prediction is the language with the largest share (ties: the
first name), the score that share.

The shares are relative and say nothing of text in no learned language; for
that, ``evidence`` holds the text's likelihood against that of the training
rows in the same languages.

Whole texts are used; a task works on slices of a few MB, a longer text is
a slice of its own.  No text is shuffled.

Defined results: a null text or one without a letter is ``und`` with score
0; so is everything when nothing could be learned; any other text gets a
learned language; repeated rows are predicted alike and all returned;
training rows with null text, null language or null id are not learned
from; an empty table gives no rows.  Columns named like an output are
replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import free_name, held_out, release_memory, table, utf8_slices

#: Most cells of the model (buckets x languages): 4 bytes each when sent to the tasks.
CELLS = 1 << 22
MAX_BUCKETS = 1 << 16
#: Added to each count.
SMOOTHING = 0.5
#: Words' log-likelihoods count for this share, as overlapping trigrams repeat evidence.
TEMPER = 0.5
PENALTY = 1.0
STEPS = 8
SLICE_BYTES = 1 << 20
UNKNOWN = "und"
#: A text is foreign if its trigrams are on average this much (natural logarithm) less likely than the training rows' own ...
FOREIGN = 3.0
#: ... and, as few trigrams say little, by so many standard errors more (overlapping trigrams count a third).
ERRORS = 2.0


def _letters(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slice's bytes with a space before, between and after the rows and for every non-letter; the rows' starts."""
    n = len(off) - 1
    rows = np.repeat(np.arange(n), np.diff(off))
    x = np.full(len(data) + n + 1, 32, dtype=np.uint8)
    x[np.arange(len(data)) + rows + 1] = data
    x[~(((x >= 97) & (x <= 122)) | (x >= 128))] = 32
    return x, off[:-1] + np.arange(n) + 1


def _trigrams(x: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of letters and the bucket of the trigram around each."""
    at = np.flatnonzero(x != 32)
    code = (x[at - 1].astype(np.uint32) << 16) | (x[at].astype(np.uint32) << 8) | x[at + 1]
    return at, (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(buckets).bit_length() + 1)


class Model:
    """Log-probabilities (buckets x languages, float32) and the languages in order."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.buckets = counts.shape[0]
        p = counts + SMOOTHING
        self.log_p = np.log(p / p.sum(axis=0)).astype(np.float32)
        n = np.maximum(counts.sum(axis=0), 1)
        #: Mean and variance of the training trigrams' log-probabilities in each language.
        self.mean = (counts * self.log_p).sum(axis=0) / n
        self.var = (counts * (self.log_p - self.mean) ** 2).sum(axis=0) / n

    def words(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log-likelihoods of the slice's words (words x languages) and the row of each word."""
        x, starts = _letters(off, data)
        at, bucket = _trigrams(x, self.buckets)
        if not len(at):
            return np.zeros((0, len(self.languages)), np.float32), np.zeros(0, np.int64)
        first = np.flatnonzero(x[at - 1] == 32)
        ll = np.add.reduceat(self.log_p[bucket], first, axis=0) * np.float32(TEMPER)
        return ll, np.searchsorted(starts, at[first], side="right") - 1

    def shares(self, off: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Share of each language in each row of the slice (rows without words: zeros)."""
        rows, k = len(off) - 1, len(self.languages)
        out = np.zeros((rows, k))
        ll, row = self.words(off, data)
        if not len(row):
            return out
        top = ll.max(axis=1, keepdims=True)
        lik, top = np.exp(ll - top).astype(np.float64), top[:, 0].astype(np.float64)
        live, first = np.unique(row, return_index=True)
        n = np.diff(np.append(first, len(row))).astype(np.float64)
        pi, score = _mixture(lik, first, n, np.full((len(live), k), 1.0 / k))
        small = pi < 0.5 / n[:, None]  # less than half a word
        small[np.arange(len(live)), pi.argmax(axis=1)] = False  # the largest share stays, however many languages there are
        pi[small] = 0.0
        pi /= pi.sum(axis=1, keepdims=True)
        # lik is what is left of the words' likelihoods; their maxima are the same for all sets
        open_ = np.flatnonzero((pi > 0).sum(axis=1) > 1)
        size = (pi > 0).sum(axis=1)
        if len(open_):
            score[open_] = _fit(lik, first, n, pi, open_)
        score -= PENALTY * size * np.log(n + 1)
        while len(open_):
            trial = pi[open_]
            trial[trial == 0] = 2.0
            drop = trial.argmin(axis=1)
            trial[trial == 2.0] = 0.0
            trial[np.arange(len(open_)), drop] = 0.0
            trial /= trial.sum(axis=1, keepdims=True)
            own = pi.copy()
            own[open_] = trial
            got = _fit(lik, first, n, own, open_) - PENALTY * (size[open_] - 1) * np.log(n[open_] + 1)
            better = got >= score[open_]
            open_ = open_[better]
            pi[open_], score[open_] = own[open_], got[better]
            size[open_] -= 1
            open_ = open_[size[open_] > 1]
        out[live] = pi
        return out

    def evidence(self, off: np.ndarray, data: np.ndarray, pi: np.ndarray) -> np.ndarray:
        """Log-likelihood per trigram of each row under its shares ``pi``, less the least of a text in these languages.

        Negative values are foreign; the number of languages doesn't matter.  Rows without words: 0.
        """
        x, starts = _letters(off, data)
        at, bucket = _trigrams(x, self.buckets)
        row = np.searchsorted(starts, at, side="right") - 1
        total = np.zeros(len(off) - 1)
        for lo in range(0, len(at), 1 << 16):
            own = row[lo: lo + (1 << 16)]
            lik = (np.exp(self.log_p[bucket[lo: lo + (1 << 16)]], dtype=np.float64) * pi[own]).sum(axis=1)
            total += np.bincount(own, np.log(np.maximum(lik, 1e-300)), len(total))
        n = np.bincount(row, minlength=len(total))
        least = pi @ self.mean - FOREIGN - ERRORS * np.sqrt(3 * (pi @ self.var) / np.maximum(n, 1))
        return np.where(n > 0, total / np.maximum(n, 1) - least, 0.0)


def _mixture(lik, first, n, pi):
    """EM over the words of consecutive rows; the shares and the rows' log-likelihoods."""
    reps = n.astype(np.int64)
    for _ in range(STEPS):
        r = lik * np.repeat(pi, reps, axis=0)
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
        pi = np.add.reduceat(r, first, axis=0) / n[:, None]
    s = np.log(np.maximum((lik * np.repeat(pi, reps, axis=0)).sum(axis=1), 1e-300))
    return pi, np.add.reduceat(s, first)


def _fit(lik, first, n, pi, rows):
    """EM for some rows from their present shares (kept within the nonzero ones); updates ``pi``."""
    reps = n.astype(np.int64)[rows]
    begin = np.cumsum(reps) - reps
    words = np.repeat(first[rows] - begin, reps) + np.arange(int(reps.sum()))
    pi[rows], score = _mixture(lik[words], begin, n[rows], pi[rows])
    return score


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Model from all rows with a text and a language; None without any."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.lower(F.col(text_col)).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n_lang = rows.select(F.count_distinct("lang")).first()[0]
    if not n_lang:
        return None
    buckets = min(MAX_BUCKETS, 1 << max(8, (CELLS // n_lang).bit_length() - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, hi, off, data in utf8_slices(batch.column("text"), SLICE_BYTES):
                names, code = np.unique(langs[lo:hi], return_inverse=True)
                x, starts = _letters(off, data)
                at, bucket = _trigrams(x, buckets)
                row = np.searchsorted(starts, at, side="right") - 1
                for k, name in enumerate(names.tolist()):
                    own = np.bincount(bucket[code[row] == k], minlength=buckets)
                    total[name] = total[name] + own if name in total else own
        for name, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(own[at], pa.int64())})
        release_memory()

    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts["lang"].to_pylist()))
    if not names:
        return None
    at = {name: k for k, name in enumerate(names)}
    cells = np.zeros((buckets, len(names)))
    cells[counts["bucket"].to_numpy(), [at[x] for x in counts["lang"].to_pylist()]] = counts["n"].to_numpy()
    return Model(names, cells)


def predict(
    docs: DataFrame, model: Model | None, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "lang_shares"),
    evidence_col: str | None = None,
) -> DataFrame:
    """``docs`` with language, score and the shares of the chosen languages, in columns called ``names``.

    ``evidence_col`` names a column for the evidence that the text is in these languages at all (``Model.evidence``).
    """
    if evidence_col:
        names = (*names, evidence_col)
    keep = [c for c in docs.columns if c not in names]
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    lower = free_name([*docs.columns, *names], "_lower")
    given = docs.withColumn(lower, F.when(letter, F.lower(F.col(text_col))))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = zip(names, ("string", "double", "map<string,double>", "double")[: len(names)], strict=True)
    schema = docs.select(*keep, *(F.lit(None).cast(k).alias(c) for c, k in kinds)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        own = sent.value
        for batch in batches:
            for lo, hi, off, data in utf8_slices(batch.column(lower), SLICE_BYTES):
                lang, score, shares = [], [], []
                pi = own.shares(off, data) if own else np.zeros((hi - lo, 1))
                best = pi.argmax(axis=1)
                for p, b in zip(pi, best, strict=True):
                    found = p[b] > 0
                    lang.append(own.languages[b] if found else UNKNOWN)
                    score.append(min(1.0, float(p[b])))
                    shares.append([(own.languages[k], float(p[k])) for k in np.flatnonzero(p)] if found else [])
                made = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))]
                if evidence_col:
                    made.append(pa.array(own.evidence(off, data, pi) if own else np.zeros(hi - lo), pa.float64()))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=[*keep, *names])
        release_memory()

    return given.mapInArrow(run, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    plain = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict(plain, model).select("doc_id", "held_out", "lang_pred", "score", "lang_shares")
