"""Personal data: patterns, and information-theoretic sanitisation of what surrounds them.

Base spans are e-mail and IP addresses, card and phone numbers, leftmost
and non-overlapping per kind, by Java regular expressions that are
equivalent to the plain ones but can't run in squared time (no start
inside a run that has already failed, possessive repeats).

Every base value is a protected entity; the words of every text that holds
it, wherever they stand, are its terms.  Over the whole corpus, with N
different texts and the numbers of them that hold the entity, the term, and
both together, a term's disclosure is the share of the entity's information
it reveals: PMI(entity; term) / IC(entity) = log(p N / n_e) / log(N / n_e)
with p = n_et / n_t, which is 1 when the term occurs with the entity only.
For p stands the lower end of its confidence interval (Wilson, one-sided 90
per cent), so terms seen once or twice count, but for less; equal texts are
one, so that copies are no evidence.  A term is generalised from
``GENERALISE`` on and removed from ``REMOVE`` on, wherever it stands in a
text with that entity.

All of it is DataFrame expressions.  Texts aren't shuffled for the spans;
counts are combined in each task before the shuffle.

Defined results: a null text is an empty one, without spans; an empty
table gives no rows; equal rows (id and text) get equal spans and are all
returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.llm.common import BROADCAST_BYTES, free_name, row_key, table, written

#: Kinds in the order of ties.
KINDS = ["email", "ip", "card", "phone", "term"]

_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_WORD = r"[\p{L}\p{M}\p{N}]+"

#: Normal quantile of the one-sided confidence.
Z = 1.2816
GENERALISE = 0.6
REMOVE = 0.9

_SPANS = "array<struct<start:int,stop:int,value:string>>"


def _found(text: Column, pattern: str) -> tuple[Column, Column]:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _placed(matches: Column, gaps: Column) -> Column:
    """Spans (start, stop, value) of matches, given the text between them."""
    parts = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
    return F.aggregate(
        F.filter(parts, lambda x: x["m"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["g"] + F.length(x["m"])).alias("at"),
            F.concat(a["out"], F.array(F.struct(
                (a["at"] + x["g"]).alias("start"), (a["at"] + x["g"] + F.length(x["m"])).alias("stop"), x["m"].alias("value"),
            ))).alias("out"),
        ),
        lambda a: a["out"],
    )


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    worth = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, r"[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _kept(kind: str, spans: Column) -> Column:
    """The valid spans of a kind, as (start, rank, stop, kind, value)."""
    valid = F.filter(spans, lambda s: _valid(kind, s["value"]))
    return F.transform(valid, lambda s: F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind"),
        s["value"].alias("value"),
    ))


def with_base_spans(docs: DataFrame, text_col: str = "text", out_col: str = "base") -> DataFrame:
    """``docs`` with the base spans: array of (start, rank, stop, kind, value) in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rules = {"email": (_EMAIL, text.contains("@")), "ip": (_IP, text.contains(".")), "card": (_CARD, F.lit(True)), "phone": (_PHONE, text.contains("+"))}
    out = docs
    for kind, (pattern, possible) in rules.items():
        out = out.withColumn(f"_m_{kind}", F.when(possible, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    for kind, (pattern, _) in rules.items():
        spans = F.when(F.size(f"_m_{kind}") > 0, _placed(F.col(f"_m_{kind}"), F.split(text, pattern, -1))).otherwise(F.array().cast(_SPANS))
        out = out.withColumn(f"_s_{kind}", _kept(kind, spans))
    return out.withColumn(out_col, F.sort_array(F.concat(*(f"_s_{k}" for k in rules)))).drop(
        *(f"_m_{k}" for k in rules), *(f"_s_{k}" for k in rules)
    )


def _covered(text: Column, spans: Column, fill) -> Column:
    """The text with each span replaced by ``fill(span, first position not yet covered)``; spans are in order."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["stop"]).alias("at"),
            F.concat(a["out"], F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), fill(s, a["at"])).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )


def _entities(base: Column) -> Column:
    return F.array_distinct(F.transform(base, lambda b: F.xxhash64(b["kind"], F.lower(b["value"]))))


def _held(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds _hash (of the text) and, for texts with a base span, _blank: the text with spaces for the base spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    blank = _covered(text, F.col("base"), lambda s, at: F.repeat(F.lit(" "), F.greatest(s["stop"] - F.greatest(at, s["start"]), F.lit(0))))
    return docs.withColumns({"_hash": F.xxhash64(text), "_blank": F.when(F.size("base") > 0, blank)})


def _words(texts: DataFrame) -> DataFrame:
    """(_hash, term, start, stop): the words of two or more characters of each _blank."""
    found, gaps = _found(F.col("_blank"), _WORD)
    parts = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
    rows = texts.select("_hash", F.posexplode(F.filter(parts, lambda x: x["m"].isNotNull())).alias("i", "x"))
    stop = F.sum(F.col("x.g") + F.length("x.m")).over(Window.partitionBy("_hash").orderBy("i")).cast("int")
    placed = rows.select("_hash", F.lower("x.m").alias("term"), stop.alias("stop"), F.length("x.m").alias("n"))
    return placed.where("n > 1").select("_hash", "term", (F.col("stop") - F.col("n")).alias("start"), "stop")


def disclosure(n_et: Column, n_e: Column, n_t: Column, total: Column) -> Column:
    """Share of the entity's information that the term reveals, by the lower bound of n_et / n_t."""
    p, z2 = F.least(F.lit(1.0), n_et / n_t), Z * Z
    low = (p + z2 / (2 * n_t) - Z * F.sqrt(p * (1 - p) / n_t + z2 / (4 * n_t * n_t))) / (1 + z2 / n_t)
    return F.least(F.lit(1.0), F.log(low * total / n_e) / F.log(total / n_e))


def _counted(contexts: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(term, n_t): number of different texts with the term; each of c equal texts counts 1 / c."""
    copies = contexts.groupBy("_hash").agg(F.count("*").alias("c")).where("c > 1")
    side = F.broadcast(copies) if copies.count() * 32 <= BROADCAST_BYTES else copies
    texts = docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash"), F.col(text_col).alias("t")).join(side, "_hash", "left")
    words = F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(_WORD), F.lit(0)))
    terms = texts.select(F.explode(words).alias("term"), (1 / F.coalesce("c", F.lit(1))).alias("w"))
    return terms.groupBy("term").agg(F.greatest(F.lit(1.0), F.round(F.sum("w"))).alias("n_t"))


def risky_terms(contexts: DataFrame, docs: DataFrame, words: DataFrame, text_col: str, generalise: float) -> DataFrame:
    """(_hash, term, d): the terms of each text that reveal one of its entities; ``contexts`` has base and _hash."""
    own = contexts.where(F.size("base") > 0).dropDuplicates(["_hash"]).select("_hash", F.explode(_entities(F.col("base"))).alias("entity"))
    own = written(own, "entities")
    n_e = own.groupBy("entity").agg(F.count("*").alias("n_e"))
    # all entities of one text only have the same terms and numbers, so one stands for them
    own = own.join(n_e, "entity").select("_hash", F.when(F.col("n_e") == 1, F.col("_hash")).otherwise(F.col("entity")).alias("entity"), "n_e").distinct()
    pairs = written(words.select("_hash", "term").distinct().join(own, "_hash"), "pairs")
    total = float(contexts.select("_hash").distinct().count())
    together = pairs.where(F.col("n_e") < total).groupBy("entity", "term").agg(F.count("*").alias("n_et"), F.first("n_e").alias("n_e"))
    n_t = _counted(contexts, docs, text_col).join(pairs.select("term").distinct(), "term", "left_semi")
    judged = together.join(n_t, "term").withColumn("d", disclosure(F.col("n_et"), F.col("n_e"), F.col("n_t"), F.lit(total)))
    risky = judged.where(F.col("d") >= generalise).select("entity", "term", "d")
    return pairs.select("_hash", "entity", "term").join(risky, ["entity", "term"]).groupBy("_hash", "term").agg(F.max("d").alias("d"))


def find_pii(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE,
) -> DataFrame:
    """(id, _key, base, spans): base spans and all spans of each row; those of terms carry the action as their value."""
    given = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    contexts = _held(with_base_spans(given.withColumn("_key", row_key("_id", "_text")), "_text"), "_text")
    contexts = written(contexts.select("_id", "_key", "base", "_hash", "_blank"), "pii")
    words = written(_words(contexts.where(F.size("base") > 0).select("_hash", "_blank").dropDuplicates(["_hash"])), "words")
    action = F.when(F.col("d") >= remove, "remove").otherwise("generalise")
    hits = written(
        words.join(risky_terms(contexts, given, words, "_text", generalise), ["_hash", "term"])
        .groupBy("_hash").agg(F.collect_list(F.struct(
            "start", F.lit(len(KINDS) - 1).alias("rank"), "stop", F.lit("term").alias("kind"), action.alias("value"),
        )).alias("terms")), "terms",
    )
    base = contexts.select("_id", "_key", "base", "_hash")
    size = hits.agg(F.sum(64 + 64 * F.size("terms"))).first()[0] or 0
    spans = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "terms")))
    some = base.where(F.size("base") > 0).join(F.broadcast(hits) if size <= BROADCAST_BYTES else hits, "_hash", "left")
    none = base.where(F.size("base") == 0)
    return (
        some.select(F.col("_id").alias(id_col), "_key", "base", spans.alias("spans"))
        .unionByName(none.select(F.col("_id").alias(id_col), "_key", "base", F.col("base").alias("spans")))
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced by their kinds, revealing terms removed or generalised."""
    key = free_name(docs.columns, "_key")
    own = free_name([*docs.columns, key], "_spans")
    spans = find_pii(docs, id_col, text_col).where(F.size("spans") > 0).select(F.col("_key").alias(key), F.col("spans").alias(own)).dropDuplicates([key])

    def fill(s: Column, at: Column) -> Column:
        mark = F.when(s["kind"] != "term", F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).when(s["value"] == "remove", "").otherwise("<TERM>")
        return F.when(s["start"] >= at, mark).otherwise("")

    joined = docs.withColumn(key, row_key(id_col, text_col)).join(spans, key, "left")
    text = F.when(F.col(own).isNull(), F.col(text_col)).otherwise(_covered(F.col(text_col), F.col(own), fill))
    return joined.withColumn(text_col, text).select(*docs.columns)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in KINDS[:4]), F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )
