"""Personal data: patterns, and information-theoretic sanitisation of the terms around them. DataFrame functions only.

Base. Emails, IP addresses, cards and phone numbers are found by one pattern each. The patterns are written without
backtracking; where a match of the plain pattern must start is stated by what precedes it.

Method. The values found are the protected entities e. A term t is a word of four letters or more within CONTEXT code
points of an entity that touches no base span. Over the distinct texts of the corpus, with n(.) the number of texts that
hold something and N all of them, PMI(e; t) = ln(n(e, t) N / (n(e) n(t))) and IC(e) = -ln(n(e) / N): a term with PMI = IC
gives the entity away wholly. Every pair seen together in MIN_TEXTS texts (one: most entities occur once) is judged by
PMI / IC: from REMOVE on, the term is removed where it stands near the entity, from GENERALISE on, it is generalised.
Contexts bound the pairs, so no text gives all pairs of its words. Terms are counted everywhere from the distinct terms of
each distinct text, before pairs are joined with the counts, so that no join gives more rows than there are pairs.

Work is in proportion to a text: positions are running sums, folded in blocks of BLOCK, and as disjoint words of four
letters stand NEARBY to a context at most, an entity looks at that many of the text's free terms on either side.

Defined cases: null texts count as empty; very long texts are taken whole; rows of equal doc_id and text are judged once
and returned each; a null doc_id is passed through; ratios at a bound count as reaching it; corpora without entities have
base spans only (none); extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialize

CONTEXT = 80
#: Disjoint words of four letters that fit a context, and one.
NEARBY = CONTEXT // 5 + 1
#: Elements that are folded at a time.
BLOCK = 128
#: Code points of the pieces that a text is cut into for redaction.
PIECE = 4096
MIN_TEXTS = 1
#: Candidate terms that are sent to all tasks; more are counted by a shuffle of each text's terms.
TERMS_SENT = 200_000
GENERALISE, REMOVE = 0.85, 0.97

#: The kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("generalised", "removed")

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    # a match starts where a run of local characters starts, or where the last match ended
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?=[0-9][\x20-]?[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TERM = r"(?<![\p{L}\p{N}])\p{L}{4,}(?![\p{L}\p{N}])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, F.lit("[^0-9]"), F.lit(""))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), part), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.rlike(value, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    n = F.length(_digits(value))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(False)


def _let(value: Column, body) -> Column:
    """`body` of the value, which is computed once however often `body` names it, inside of lambdas too."""
    return F.transform(F.array(value), body)[0]


def _folded(items: Column, start: Column, step, kind: str) -> Column:
    """All that `step` (state, item) -> (state, result) gives, in order; `kind` is the results' type.

    Results are gathered in blocks, then blocks, so that no long array is copied for each element.
    """
    none, empty = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc: Column, x: Column) -> Column:
        state, result = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(result)).alias("out"))

    def block(acc: Column, xs: Column) -> Column:
        inner = F.aggregate(xs, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return F.struct(inner["state"].alias("state"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    def whole(xs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
        blocks = F.transform(numbers, lambda k: F.slice(xs, k * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(xs) > 0, F.flatten(F.aggregate(blocks, F.struct(start.alias("state"), empty.alias("out")), block)["out"])).otherwise(none)

    return _let(items, whole)


def _located(text: Column, pattern: str) -> Column:
    """All matches in order, array of (start, stop, value)."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("hit")), lambda x: x["hit"].isNotNull())

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + F.length(x["gap"])
        stop = begin + F.length(x["hit"])
        return stop, F.struct(begin.alias("start"), stop.alias("stop"), x["hit"].alias("value"))

    return _folded(pairs, F.lit(0), step, "struct<start:int,stop:int,value:string>")


def _entity(kind: str, value: Column) -> Column:
    """What makes two values the same entity."""
    return F.concat(F.lit(f"{kind}:"), F.lower(value) if kind in ("email", "ip") else _digits(value))


def base_spans(text: Column) -> Column:
    """Valid matches, array of (kind, start, stop, entity), by kind and start."""
    may = _may(text)
    return F.concat(*(_spans_of(kind, text, may[kind]) for kind in KINDS))


def _may(text: Column) -> dict[str, Column]:
    """By kind, what a text with a match has."""
    digit = F.rlike(text, F.lit("[0-9]"))
    return {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+"))}


def has_match(text: Column) -> Column:
    """Whether any pattern matches; texts without a match have no span."""
    may, out = _may(text), F.lit(False)
    for kind in KINDS:
        pattern = rf"(?:[0-9][\x20-]?){{13}}" if kind == "card" else PATTERNS[kind].replace(r"\G|", "")
        out = out | (may[kind] & F.rlike(text, F.lit(pattern)))
    return F.coalesce(out, F.lit(False))


def _spans_of(kind: str, text: Column, may: Column) -> Column:
    none = F.array().cast("array<struct<kind:string,start:int,stop:int,entity:string>>")
    good = F.filter(_located(text, PATTERNS[kind]), lambda x: _valid(kind, x["value"]))
    typed = F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), _entity(kind, x["value"]).alias("entity")))
    return F.when(may, typed).otherwise(none)


def _number_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _marks(text: Column, base: Column) -> Column:
    """Base spans and words of the text by start; at one start, base spans first. A mark is either."""
    spans = F.transform(base, lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("of"), x["stop"].alias("stop"), F.lit(None).cast("string").alias("term"), x["entity"].alias("entity")))
    words = F.transform(_located(text, TERM), lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("of"), x["stop"].alias("stop"), F.lower(x["value"]).alias("term"), F.lit(None).cast("string").alias("entity")))
    return F.array_sort(F.concat(spans, words))


def _counted(marks: Column) -> Column:
    """Each mark with whether it is a free term, and how many free terms stand before it."""
    following = _let(marks, lambda xs: F.arrays_zip(xs.alias("m"), F.slice(xs, F.lit(2), F.size(xs)).alias("n")))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        m, n = x["m"], x["n"]
        word = m["of"] == 1
        free = word & (m["start"] > state["reach"]) & ~F.coalesce((n["of"] == 0) & (n["start"] <= m["stop"]), F.lit(False))
        reach = F.when(word, state["reach"]).otherwise(F.greatest(state["reach"], m["stop"]))
        after = F.struct(reach.alias("reach"), (state["n"] + free.cast("int")).alias("n"))
        return after, F.struct(m["start"].alias("start"), m["stop"].alias("stop"), m["term"].alias("term"), m["entity"].alias("entity"), free.alias("free"), state["n"].alias("n"))

    return _folded(following, F.struct(F.lit(-1).alias("reach"), F.lit(0).alias("n")), step, "struct<start:int,stop:int,term:string,entity:string,free:boolean,n:int>")


def _near(marks: Column) -> Column:
    """Free terms near each base span, array of (entity, term, start, stop)."""

    def near(x: Column, free: Column) -> Column:
        low = F.greatest(x["n"] - NEARBY, F.lit(0))
        some = F.slice(free, low + 1, F.lit(2 * NEARBY))
        here = F.filter(some, lambda t: F.when(t["start"] < x["start"], t["start"] >= x["start"] - CONTEXT).otherwise(t["stop"] <= x["stop"] + CONTEXT))
        return F.transform(here, lambda t: F.struct(x["entity"].alias("entity"), t["term"].alias("term"), t["start"].alias("start"), t["stop"].alias("stop")))

    def of(ms: Column) -> Column:
        spans = F.filter(ms, lambda m: m["entity"].isNotNull())
        return _let(F.filter(ms, lambda m: m["free"]), lambda free: F.flatten(F.transform(spans, lambda x: near(x, free))))

    return _let(marks, of)


def found(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), base spans and contexts of every document; a table without texts."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    based = text.withColumn("base", base_spans(F.col("text")))
    # texts without a base span, nearly all, are left alone
    spans = materialize(based.select("doc_id", F.xxhash64("text").alias("th"), "base", F.when(F.size("base") > 0, F.col("text")).alias("text")), "pii-spans")
    none = F.array().cast("array<struct<entity:string,term:string,start:int,stop:int>>")
    near = spans.where("text is not null").select("doc_id", "th", "base", _near(_counted(_marks(F.col("text"), F.col("base")))).alias("near"))
    return materialize(spans.where("text is null").select("doc_id", "th", "base", none.alias("near")).unionByName(near), "pii-found")


def disclosing(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(entity, term, ratio): the pairs whose PMI / IC is GENERALISE or more."""
    total = rows.agg(F.count_distinct("th")).first()[0]
    seen = rows.where(F.size("near") > 0).select("th", F.explode("near").alias("x")).select("th", "x.entity", "x.term").distinct()
    joint = materialize(seen.groupBy("entity", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= MIN_TEXTS), "pii-pairs")
    alone = rows.where(F.size("base") > 0).select("th", F.explode("base.entity").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    nearby = seen.select("th", "term").distinct().groupBy("term").agg(F.count("*").alias("n_c"))
    n = F.lit(float(total or 1))
    ic = -F.log(F.col("n_e") / n)

    def ratio(n_t: Column) -> Column:
        return F.when(ic > 0, F.log(F.col("n_et") * n / (F.col("n_e") * F.greatest(n_t, F.col("n_et")))) / ic).otherwise(0.0)

    # a term is in as many texts at least as it is near entities in: pairs with common words can't disclose, and go no further
    may = materialize(joint.join(alone, "entity").join(nearby, "term").where(ratio(F.col("n_c")) >= GENERALISE), "pii-candidates")
    terms = materialize(may.select("term").distinct(), "pii-terms")
    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    if terms.count() <= TERMS_SENT:
        # few terms: texts are searched for them where they lie, and only what is found is shuffled
        seen_in = text.select(F.xxhash64("text").alias("th"), F.explode(words).alias("term")).join(F.broadcast(terms), "term", "left_semi").distinct()
    else:
        # terms are letters only: a text's are one string until copies are folded
        folded = text.select(F.xxhash64("text").alias("th"), F.array_join(words, " ").alias("terms")).where("terms <> ''").groupBy("th").agg(F.first("terms").alias("terms"))
        seen_in = folded.select(F.explode(F.split("terms", " ")).alias("term"))
    everywhere = seen_in.groupBy("term").agg(F.count("*").alias("n_t"))
    scored = may.join(everywhere, "term").withColumn("ratio", ratio(F.col("n_t")))
    return scored.where(F.col("ratio") >= GENERALISE).select("entity", "term", "ratio")


def all_spans(docs: DataFrame) -> DataFrame:
    """doc_id, th, base and spans (base, then the method's by kind and start; each array of kind, start, stop)."""
    rows = found(docs)
    pairs = materialize(disclosing(docs, rows), "pii-disclosing")
    near = rows.where(F.size("near") > 0).select("doc_id", "th", F.explode("near").alias("x")).select("doc_id", "th", "x.*")
    kind = F.when(F.max("ratio") >= REMOVE, F.lit(TERM_KINDS[1])).otherwise(F.lit(TERM_KINDS[0]))
    hit = near.join(pairs, ["entity", "term"]).groupBy("doc_id", "th", "start", "stop").agg(kind.alias("kind"))
    terms = hit.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("h")).agg(F.array_sort(F.collect_list(F.struct("kind", "start", "stop"))).alias("terms"))
    plain = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    none = F.array().cast("array<struct<kind:string,start:int,stop:int>>")
    joined = rows.select("doc_id", "th", plain.alias("base")).join(terms, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left")
    return joined.select("doc_id", "th", "base", F.concat("base", F.coalesce("terms", none)).alias("spans"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, the count of each kind, base_sha256 and spans of every document."""
    return all_spans(docs).select("doc_id", *map(_number_of, KINDS), F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _cut(pieces: Column, start: Column, stop: Column) -> Column:
    """Code points start to stop of the text whose pieces these are."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor(stop / PIECE).cast("int")
    piece = lambda k: F.coalesce(F.try_element_at(pieces, k + 1), F.lit(""))
    one = F.substring(piece(first), start - first * PIECE + 1, stop - start)
    more = F.concat(F.substring(piece(first), start - first * PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(piece(last), F.lit(1), stop - last * PIECE))
    return F.when(first == last, one).otherwise(more)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with base spans and generalised terms replaced by their kind in brackets and removed terms cut out;
    n_chars, where it is a column, follows."""
    doc, th, at, found_spans, pieces = free_names(docs, "pii_doc", "pii_th", "pii_at", "pii_spans", "pii_pieces")
    spans = all_spans(docs).where(F.size("spans") > 0).groupBy("doc_id", "th").agg(F.first("spans").alias("spans"))
    spans = materialize(spans, "pii-redacted").select(F.col("doc_id").alias(doc), F.col("th").alias(th), F.col("spans").alias(found_spans))
    text = F.col("text")
    # texts without a match, nearly all, stay where they are
    keyed = docs.where(has_match(text)).withColumn(at, F.xxhash64(F.coalesce(text, F.lit(""))))
    # by a shuffle at every size: the spans have no bound that a broadcast could rely on
    joined = keyed.join(spans.hint("merge"), F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(at) == F.col(th)), "left")
    joined = joined.withColumn(pieces, F.when(F.col(found_spans).isNotNull(), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    order = F.array_sort(F.transform(found_spans, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))

    def step(reach: Column, x: Column) -> tuple[Column, Column]:
        mark = F.when(x["kind"] == TERM_KINDS[1], F.lit("")).when(x["kind"] == TERM_KINDS[0], F.lit("[term]")).otherwise(F.concat(F.lit("["), x["kind"], F.lit("]")))
        fresh = F.concat(_cut(F.col(pieces), reach, F.greatest(x["start"], reach)), mark)
        return F.greatest(reach, x["stop"]), F.when(x["start"] >= reach, fresh).otherwise("")

    end = F.array_max(F.transform(found_spans, lambda x: x["stop"]))
    clean = F.concat(F.array_join(_folded(order, F.lit(0), step, "string"), ""), _cut(F.col(pieces), end, F.length(text)))
    out = joined.withColumn("text", F.when(F.col(found_spans).isNotNull(), clean).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(found_spans).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(docs.where(~has_match(text)))


def oracle() -> str:
    """personal_data() over `documents` as DuckDB SQL."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    }
    parts = " UNION ALL ".join(f"SELECT id, {k} AS k, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS hits, string_split_regex(t, '{p}') AS gaps FROM t" for k, (kind, p) in enumerate(plain.items()))
    place = "SELECT *, (sum(length(gap) + length(hit)) OVER (PARTITION BY id{0} ORDER BY i) - length(hit))::INTEGER AS start FROM (SELECT id{0}, unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM {1} WHERE len(hits) > 0)"
    digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digits}[-i]::INTEGER WHEN {digits}[-i]::INTEGER > 4 THEN {digits}[-i]::INTEGER * 2 - 9 ELSE {digits}[-i]::INTEGER * 2 END)) % 10 = 0"
    return rf"""WITH t AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
p AS ({place.format(', k, kind', f'({parts})')}),
base AS MATERIALIZED (SELECT id, k, kind, start, start + length(hit) AS stop, kind || ':' || CASE WHEN k < 2 THEN lower(hit) ELSE {digits} END AS entity FROM p WHERE CASE kind
  WHEN 'email' THEN true WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda x: x::HUGEINT > 255)) = 0
  WHEN 'card' THEN length({digits}) BETWEEN 13 AND 19 AND {luhn} ELSE length({digits}) BETWEEN 9 AND 15 END),
runs AS (SELECT id, regexp_extract_all(t, '[\p{{L}}\p{{N}}]+') AS hits, string_split_regex(t, '[\p{{L}}\p{{N}}]+') AS gaps FROM t SEMI JOIN base USING (id)),
words AS (SELECT id, start, start + length(hit) AS stop, lower(hit) AS term FROM ({place.format('', 'runs')}) WHERE length(hit) >= 4 AND regexp_full_match(hit, '\p{{L}}+')),
free AS MATERIALIZED (SELECT * FROM words w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.id = w.id AND b.start <= w.stop AND w.start <= b.stop)),
near AS MATERIALIZED (SELECT DISTINCT f.id, entity, term, f.start, f.stop FROM free f JOIN base b ON b.id = f.id AND ((f.stop <= b.start AND f.start >= b.start - {CONTEXT}) OR (f.start >= b.stop AND f.stop <= b.stop + {CONTEXT}))),
h AS MATERIALIZED (SELECT id, t, min(id) OVER (PARTITION BY t) = id AS lead FROM t), one AS MATERIALIZED (SELECT * FROM h WHERE lead),
ne AS (SELECT entity, count(DISTINCT id) AS n_e FROM base SEMI JOIN one USING (id) GROUP BY 1),
net AS (SELECT entity, term, count(DISTINCT id) AS n_et FROM near SEMI JOIN one USING (id) GROUP BY ALL),
nt AS (SELECT term, count(*) AS n_t FROM (SELECT DISTINCT id, unnest(list_filter(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 4 AND regexp_full_match(x, '\p{{L}}+'))) AS term FROM one) GROUP BY 1),
n AS (SELECT count(*)::DOUBLE AS n FROM one),
r AS (SELECT entity, term, CASE WHEN n_e < n THEN ln(n_et * n / (n_e::DOUBLE * greatest(n_t, n_et))) / -ln(n_e / n) ELSE 0 END AS ratio FROM net JOIN ne USING (entity) JOIN nt USING (term), n),
terms AS (SELECT id, CASE WHEN max(ratio) >= {REMOVE} THEN 'removed' ELSE 'generalised' END AS kind, start, stop FROM near JOIN r USING (entity, term) WHERE ratio >= {GENERALISE} GROUP BY id, start, stop),
b AS (SELECT id, {', '.join(f"count(*) FILTER (kind = '{k}')::BIGINT AS n_{k}" for k in plain)}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) AS listed FROM base GROUP BY id),
m AS (SELECT id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY kind, start) AS listed FROM terms GROUP BY id)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in plain)}, sha256(coalesce(b.listed, '')) AS base_sha256, coalesce(concat_ws(',', b.listed, m.listed), '') AS spans FROM t LEFT JOIN b USING (id) LEFT JOIN m USING (id)"""
